"""Display labels and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cloud cover percent -> sky colour.
CLOUD_STOPS = [
    (0, (0, 0, 60)),
    (30, (72, 72, 102)),
    (40, (96, 96, 116)),
    (70, (168, 168, 158)),
    (80, (192, 192, 172)),
    (100, (240, 240, 200)),
]

# Jet stream speed (km/h, inclusive bound) -> seeing label, colour.
SEEING_STEPS = [
    (30, "excellent", "green"),
    (60, "good", "limegreen"),
    (90, "fair", "orange"),
    (120, "poor", "orangered"),
    (None, "very poor", "red"),
]


def cloud_color(percent: Column) -> Column:
    """``rgb(r, g, b)`` interpolated between the colour stops."""
    p = F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))

    def channel(i: int) -> Column:
        out = F.lit(float(CLOUD_STOPS[-1][1][i]))
        for (p0, c0), (p1, c1) in reversed(list(zip(CLOUD_STOPS, CLOUD_STOPS[1:]))):
            value = c0[i] + (c1[i] - c0[i]) * ((p - p0) / (p1 - p0))
            out = F.when(p <= p1, F.floor(value + 0.5)).otherwise(out)
        return out.cast("int")

    return F.format_string("rgb(%d, %d, %d)", channel(0), channel(1), channel(2))


def _ladder(speed: Column, index: int) -> Column:
    out = F.lit(SEEING_STEPS[-1][index])
    for step in reversed(SEEING_STEPS[:-1]):
        out = F.when(speed <= step[0], step[index]).otherwise(out)
    return out


def seeing_label(speed: Column) -> Column:
    return _ladder(speed, 1)


def seeing_color(speed: Column) -> Column:
    return _ladder(speed, 2)

"""Exposure control: one step as Columns and as a plain function of a state."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    min_exposure: float = 0.000032
    max_exposure: float = 60.0
    min_gain: float = 0.0
    max_gain: float = 300.0


# Dead band, gain of the error, bounds of one step, share of the gain range per step.
DEAD_BAND, SLOPE, MIN_FACTOR, MAX_FACTOR, GAIN_SHARE = 0.002, 3.0, 0.5, 2.0, 0.1


def step(brightness: Column, exposure: Column, gain: Column, target: Column, limits: Limits) -> tuple[Column, Column]:
    """Next exposure and gain towards the target brightness."""
    error = target - brightness
    factor = F.least(F.greatest(1.0 + error * SLOPE, F.lit(MIN_FACTOR)), F.lit(MAX_FACTOR))
    longest = exposure == limits.max_exposure
    # at the longest exposure the gain moves instead, downwards only while there is some
    by_gain = longest & ((error > 0) | (gain != limits.min_gain))
    moved = F.when(by_gain, exposure).otherwise(exposure * factor)
    turned = F.when(by_gain, gain + F.signum(error) * (limits.max_gain * GAIN_SHARE)).otherwise(gain)
    still = (brightness == 0) | (target == 0) | (F.abs(error) < DEAD_BAND)
    bounded = F.least(F.greatest(moved, F.lit(limits.min_exposure)), F.lit(limits.max_exposure))
    trimmed = F.least(F.greatest(turned, F.lit(limits.min_gain)), F.lit(limits.max_gain))
    return F.when(still, exposure).otherwise(bounded), F.when(still, gain).otherwise(trimmed)


def advance(brightness: float, exposure: float, gain: float, target: float, limits: Limits) -> tuple[float, float]:
    """``step`` on plain numbers, for stateful operators."""
    error = target - brightness
    if brightness == 0 or target == 0 or abs(error) < DEAD_BAND:
        return exposure, gain
    if exposure == limits.max_exposure and (error > 0 or gain != limits.min_gain):
        gain += math.copysign(limits.max_gain * GAIN_SHARE, error)
    else:
        exposure *= min(max(1.0 + error * SLOPE, MIN_FACTOR), MAX_FACTOR)
    return (min(max(exposure, limits.min_exposure), limits.max_exposure),
            min(max(gain, limits.min_gain), limits.max_gain))


@dataclass(frozen=True)
class Controller:
    """Damped controller over the mean of the last ten medians."""

    target: float = 0.0  # 0 follows the light: 0.3 + 0.3 * exp(-4 * mean)
    response: float = 0.5
    shutter_min: float = 0.0001
    shutter_max: float = 30.0
    gain_min: float = 1.0
    gain_max: float = 16.0
    hysteresis: float = 0.05
    lamp_on: float = 0.25
    history: int = 10

    def goal(self, recent: list[float]) -> float:
        return self.target if self.target > 0 else 0.3 + 0.3 * math.exp(-4.0 * sum(recent) / len(recent))

    def moved(self, dark: bool, shutter: float, gain: float) -> tuple[int, float]:
        """Which of (shutter, gain) moves, and how far at most: the shutter is the first to open and the last to close."""
        spent = shutter >= self.shutter_max if dark else gain <= self.gain_min
        return {(True, False): (0, self.shutter_max), (True, True): (1, self.gain_max),
                (False, False): (1, self.gain_min), (False, True): (0, self.shutter_min)}[dark, spent]

    def lit(self, median: float, lamp: int) -> int:
        """The lamp keeps its state between its two thresholds."""
        return int(median <= self.lamp_on + self.hysteresis if lamp else median < self.lamp_on)

    def advance(self, median: float, recent: list[float], shutter: float, gain: float,
                lamp: int) -> tuple[list[float], float, float, int]:
        recent = [*recent, median][-self.history:]
        ratio = self.goal(recent) / median
        which, bound = self.moved(ratio > 1.0, shutter, gain)
        values = [shutter, gain]
        step = values[which] * (1.0 + self.response * (ratio - 1.0))
        values[which] = min(step, bound) if ratio > 1.0 else max(step, bound)
        return recent, *values, self.lit(median, lamp)

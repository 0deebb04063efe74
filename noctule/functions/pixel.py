"""Pointwise pixel expressions; every function maps Columns to Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(x, _c(lo)), _c(hi))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec.709 luminance."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def saturation(r: Column, g: Column, b: Column, floor: float = EPS) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top <= floor, 0.0).otherwise(F.try_divide(top - low, top))


def smoothstep(lo, hi, x: Column) -> Column:
    t = clamp((x - _c(lo)) / (_c(hi) - _c(lo)))
    return t * t * (3.0 - 2.0 * t)


def quantize(x: Column, top: int) -> Column:
    """0..1 to 0..top, rounding half up."""
    return F.floor(clamp(x) * float(top) + 0.5).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0..1), saturation and value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    hue = (
        F.when(spread == 0.0, 0.0)
        .when(top == r, F.try_divide(g - b, spread) + F.when(g < b, 6.0).otherwise(0.0))
        .when(top == g, F.try_divide(b - r, spread) + 2.0)
        .otherwise(F.try_divide(r - g, spread) + 4.0)
    )
    sat = F.when(top == 0.0, 0.0).otherwise(F.try_divide(spread, top))
    return hue / 6.0, sat, top


def rgb_from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Each channel follows the same trapezoid over the hue circle, shifted
    by a third: full value within one sextant of its peak, a linear flank,
    then ``v * (1 - s)``."""

    def channel(offset: float) -> Column:
        k = F.pmod(F.lit(offset) + h * 6.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


def adjust_saturation(r: Column, g: Column, b: Column, factor: float) -> tuple[Column, ...]:
    h, s, v = hsv(r, g, b)
    return tuple(clamp(c) for c in rgb_from_hsv(h, F.least(s * factor, F.lit(1.0)), v))


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Y, Cb, Cr with the Rec.709 weights (also the denoiser's Y, U, V)."""
    return (
        luma(r, g, b),
        -0.114572 * r - 0.385428 * g + 0.5 * b,
        0.5 * r - 0.454153 * g - 0.045847 * b,
    )


def rgb_from_ycc(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb


def rgb_from_yuv(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    return (clamp(y + 1.13983 * v), clamp(y - 0.39465 * u - 0.58060 * v), clamp(y + 2.03211 * u))


def gamma(x: Column, exponent) -> Column:
    return F.pow(clamp(x), _c(exponent))


def adaptive_gamma(base: float, frames: Column) -> Column:
    """Gamma lowered with the number of fused frames, never below 0.1."""
    return F.greatest(base - 0.07 * (1.0 - 1.0 / (1.0 + (frames - 1) * 0.3)), F.lit(0.1))


def white_balance16(v: Column, scale: float) -> Column:
    """16-bit channel gain with saturation."""
    return F.least(F.floor(v * scale), F.lit(65535)).cast("int")


def reduce_green(r: Column, g: Column, b: Column, amount: float, protect: str = "average") -> Column:
    """Green after removing the excess over a neutral level."""
    neutral = {
        "none": F.lit(0.0),
        "average": (r + b) / 2.0,
        "maximum": F.greatest(r, b),
    }[protect]
    excess = g - neutral
    return F.when(excess > 0.0, F.greatest(g - amount * excess, F.lit(0.0))).otherwise(g)


def midtones_transfer(x: Column, m: float) -> Column:
    if m <= 0.0:
        return F.when(x <= 0.0, 0.0).otherwise(1.0)
    if m >= 1.0 or abs(1.0 - 2.0 * m) < EPS:
        return x
    return clamp((x - m) / (1.0 - 2.0 * m) + 0.5)


def compress(v: Column, k: float) -> Column:
    return v / (1.0 + k * F.abs(v))


def protection(y: Column, shadows: float, highlights: float) -> Column:
    return clamp((1.0 - shadows * (1.0 - y)) * (1.0 - highlights * y))


def midtone_bell(y: Column, width: float) -> Column:
    sigma = 0.25 * min(max(width, 0.05), 1.0)
    return F.exp(-((y - 0.5) * (y - 0.5)) * (1.0 / (2.0 * sigma * sigma)))


def highlight_rolloff(y: Column) -> Column:
    t = clamp((y - 0.8) / 0.2)
    return F.when(y <= 0.8, 1.0).otherwise(0.5 * (1.0 + F.cos(t * math.pi)))


def is_black(r: Column, g: Column, b: Column, eps: float = 0.0) -> Column:
    return (r <= eps) & (g <= eps) & (b <= eps)


def is_masked(mode: str, r: Column, g: Column, b: Column, a: Column, eps: float = 1e-12) -> Column:
    """Mask test in one of the modes none, alpha, rgb, either."""
    clear = F.abs(a) <= eps
    black = (F.abs(r) <= eps) & (F.abs(g) <= eps) & (F.abs(b) <= eps)
    return {"none": F.lit(False), "alpha": clear, "rgb": black, "either": clear | black}[mode]


def in_circle(x: Column, y: Column, cx: int, cy: int, radius: int) -> Column:
    dx, dy = x - cx, y - cy
    return dx * dx + dy * dy <= radius * radius


def in_range(*channels: Column) -> Column:
    """All channels within 0..1."""
    test = F.lit(True)
    for c in channels:
        test = test & c.between(0.0, 1.0)
    return test


def all_between(lo: float, hi: float, *channels: Column) -> Column:
    """All channels strictly between two levels."""
    test = F.lit(True)
    for c in channels:
        test = test & (c > lo) & (c < hi)
    return test


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def exposure_weight(y: Column, peak: Column, y_max, center: Column, sigma: float,
                    clip: float, clip_factor: float) -> Column:
    """Well-exposedness of a pixel: a bell around ``center``, less weight near
    clipping and for the darkest tenth."""
    level = F.least(y / _c(y_max), F.lit(1.0))
    # no branches: they would keep shared parts from being computed once
    bell = F.exp(-0.5 * ((level - center) * (level - center)) / (sigma * sigma))
    start = clip * clip_factor
    near_clip = clamp((peak - start) / max(clip * (1.0 - clip_factor), EPS))
    dark = F.least(level / 0.10, F.lit(1.0))
    return bell * (1.0 - 0.7 * near_clip) * (dark * dark)


# Exposure centre by mean median luminance, (upper bound, centre).
CENTER_BRIGHT = [(0.10, 0.20), (0.15, 0.30), (0.25, 0.40), (0.35, 0.50), (None, 0.55)]
CENTER_DARK = [(0.07, 0.15), (0.10, 0.20), (0.15, 0.25), (0.25, 0.30), (None, 0.40)]


def exposure_center(brightness: Column, steps: list) -> Column:
    out = F.lit(steps[-1][1])
    for bound, value in reversed(steps[:-1]):
        out = F.when(brightness < bound, value).otherwise(out)
    return out

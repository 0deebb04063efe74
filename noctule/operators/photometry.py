"""Frame statistics and the corrections derived from them.

Input is the long pixel table ``(frame_id, x, y, r, g, b[, a])`` with values
in 0..1.  Statistics are partial aggregates by frame, written down before they
are joined back, so that the planner knows their size: one row per frame is
broadcast while small, and otherwise the join is shuffled and hot frames are
split.  The pixel table itself is only scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noctule.functions import pixel as P
from noctule.operators import ranks
from noctule.session import stored

FRAME = "frame_id"


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _channels(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per pixel and channel ``(…, c, v)``."""
    return rows.unpivot(keep, ["r", "g", "b"], "c", "v")


def center(width: Column | int, height: Column | int, fraction: float) -> Column:
    """Pixels of the central part; the fraction is held within 0.1..1."""
    fraction = min(max(fraction, 0.1), 1.0)
    margin = (1.0 - fraction) / 2.0
    w, h = _dim(width), _dim(height)
    return ((F.col("x") >= F.floor(w * margin)) & (F.col("x") < F.floor(w * (1.0 - margin)))
            & (F.col("y") >= F.floor(h * margin)) & (F.col("y") < F.floor(h * (1.0 - margin))))


def subframe(width: Column | int, height: Column | int, percent: Column | float) -> Column:
    """Pixels of the central subframe given in percent of each side."""
    share = (1.0 - _dim(percent) / 100.0) * 0.5
    w, h = _dim(width), _dim(height)
    x0, y0 = F.floor(share * w), F.floor(share * h)
    return (F.col("x") >= x0) & (F.col("x") < w - x0) & (F.col("y") >= y0) & (F.col("y") < h - y0)


def _dim(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- medians, noise, focus-free scalars -------------------------------------

def median_brightness(pixels: DataFrame, width=None, height=None, fraction: float = 1.0,
                      bins: int = 1024) -> DataFrame:
    """Median of the middle 96 % of each channel, from a histogram.

    Black pixels are left out; a frame without others gets 0."""
    r, g, b = _rgb()
    inside = F.lit(True) if width is None else center(width, height, fraction)
    used = inside & ~((r == 0) & (g == 0) & (b == 0))
    # unused pixels count in bin -1, so that a frame without others is not lost
    levels = _channels(pixels.select(FRAME, "r", "g", "b", used.alias("_used")), [FRAME, "_used"])
    level = F.when(F.col("_used"), F.floor(P.clamp(F.col("v")) * (bins - 1) + 0.5)).otherwise(-1)
    counts = levels.groupBy(FRAME, "c", level.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("n", F.when(F.col("bin") >= 0, F.col("_n")).otherwise(0))
    # at most `bins` + 1 rows per frame and channel
    channel = W.partitionBy(FRAME, "c")
    counts = counts.select("*", F.sum("n").over(channel.orderBy("bin")).alias("upto"),
                           F.sum("n").over(channel).alias("total"))
    middle = F.floor((F.floor(F.col("total") * 0.02) + F.floor(F.col("total") * 0.98)) / 2)
    hit = (F.col("bin") >= 0) & (F.col("upto") >= middle)
    return counts.groupBy(FRAME).agg(*[
        F.coalesce(F.min(F.when((F.col("c") == c) & hit, F.col("bin"))) / float(bins - 1), F.lit(0.0)).alias(f"median_{c}")
        for c in "rgb"])


def noise_sigma(pixels: DataFrame, medians: DataFrame, cx: int, cy: int, radius: int) -> DataFrame:
    """1.4826 times the median absolute deviation of green from the frame's
    ``median_g``, within a circle."""
    used = pixels.where(P.in_circle(F.col("x"), F.col("y"), cx, cy, radius) & (F.col("g") > 0))
    deviation = used.join(stored(medians.select(FRAME, "median_g"), "medians"), FRAME).select(
        FRAME, F.abs(F.col("g") - F.col("median_g")).alias("d"))
    return ranks.median(deviation, [FRAME], "d").select(
        FRAME, F.col("n").alias("n_pixels"), (F.col("median") * 1.4826).alias("sigma_noise"))


def overexposure(pixels: DataFrame, threshold: float, fraction: float) -> DataFrame:
    """Whether the clipped pixels reach the fraction (one pixel at least)."""
    r, g, b = _rgb()
    stats = pixels.groupBy(FRAME).agg(
        F.count_if((r >= threshold) | (g >= threshold) | (b >= threshold)).alias("clipped"),
        F.count(F.lit(1)).alias("n_pixels"))
    limit = F.greatest(F.floor(F.col("n_pixels") * fraction), F.lit(1))
    return stats.select("*", (F.col("clipped") >= limit).cast("int").alias("overexposed"))


def clipped_mean(pixels: DataFrame, lo: float, hi: float) -> DataFrame:
    """Mean per channel over ``lo <= v < hi``; NULL when a channel has none."""
    means = pixels.groupBy(FRAME).agg(
        *[F.avg(F.when((F.col(c) >= lo) & (F.col(c) < hi), F.col(c))).alias(c) for c in "rgb"])
    complete = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    return means.select(FRAME, *[F.when(complete, F.col(c)).alias(f"mean_{c}") for c in "rgb"])


def gray_scales(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Red and blue gains that make a patch gray; 1 without usable pixels."""
    patch = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    valid = patch & P.all_between(0.01, 0.99, *_rgb())
    sums = pixels.groupBy(FRAME).agg(*[F.sum(F.when(valid, F.col(c))).alias(c) for c in "rgb"])
    return sums.select(FRAME, *[F.coalesce(F.try_divide(F.col("g"), F.col(c)), F.lit(1.0)).alias(f"scale_{c}")
                                for c in "rb"])


def color_statistics(pixels: DataFrame, width, height, percent: float) -> DataFrame:
    """Means, deviations, gains towards the brightest mean, and the cap."""
    used = pixels.where(subframe(width, height, percent)
                        & (F.col("r") < 1.0) & (F.col("g") < 1.0) & (F.col("b") < 1.0))
    stats = used.groupBy(FRAME).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in "rgb"], *[F.stddev_pop(c).alias(f"std_{c}") for c in "rgb"])
    target = F.greatest("mean_r", "mean_g", "mean_b")
    spread = F.greatest("std_r", "std_g", "std_b")
    return stats.select("*", *[F.try_divide(target, F.col(f"mean_{c}")).alias(f"scale_{c}") for c in "rgb"],
                        (target + 3.0 * spread).alias("cap"))


def auto_color(pixels: DataFrame, width, height, percent: float) -> DataFrame:
    """Cap at ``target + 3 sigma``, then balance the channels."""
    joined = pixels.join(stored(color_statistics(pixels, width, height, percent)), FRAME)
    return joined.select(FRAME, "x", "y", *[
        P.clamp(F.least(F.col(c), F.col("cap")) * F.col(f"scale_{c}")).alias(c) for c in "rgb"])


# --- scenes -----------------------------------------------------------------

def scene_features(pixels: DataFrame, profile: str = "cpu") -> DataFrame:
    """Luminance mean and deviation and the pixel shares a scene is told by.

    Shares and mean are relative to all pixels; out-of-range ones add nothing."""
    r, g, b = _rgb()
    y, s = P.luma(r, g, b), P.saturation(r, g, b)
    if profile == "gpu":
        ok = F.lit(True)
        tests = {"bright": y > 0.85, "blue": F.lit(False), "day_cloud": (y > 0.15) & (y < 0.65),
                 "aurora": (s > 0.40) & (y < 0.85), "night_cloud": (y > 0.15) & (y < 0.65)}
    else:
        ok = P.in_range(r, g, b)
        tests = {"bright": y > 0.85, "blue": (y > 0.10) & (y < 0.40) & (s > 0.50),
                 "day_cloud": (y > 0.45) & (s < 0.35), "aurora": (y < 0.40) & (s > 0.55),
                 "night_cloud": (y > 0.15) & (y < 0.65) & (s < 0.25)}
    n = F.count(F.lit(1))
    stats = pixels.groupBy(FRAME).agg(
        (F.sum(F.when(ok, y).otherwise(0.0)) / n).alias("mean_y"),
        (F.sum(F.when(ok, y * y).otherwise(0.0)) / n).alias("mean_y2"),
        *[(F.count_if(ok & test) / n).alias(f"{name}_share") for name, test in tests.items()])
    variance = F.greatest(F.col("mean_y2") - F.col("mean_y") * F.col("mean_y"), F.lit(0.0))
    return stats.withColumn("std_y", F.sqrt(variance)).drop("mean_y2")


# Decision thresholds per profile.
SCENE_RULES = {
    "cpu": {"day": 0.18, "night": 0.05, "day_cloud": 0.25, "bright": 0.0005, "aurora": 0.01, "night_cloud": 0.20},
    "gpu": {"day": 0.25, "night": 0.02, "day_cloud": 0.25, "bright": 0.0002, "aurora": 0.01, "night_cloud": 0.20},
}


def scene_class(features: DataFrame, profile: str = "cpu") -> DataFrame:
    t = SCENE_RULES[profile]
    day, night = F.col("mean_y") > t["day"], F.col("mean_y") < t["night"]
    scene = (
        F.when(day & (F.col("day_cloud_share") > t["day_cloud"]), "DAY_CLOUDY")
        .when(day, "DAY_CLEAR")
        .when(night & (F.col("bright_share") > t["bright"]), "NIGHT_MOON")
        .when(night & (F.col("aurora_share") > t["aurora"]), "NIGHT_AURORA")
        .when(night & (F.col("night_cloud_share") > t["night_cloud"]), "NIGHT_CLOUDY")
        .when(night, "NIGHT_CLEAR")
        .otherwise("TWILIGHT")
    )
    return features.withColumn("scene", scene)


# Scene -> (subframe percent, luma clip, saturation clip, sigma, mix).
AMBIENCE = {
    "NIGHT_CLEAR": (40.0, 0.80, 0.30, 1.0, 0.25),
    "NIGHT_CLOUDY": (15.0, 0.75, 0.25, 0.8, 0.10),
    "NIGHT_MOON": (20.0, 0.70, 0.20, 1.2, 0.20),
    "NIGHT_AURORA": (60.0, 0.70, 0.60, 1.0, 0.15),
    "DAY_CLEAR": (20.0, 0.30, 0.80, 0.6, 0.08),
    "DAY_CLOUDY": (20.0, 0.30, 0.80, 0.6, 0.08),
}
AMBIENCE_FIELDS = ("percent", "luma_clip", "sat_clip", "sigma", "mix")


def _by_scene(index: int) -> Column:
    out = F.lit(None).cast("double")
    for scene, values in AMBIENCE.items():
        out = F.when(F.col("scene") == scene, values[index]).otherwise(out)
    return out


def ambience_scales(pixels: DataFrame, scenes: DataFrame, width, height) -> DataFrame:
    """Channel gains towards the frame's ambient light.

    Twilight frames and frames with too few usable pixels have no row.  The
    usable pixels are averaged again within a luminance band around their
    mean; a band of under 50 pixels falls back to all of them."""
    settings = scenes.select(FRAME, *[_by_scene(i).alias(n) for i, n in enumerate(AMBIENCE_FIELDS)])
    settings = stored(settings.where("percent is not null"))
    r, g, b = _rgb()
    y, s = P.luma(r, g, b), P.saturation(r, g, b, floor=0.0)
    used = pixels.join(settings, FRAME).where(
        subframe(width, height, F.col("percent")) & P.in_range(r, g, b)
        & (y <= F.col("luma_clip")) & (s <= F.col("sat_clip")))
    used = used.select(FRAME, "r", "g", "b", y.alias("_y"), "sigma", "mix")
    band = used.groupBy(FRAME).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_m"), F.avg(F.col("_y") * F.col("_y")).alias("_m2"))
    deviation = F.sqrt(F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    band = stored(band.where("n >= 100").select(FRAME, "n", "_m", deviation.alias("_sd")))
    near = (F.col("_sd") <= 0) | (F.abs(F.col("_y") - F.col("_m")) <= F.col("sigma") * F.col("_sd"))
    sums = used.join(band, FRAME).groupBy(FRAME, "n", "mix").agg(
        F.count_if(near).alias("n_band"),
        *[F.avg(c).alias(f"all_{c}") for c in "rgb"],
        *[F.avg(F.when(near, F.col(c))).alias(f"band_{c}") for c in "rgb"])
    ambient = sums.select(FRAME, "n", "n_band", "mix", *[
        F.when(F.col("n_band") < 50, F.col(f"all_{c}")).otherwise(F.col(f"band_{c}")).alias(c) for c in "rgb"])
    ambient = ambient.where((F.col("r") > 0) & (F.col("g") > 0) & (F.col("b") > 0))
    level = P.luma(F.col("r"), F.col("g"), F.col("b"))
    scaled = ambient.select(FRAME, "n", "n_band", *[
        (1.0 + (P.clamp(level / F.col(c), 0.25, 4.0) - 1.0) * F.col("mix")).alias(f"scale_{c}") for c in "rgb"])
    skip = reduce(lambda a, z: a & z, [F.abs(F.col(f"scale_{c}") - 1.0) < 1e-3 for c in "rgb"])
    return scaled.withColumn("applied", F.when(skip, 0).otherwise(1))


def ambience(pixels: DataFrame, scales: DataFrame) -> DataFrame:
    """Apply ambience gains; frames without any stay as they are."""
    joined = pixels.join(stored(scales), FRAME, "left")
    return joined.select(FRAME, "x", "y", *[
        F.when(F.col("applied") == 1, P.clamp(F.col(c) * F.col(f"scale_{c}"))).otherwise(F.col(c)).alias(c)
        for c in "rgb"])


# --- levels -----------------------------------------------------------------

def black_point_statistics(pixels: DataFrame, min_shift: float, max_shift: float,
                           dark: float, bins: int = 2048) -> DataFrame:
    """Luminance quantiles and the black shift they call for."""
    r, g, b = _rgb()
    level = P.clamp(P.luma(r, g, b))
    lit = pixels.where(~P.is_black(r, g, b, P.EPS)).select(FRAME, level.alias("_l"))
    counts = lit.groupBy(FRAME, F.floor(F.col("_l") * (bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_l").alias("s"), F.min("_l").alias("lo"), F.max("_l").alias("hi"))
    # at most `bins` rows per frame
    frame = W.partitionBy(FRAME)
    counts = counts.select("*", F.sum("n").over(frame.orderBy("bin")).alias("upto"),
                           F.sum("n").over(frame).alias("total"))
    low_count, high_count = F.floor(F.col("total") * 0.01), F.floor(F.col("total") * 0.99)
    stats = counts.groupBy(FRAME).agg(
        F.max("total").alias("n_pixels"), (F.sum("s") / F.sum("n")).alias("mean_y"),
        F.min("lo").alias("min_y"), F.max("hi").alias("max_y"),
        # while the 1 % bin is bin 0 the search goes on to the next bin, but
        # not past the 99 % bin
        F.min(F.when((F.col("upto") >= low_count) & (F.col("bin") > 0), F.col("bin"))).alias("_p01"),
        F.min(F.when(F.col("upto") >= high_count, F.col("bin"))).alias("_p99"),
        F.max(F.when(F.col("bin") == 0, F.col("upto"))).alias("_zero"), F.max("total").alias("_t"))
    reaches_low = F.coalesce(F.col("_zero") >= F.floor(F.col("_t") * 0.01), F.floor(F.col("_t") * 0.01) <= 0)
    # the search steps over every bin, so past an early hit in bin 0 it stops at bin 1
    p01 = F.when(F.col("_p99") == 0, 0).when(reaches_low, 1).otherwise(F.col("_p01"))
    stats = stats.select(FRAME, "n_pixels", "mean_y", "min_y", "max_y",
                         (p01 / float(bins - 1)).alias("p01"), (F.col("_p99") / float(bins - 1)).alias("p99"))
    # (a single pixel has both quantiles in bin 0)
    stats = stats.withColumns({c: F.when(F.col("n_pixels") > 1, F.col(c)).otherwise(0.0) for c in ("p01", "p99")})
    shift = (
        F.when(F.col("mean_y") > dark, min_shift)
        .when((F.col("p01") > 0.02) & (F.col("p99") - F.col("p01") > 0.05), max_shift)
        .when(F.col("p01") > 0.005, (min_shift + max_shift) * 0.5)
        .otherwise(0.0)
    )
    return stats.withColumn("shift", shift)


def black_point(pixels: DataFrame, min_shift: float, max_shift: float, dark: float) -> DataFrame:
    stats = black_point_statistics(pixels, min_shift, max_shift, dark)
    joined = pixels.join(stored(stats.select(FRAME, "min_y", "max_y", "shift")), FRAME, "left")
    span = F.col("max_y") - F.col("min_y")
    black = F.col("min_y") + F.col("shift") * span
    move = (F.col("shift") > 0) & ~P.is_black(*_rgb(), P.EPS)
    return joined.select(FRAME, "x", "y", *[
        F.when(move, P.clamp(F.try_divide(F.col(c) - black, span * (1.0 - F.col("shift")))))
        .otherwise(F.col(c)).alias(c) for c in "rgb"])


def stretch_levels(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Values at two rank percentiles of all channels pooled."""
    pooled = _channels(pixels, [FRAME]).where(P.is_finite(F.col("v")) & (F.col("v") >= 0))
    levels = ranks.rank_values(pooled, [FRAME], "v", {
        "black": lambda n: F.when(n == 2, 1).otherwise(F.floor((n - 1) * low) + 1),
        "white": lambda n: F.when(n == 2, 2).otherwise(F.floor((n - 1) * high) + 1)})
    return levels.where("n >= 2 and white - black >= 1e-6")


def autostretch(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Linear stretch between the percentiles; flat frames stay unchanged."""
    joined = pixels.join(stored(stretch_levels(pixels, low, high)), FRAME, "left")
    return joined.select(FRAME, "x", "y", *[
        F.when(F.col("n").isNull(), F.col(c))
        .otherwise(P.clamp(F.try_divide(F.col(c) - F.col("black"), F.col("white") - F.col("black")))).alias(c)
        for c in "rgb"])


def normalize_range(pixels: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Rescale the pooled channel range of each frame to ``lo..hi``."""
    stats = pixels.groupBy(FRAME).agg(F.min(F.least(*_rgb())).alias("_lo"), F.max(F.greatest(*_rgb())).alias("_hi"))
    span = F.when(F.col("_hi") - F.col("_lo") < P.EPS, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return pixels.join(stored(stats), FRAME).select(FRAME, "x", "y", *[
        P.clamp(lo + (F.col(c) - F.col("_lo")) / span * (hi - lo), lo, hi).alias(c) for c in "rgb"])


def normalize8(pixels: DataFrame) -> DataFrame:
    """Pooled range of each frame to integers 0..255; a flat frame becomes 0."""
    stats = pixels.groupBy(FRAME).agg(F.min(F.least(*_rgb())).alias("_lo"), F.max(F.greatest(*_rgb())).alias("_hi"))
    gain = F.when(F.col("_hi") > F.col("_lo"), F.try_divide(F.lit(255.0), F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return pixels.join(stored(stats), FRAME).select(FRAME, "x", "y", *[
        F.floor(F.least((F.col(c) - F.col("_lo")) * gain, F.lit(255.0))).cast("int").alias(c) for c in "rgb"])


def tonemap16(pixels: DataFrame) -> DataFrame:
    """Per-channel range to 0..65535; ranges under 1 count as 1."""
    stats = pixels.groupBy(FRAME).agg(*[F.min(c).alias(f"_lo_{c}") for c in "rgb"],
                                      *[F.max(c).alias(f"_hi_{c}") for c in "rgb"])
    return pixels.join(stored(stats), FRAME).select(FRAME, "x", "y", *[
        ((F.col(c) - F.col(f"_lo_{c}"))
         / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1.0)) * 65535.0).alias(c) for c in "rgb"])


def haze_level(pixels: DataFrame, fraction: float) -> DataFrame:
    """Mean of the lowest part of the luminances of non-black pixels."""
    r, g, b = _rgb()
    lit = pixels.where(~((r == 0) & (g == 0) & (b == 0))).select(FRAME, P.luma(r, g, b).alias("_l"))
    return ranks.lowest_mean(lit, [FRAME], "_l", fraction).select(
        FRAME, F.col("n").alias("n_pixels"), F.col("mean").alias("haze"))


# --- white balance ----------------------------------------------------------

def white_balance(pixels: DataFrame, scale_r: float, scale_g: float, scale_b: float,
                  protect: float = 0.0) -> DataFrame:
    """Channel gains, attenuated as a whole when the brightest value would
    pass 1.1, with an optional hue-preserving limiter per pixel."""
    gains = dict(zip("rgb", (scale_r, scale_g, scale_b)))
    protect = min(max(protect, 0.0), 1.0)
    tops = pixels.groupBy(FRAME).agg(*[F.greatest(F.max(c), F.lit(0.0)).alias(f"_top_{c}") for c in "rgb"])
    peak = F.greatest(*[F.col(f"_top_{c}") * s for c, s in gains.items()])
    tops = tops.select(FRAME, F.when(peak > 1.10, F.try_divide(F.lit(1.0), peak)).otherwise(1.0).alias("_att"))
    scaled = pixels.join(stored(tops), FRAME).select(
        FRAME, "x", "y", *[(F.col(c) * (s * F.col("_att"))).alias(c) for c, s in gains.items()])
    top = F.greatest(*_rgb())
    limit = F.when(top > 1.0, 1.0 - (1.0 - F.try_divide(F.lit(1.0), top)) * protect).otherwise(1.0)
    return scaled.select(FRAME, "x", "y", *[P.clamp(F.col(c) * limit).alias(c) for c in "rgb"])


# --- histogram of 8-bit frames ----------------------------------------------

def luma_histogram(pixels8: DataFrame, width: int | Column, stride: int = 1) -> DataFrame:
    """Counts per 8-bit luminance over every ``stride``-th non-black pixel in
    row order; all of them unless told otherwise.  Channels are integers 0..255."""
    r, g, b = _rgb()
    sampled = pixels8.where(((F.col("y") * width + F.col("x")) % stride == 0)
                            & ~((r == 0) & (g == 0) & (b == 0)))
    level = F.floor(P.luma(r, g, b) + 0.5).cast("int")
    return sampled.groupBy(FRAME, level.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def luma_statistics(histogram: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and median of a luminance histogram."""
    frame = W.partitionBy(FRAME)  # 256 rows at most
    counts = histogram.select("*", F.sum("n").over(frame.orderBy("bin")).alias("upto"),
                              F.sum("n").over(frame).alias("total"))
    half = F.col("total") / 2.0
    stats = counts.groupBy(FRAME).agg(
        F.min("bin").alias("min"), F.max("bin").alias("max"),
        (F.sum(F.col("bin") * F.col("n")) / F.max("total")).alias("mean"),
        F.max("total").alias("n_pixels"),
        F.min(F.when(F.col("upto") >= half, F.col("bin"))).alias("_low"),
        F.min(F.when(F.col("upto") >= half + 1, F.col("bin"))).alias("_high"))
    # a lower middle found in bin 0 is given up for bin 1 unless the upper one is there too
    low = F.when((F.col("_low") == 0) & ~F.coalesce(F.col("_high") == 0, F.lit(False)), 1).otherwise(F.col("_low"))
    median = F.when(F.col("n_pixels") % 2 == 0, (low + F.coalesce("_high", F.lit(0))) / 2.0).otherwise(
        low.cast("double"))
    return stats.select(FRAME, "min", "max", "mean", median.alias("median"), "n_pixels")


# --- stars, small tests -----------------------------------------------------

def sqm(stars: Column, intercept: float, slope: float) -> Column:
    """Sky brightness from a star count; NULL without stars."""
    return F.when(stars >= 1, intercept - slope * F.log10(F.greatest(stars, F.lit(1)).cast("double")))


def sqm_corrected(stars: Column, exposure: Column, gain_db: Column, intercept: float, slope: float) -> Column:
    """As ``sqm`` with the count corrected for exposure and gain."""
    factor = F.sqrt(exposure) * F.pow(F.lit(2.0), gain_db / 12.0)
    return F.when((stars >= 1) & (exposure > 0),
                  intercept - slope * F.log10(F.try_divide(stars.cast("double"), factor)))


def monochrome(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(FRAME).agg(
        F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).cast("int").alias("monochrome"))


def weight_statistics(weights: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    return weights.groupBy(*keys).agg(F.min(weight).alias("min_w"), F.max(weight).alias("max_w"),
                                      F.sum(weight).alias("sum_w"), F.avg(weight).alias("avg_w"))


def gate(rows: DataFrame) -> DataFrame:
    """Measurements that only count under their conditions: sky brightness on
    long exposures of a dark sky, noise at night with gain."""
    dark = (F.col("exposure") > 1.0) & (F.col("mean_g") <= 0.21)
    amplified = (F.col("night_mode") == 1) & (F.col("gain") > 0)
    return rows.withColumns({"sqm": F.when(dark, F.col("sqm")), "stars": F.when(dark, F.col("stars")),
                             "noise": F.when(amplified, F.col("noise"))})


def skip_daytime(rows: DataFrame, daytime_capture: Column) -> DataFrame:
    """Drop day observations of stations that do not capture by day."""
    return rows.where((F.col("night_mode") == 1) | daytime_capture)

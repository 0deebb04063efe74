"""Exposure brackets: per-pixel weights and the merged frame.

``pixels (bracket, k, x, y, r, g, b[, a])`` holds every exposure of a bracket,
k = 0 the longest; ``frames (bracket, k, exposure, median_r, median_g,
median_b)`` one row per exposure.  A pixel of a bracket has five exposures at
most, so the per-pixel windows are bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noctule.functions import pixel as P
from noctule.operators import focal
from noctule.session import stored

SITE = ["bracket", "x", "y"]
DEPTH = 5
TINY = 1e-12


@dataclass(frozen=True)
class Settings:
    clip: float = 0.99998
    y_max: float = 1.0  # 0 finds it per bracket
    sigma: float = 0.8
    clip_factor: float = 0.90
    contrast: float = 0.0
    chroma_bias: float = 0.3
    scale_r: float = 1.0
    scale_g: float = 1.0
    scale_b: float = 1.0


def _masked() -> Column:
    return P.is_black(F.col("r"), F.col("g"), F.col("b"), P.EPS) | (F.col("a") <= P.EPS)


def linearize(pixels: DataFrame, frames: DataFrame, settings: Settings) -> DataFrame:
    """Pixels with the gains that bring them to the longest exposure, the
    bracket's exposure centre, and linear luminance.

    A bracket with an exposure or median of 0 has no rows."""
    whole = W.partitionBy("bracket")
    first = lambda c: F.first(c).over(whole.orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    scales = {"r": settings.scale_r, "g": settings.scale_g, "b": settings.scale_b}
    usable = (F.col("exposure") > 0) & (F.col("median_r") > 0) & (F.col("median_g") > 0) & (F.col("median_b") > 0)
    brightness = F.avg(P.luma(F.col("median_r"), F.col("median_g"), F.col("median_b"))).over(whole)
    gains = frames.select(
        "bracket", "k", F.col("median_g").alias("med_g"), first("median_g").alias("med_g0"),
        F.try_divide(first("exposure"), F.col("exposure")).alias("gain"),
        *[F.try_divide(first(f"median_{c}") / s, F.col(f"median_{c}") / s).alias(f"gain_{c}") for c, s in scales.items()],
        brightness.alias("brightness"), F.bool_and(usable).over(whole).alias("_ok"))
    # everything that is the same for a whole exposure is worked out here, once
    gains = gains.where("_ok").select(
        "bracket", "k", "gain", *[f"gain_{c}" for c in "rgb"], *[c.alias(n) for c, n in zip(_fade(), ("fade_lo", "fade_hi"))],
        P.exposure_center(F.col("brightness"), P.CENTER_BRIGHT).alias("center_bright"),
        P.exposure_center(F.col("brightness"), P.CENTER_DARK).alias("center_dark"))
    gains = stored(gains)
    rows = pixels if "a" in pixels.columns else pixels.withColumn("a", F.lit(1.0))
    rows = rows.join(gains, ["bracket", "k"]).withColumn("masked", _masked())
    rows = rows.withColumns({f"lin_{c}": F.col(c) * F.col("gain") * F.col(f"gain_{c}") for c in "rgb"})
    luma = P.luma(F.col("lin_r"), F.col("lin_g"), F.col("lin_b"))
    rows = rows.withColumn("lin_y", F.when(F.col("masked"), 0.0).otherwise(luma))
    return _with_y_max(rows, settings)


def _with_y_max(rows: DataFrame, settings: Settings) -> DataFrame:
    if settings.y_max > 0:
        return rows.withColumn("y_max", F.lit(settings.y_max))
    clipped = F.greatest("r", "g", "b") >= settings.clip * 0.95
    tops = rows.where("not masked").groupBy("bracket").agg(
        F.max(F.when(~clipped, F.col("lin_y"))).alias("_open"), F.max("lin_y").alias("_any"))
    top = F.when(F.col("_open") > 0, F.col("_open")).otherwise(F.col("_any"))
    guess = top * 1.1
    y_max = F.when(guess < 0.5, 1.0).when(guess > 5.0, 3.0).otherwise(guess)
    tops = tops.select("bracket", F.when(top > 0, y_max).otherwise(1.0).alias("y_max"))
    return rows.join(stored(tops), "bracket", "left").withColumn("y_max", F.coalesce("y_max", F.lit(1.0)))


def _fade() -> tuple[Column, Column]:
    """Luminances between which an exposure fades in.  Short exposures fade
    out where they are too dark to add anything but noise; the longest never."""
    low = F.col("med_g0") * 0.35
    high = F.greatest(F.col("med_g") * 4.0, F.lit(0.40))
    longest, second = F.col("k") == 0, F.col("k") == 1
    return (F.when(longest, -2.0).when(second, low).otherwise(high * 0.6),
            F.when(longest, -1.0).when(second, low * 1.2).otherwise(high))


def raw_weights(pixels: DataFrame, frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Weight ``raw_w`` of every exposure of every pixel, not normalised; row-local
    unless contrast counts."""
    rows = linearize(pixels, frames, settings)
    center = F.when(F.col("y_max") >= 1.0, F.col("center_bright")).otherwise(F.col("center_dark"))
    norm = [F.col(c) * F.col("gain") for c in "rgb"]
    weight = P.exposure_weight(P.luma(*norm), F.greatest(*norm), F.col("y_max"), center,
                               settings.sigma, settings.clip, settings.clip_factor)
    peak = F.greatest("r", "g", "b")
    start, end = settings.clip * 0.95, settings.clip
    t = P.clamp(1.0 - (peak - start) / max(end - start, P.EPS))
    open_share = t * t * (3.0 - 2.0 * t)
    weight = weight * (0.4 + 0.6 * open_share)
    if settings.contrast > 0:
        rows = focal.local_contrast(rows, ["bracket", "k"], "lin_y", F.col("masked"))
        weight = weight * ((1.0 - settings.contrast) + settings.contrast * F.col("contrast"))
    return rows.withColumn("raw_w", F.when(F.col("masked"), 0.0).otherwise(P.clamp(weight) * P.smoothstep(F.col("fade_lo"), F.col("fade_hi"), F.col("lin_y"))))


def weights(pixels: DataFrame, frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Normalised weight ``w`` of every exposure of every pixel; where the sum
    is next to nothing the best exposure takes it all."""
    site = W.partitionBy(*SITE)
    rows = raw_weights(pixels, frames, settings)
    rows = rows.withColumns({"_sum": F.sum("raw_w").over(site),
                             "_best": F.max_by("k", F.struct("raw_w", -F.col("k"))).over(site)})
    w = (F.when(F.col("_sum") > TINY, F.try_divide(F.col("raw_w"), F.col("_sum")))
         .when(F.col("_sum") > 0, (F.col("k") == F.col("_best")).cast("double"))
         .otherwise(0.0))
    return rows.withColumn("w", w).drop("_best")


def chroma_weight(w: Column, weighted: Column, longest: Column, bias: float) -> Column:
    """Weight for colour, leaning towards the longest exposure.  That exposure
    belongs to every bracket, so the weights still add up to one."""
    return F.when(weighted, w * (1.0 - bias) + F.when(longest, bias).otherwise(0.0)).otherwise(w)


def side_by_side(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All exposures of a pixel in one row, ``<column>_<k>``; fails on an exposure beyond ``depth``.

    One hash aggregate on plain numbers: no sort, no collected list."""
    beyond = F.raise_error(F.concat(F.lit(f"a bracket has more than {depth} exposures: raise depth, found k = "), F.col("k").cast("string")))
    rows = rows.withColumn("k", F.when(F.col("k") < depth, F.col("k")).otherwise(beyond.cast("int")))
    columns = ["raw_w", "lin_y", "lin_r", "lin_g", "lin_b"]
    picks = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in range(depth) for c in columns]
    masks = [F.max(F.when(F.col("k") == k, F.col("masked").cast("int"))).alias(f"masked_{k}") for k in range(depth)]
    return rows.groupBy(*SITE).agg(*picks, *masks)


def _total(terms: list[Column]) -> Column:
    return sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))


def _merge_wide(rows: DataFrame, mode: int, bias: float, depth: int = DEPTH) -> DataFrame:
    """Modes 0 and 1 on ``side_by_side`` rows."""
    ks = range(depth)
    raw = [F.coalesce(F.col(f"raw_w_{k}"), F.lit(0.0)) for k in ks]
    rows = rows.select("*", _total(raw).alias("_sum"), F.greatest(*raw).alias("_top"))
    first = F.coalesce(*[F.when(raw[k] == F.col("_top"), k) for k in ks])
    rows = rows.withColumn("_first", first)
    rows = rows.withColumns({f"_w_{k}": F.when(F.col("_sum") > TINY, F.try_divide(raw[k], F.col("_sum")))
                             .when(F.col("_sum") > 0, (F.col("_first") == k).cast("double")).otherwise(0.0) for k in ks})
    weighted = F.col("_sum") > 0
    lean = [chroma_weight(F.col(f"_w_{k}"), weighted, F.lit(k == 0), bias) for k in ks]
    rows = rows.withColumns({f"_c_{k}": F.when(F.col(f"masked_{k}").isNotNull(), lean[k]) for k in ks})
    fused = _total([F.col(f"_w_{k}") * F.col(f"lin_y_{k}") for k in ks]).alias("y_fused")
    open_ = [F.col(f"masked_{k}") == 0 for k in ks]
    if mode == 0:
        # without any weight: the first exposure that is not masked
        share = [F.when((F.col(f"_c_{k}") > 0) | open_[k], F.col(f"_c_{k}")) for k in ks]
        best = F.greatest(*share)
        rows = rows.select("*", *[c.alias(f"_s_{k}") for k, c in enumerate(share)], best.alias("_b"))
        pick = lambda c: F.coalesce(*[F.when(F.col(f"_s_{k}") == F.col("_b"), F.col(f"lin_{c}_{k}")) for k in ks])
        return rows.select(*SITE, fused, *[pick(c).alias(c) for c in "rgb"])
    used = [F.when(open_[k] & (F.col(f"_c_{k}") > 0), F.col(f"_c_{k}")) for k in ks]
    rows = rows.select("*", *[u.alias(f"_u_{k}") for k, u in enumerate(used)], _total(used).alias("_t"))
    return rows.select(*SITE, fused, *[
        F.when(F.col("_t") > P.EPS, F.try_divide(_total([F.col(f"_u_{k}") * F.col(f"lin_{c}_{k}") for k in ks]), F.col("_t"))).alias(c)
        for c in "rgb"])


def _match_luma(rows: DataFrame) -> DataFrame:
    """Scale colour so that its luminance is the fused one."""
    own = P.luma(F.col("r"), F.col("g"), F.col("b"))
    ratio = F.when((F.col("y_fused") <= P.EPS) | (own <= P.EPS), 1.0).otherwise(
        P.clamp(F.try_divide(F.col("y_fused"), own), 0.1, 10.0))
    return rows.withColumn("_s", ratio).select(*SITE, *[
        F.coalesce(F.col(c) * F.col("_s"), F.lit(0.0)).alias(c) for c in "rgb"])


def merge(pixels: DataFrame, frames: DataFrame, settings: Settings = Settings(), mode: int = 1, depth: int = DEPTH) -> DataFrame:
    """Merged frame per bracket.

    Colour modes: 0 takes it from the best exposure, 1 from the weighted mean,
    2 from the mean with weights smoothed over 3x3 pixels.  ``depth`` is the
    most exposures a bracket may have in modes 0 and 1."""
    if mode in (0, 1):
        return _match_luma(_merge_wide(side_by_side(raw_weights(pixels, frames, settings), depth), mode, settings.chroma_bias, depth))
    rows = weights(pixels, frames, settings)
    rows = rows.withColumn("cw", chroma_weight(F.col("w"), F.col("_sum") > 0, F.col("k") == 0, settings.chroma_bias))
    rows = focal.mean(rows, ["bracket", "k"], "cw", 1, out="_smooth").withColumn("cw", F.col("_smooth"))
    used = ~F.col("masked") & (F.col("cw") > 0)
    out = rows.groupBy(*SITE).agg(
        F.sum(F.col("w") * F.col("lin_y")).alias("y_fused"), F.sum(F.when(used, F.col("cw"))).alias("_t"),
        *[F.sum(F.when(used, F.col(f"lin_{c}") * F.col("cw"))).alias(c) for c in "rgb"])
    return _match_luma(out.select(*SITE, "y_fused", *[
        F.when(F.col("_t") > P.EPS, F.try_divide(F.col(c), F.col("_t"))).alias(c) for c in "rgb"]))


def night_median(pixels: DataFrame, frames: DataFrame, value: str, scale: int, amount: float, depth: int = DEPTH) -> DataFrame:
    """Noise reduction before a merge: medians of radius 1 to ``scale * (k + 1)`` on exposure k.

    Only by night, with gain above 1 and exposure above a second, and never on
    the longest exposure; other exposures stay.  ``frames`` has exposure, gain
    and night_mode by (bracket, k)."""
    noisy = (F.col("night_mode") == 1) & (F.col("exposure") > 1.0) & (F.col("gain") > 1.0) & (F.col("k") > 0)
    marked = frames.select("bracket", "k", F.coalesce(noisy, F.lit(False)).alias("_noisy"))
    rows = pixels.join(stored(marked, "noisy"), ["bracket", "k"], "left").withColumn("_noisy", F.coalesce("_noisy", F.lit(False)))
    out = rows.where(~F.col("_noisy") | (F.col("k") >= depth)).drop("_noisy")
    for k in range(1, depth):
        part = rows.where(F.col("_noisy") & (F.col("k") == k)).drop("_noisy")
        filtered = focal.multiscale_median(part, ["bracket", "k"], value, scale * (k + 1), amount, "_median")
        out = out.unionByName(filtered.drop(value).withColumnRenamed("_median", value))
    return out

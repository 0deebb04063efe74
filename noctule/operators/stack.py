"""Frame stacks: one result per pixel over a series of 8-bit frames.

Input ``(series, seq, x, y, c, v)``.  Final stacks are partial aggregates by
pixel.  Stacks that depend on frame order use a window per pixel that only
grows: one shuffle, as many groups as the frames have pixels, and a group as
long as the series has frames (a night: hundreds to thousands).  For endless
series, ``segment`` cuts them: a segment starts from the running totals of
those before it, at the price of a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noctule.session import stored

PIXEL = ["series", "x", "y", "c"]


def to_byte(v: Column) -> Column:
    """Clamp to 0..255 and round half up."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def stack(frames: DataFrame, mode: str, threshold: float = 3.0, segment: int | None = None) -> DataFrame:
    """Stack a series: ``avg max min sum median sigma sigma_reject diff
    motion``.  ``sigma`` clamps the mean to a band around itself and so equals
    it; ``sigma_reject`` drops values outside the band."""
    if mode == "motion":
        return motion(frames, threshold, segment)
    if mode == "sigma_reject":
        return _reject(frames, threshold)
    v = F.col("v").cast("double")
    last, first = F.max_by("v", "seq"), F.min_by("v", "seq")
    rules = {
        "avg": lambda: F.avg(v),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
        "sum": lambda: F.sum(v),
        # a byte has 256 levels: the exact percentile keeps a count per level
        "median": lambda: F.percentile(F.col("v"), F.lit(0.5)),
        "sigma": lambda: F.greatest(F.least(F.avg(v), F.avg(v) + threshold * F.stddev_pop(v)),
                                    F.avg(v) - threshold * F.stddev_pop(v)),
        "diff": lambda: F.abs(last - first).cast("double"),
    }
    return frames.groupBy(*PIXEL).agg(rules[mode]().alias("_s"), F.count(F.lit(1)).alias("n_frames")).select(
        *PIXEL, "n_frames", to_byte(F.col("_s")).alias("v"))


def _reject(frames: DataFrame, threshold: float) -> DataFrame:
    v = F.col("v").cast("double")
    stats = frames.groupBy(*PIXEL).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_sd"),
                                       F.count(F.lit(1)).alias("n_frames"))
    near = F.abs(v - F.col("_m")) <= threshold * F.col("_sd")
    kept = frames.join(stats, PIXEL).groupBy(*PIXEL, "n_frames", "_m").agg(F.avg(F.when(near, v)).alias("_s"))
    return kept.select(*PIXEL, "n_frames", to_byte(F.coalesce("_s", "_m")).alias("v"))


def running(frames: DataFrame, segment: int | None = None) -> DataFrame:
    """Adds the running count, sum, minimum and maximum up to each frame."""
    if segment is None:
        line = W.partitionBy(*PIXEL).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        return frames.select(*PIXEL, F.col("seq").cast("long").alias("seq"), "v", F.count(F.lit(1)).over(line).alias("run_n"),
                             F.sum("v").over(line).alias("run_sum"), F.min("v").over(line).alias("run_min"),
                             F.max("v").over(line).alias("run_max"))
    rows = frames.select(*PIXEL, "seq", "v", F.floor(F.col("seq") / segment).alias("_seg"))
    totals = rows.groupBy(*PIXEL, "_seg").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("v").alias("_s"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    earlier = W.partitionBy(*PIXEL).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*PIXEL, "_seg", F.sum("_n").over(earlier).alias("_n"), F.sum("_s").over(earlier).alias("_s"),
                            F.min("_lo").over(earlier).alias("_lo"), F.max("_hi").over(earlier).alias("_hi"))
    carried = carried.where("_n is not null").select("*", F.lit(None).cast("long").alias("seq"),
                                                     F.lit(None).cast(dict(rows.dtypes)["v"]).alias("v"))
    rows = rows.select("*", F.lit(1).cast("long").alias("_n"), F.col("v").cast("long").alias("_s"),
                       F.col("v").alias("_lo"), F.col("v").alias("_hi"))
    both = rows.withColumn("seq", F.col("seq").cast("long")).unionByName(carried)
    # the carried row has no sequence number and comes first
    line = W.partitionBy(*PIXEL, "_seg").orderBy(F.col("seq").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    out = both.select(*PIXEL, "seq", "v", F.sum("_n").over(line).alias("run_n"), F.sum("_s").over(line).alias("run_sum"),
                      F.min("_lo").over(line).alias("run_min"), F.max("_hi").over(line).alias("run_max"))
    return out.where("seq is not null")


def running_stack(frames: DataFrame, mode: str = "avg", segment: int | None = None) -> DataFrame:
    """Frame i of the timelapse: the stack of frames 1..i."""
    value = {"avg": F.col("run_sum") / F.col("run_n"), "sum": F.col("run_sum").cast("double"),
             "min": F.col("run_min").cast("double"), "max": F.col("run_max").cast("double")}[mode]
    return running(frames, segment).select(*PIXEL, "seq", to_byte(value).alias("v"))


def motion(frames: DataFrame, threshold: float, segment: int | None = None) -> DataFrame:
    """Sum of the steps above the running background that reach the
    threshold, scaled so that the series' strongest pixel is 255."""
    step = F.abs(F.col("v") - F.col("run_min")).cast("double")
    sums = running(frames, segment).groupBy(*PIXEL).agg(
        F.sum(F.when(step >= threshold, step).otherwise(0.0)).alias("_a"), F.count(F.lit(1)).alias("n_frames"))
    # the sums are used twice: for their maximum and scaled by it
    sums = stored(sums, "motion")
    tops = sums.groupBy("series").agg(F.max("_a").alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col("_a") * F.try_divide(F.lit(255.0), F.col("_top"))).otherwise(0.0)
    return sums.join(stored(tops), "series").select(*PIXEL, "n_frames", to_byte(scaled).alias("v"))

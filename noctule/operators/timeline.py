"""Ordered operators on station timelines.

A station's timeline has no bound, so no window ever spans all of it.  Rows
are grouped by (station, bucket of time); what a bucket has to know about the
past is carried in as a handful of rows found by a small summary of the
buckets.  With second-resolution primary keys a day bucket holds at most
86,400 rows per station.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86400


def with_history(rows: DataFrame, keys: list[str], time: str, depth: int, tie: list[str] | None = None,
                 bucket_seconds: int = DAY) -> DataFrame:
    """``rows`` plus, per bucket, the ``depth`` rows before it.

    Adds ``_bucket`` and ``_carried`` (1 on the repeated rows).  Every bucket
    that exists has a row, so the last ``depth`` rows of the ``depth`` buckets
    before it are enough."""
    order = [time, *(tie or [])]
    marked = rows.withColumn("_bucket", F.floor(F.col(time) / bucket_seconds))
    columns = rows.columns
    tail_order = W.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).desc() for c in order])
    tails = (marked.withColumn("_rn", F.row_number().over(tail_order)).where(F.col("_rn") <= depth)
             .groupBy(*keys, "_bucket")
             .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order],
                                                       F.struct(*columns).alias("_row")))).alias("_tail")))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(-depth, -1)
    carried = tails.select(*keys, "_bucket", F.flatten(F.collect_list("_tail").over(before)).alias("_past"))
    carried = carried.select("_bucket", F.explode(F.slice("_past", F.greatest(F.size("_past") - depth + 1, F.lit(1)),
                                                          F.lit(depth))).alias("_p"))
    carried = carried.select("_bucket", "_p._row.*", F.lit(1).alias("_carried"))
    return marked.withColumn("_carried", F.lit(0)).unionByName(carried)


def _fresh(rows: DataFrame) -> DataFrame:
    return rows.where("_carried = 0").drop("_bucket", "_carried")


def _past(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, "_bucket").orderBy(*order)


def previous(rows: DataFrame, keys: list[str], time: str, values: dict[str, str], tie: list[str] | None = None,
             bucket_seconds: int = DAY) -> DataFrame:
    """Adds the previous row's columns: ``values`` maps column -> new name."""
    line = _past(keys, [time, *(tie or [])])
    wide = with_history(rows, keys, time, 1, tie, bucket_seconds)
    return _fresh(wide.withColumns({new: F.lag(c).over(line) for c, new in values.items()}))


def state_changes(rows: DataFrame, keys: list[str], time: str, state: str, tie: list[str] | None = None,
                  before=None, after=None) -> DataFrame:
    """Rows whose ``state`` differs from the row before (optionally only from
    ``before`` to ``after``)."""
    out = previous(rows, keys, time, {state: "_was"}, tie)
    if before is None:
        return out.where(F.col("_was") != F.col(state)).drop("_was")
    return out.where((F.col("_was") == before) & (F.col(state) == after)).drop("_was")


NOON = 43200


def night_series(rows: DataFrame, keys: list[str], time: str, state: str = "night_mode", tie: list[str] | None = None,
                 turn: int = NOON) -> DataFrame:
    """Rows by night (``state`` 1) of the nights that have ended, with the number ``night`` of each.

    A night runs from ``turn`` to ``turn`` and has ended once a row by day
    follows its last one: the end event gives the series to stack."""
    number = lambda c: F.floor((F.col(c) - turn) / DAY).alias("night")
    line = previous(rows.select(*keys, time, state, *(tie or [])), keys, time, {state: "_was", time: "_at"}, tie)
    ended = line.where(f"_was = 1 and {state} = 0").select(*keys, number("_at")).distinct()
    return rows.where(F.col(state) == 1).select("*", number(time)).join(ended, [*keys, "night"], "left_semi")


def starts(rows: DataFrame, keys: list[str], time: str, label: Column, tie: list[str] | None = None) -> DataFrame:
    """First row of every run of equal labels, as gallery separators need."""
    out = previous(rows.withColumn("label", label), keys, time, {"label": "_was"}, tie)
    return out.where(F.col("_was").isNull() | (F.col("_was") != F.col("label"))).drop("_was")


def gaps(rows: DataFrame, keys: list[str], time: str, interval: int, tie: list[str] | None = None) -> DataFrame:
    """Rows more than ``interval`` seconds after the one before, with the gap."""
    out = previous(rows, keys, time, {time: "previous"}, tie)
    out = out.withColumn("gap", F.col(time) - F.col("previous"))
    return out.where(F.col("gap") > interval)


def rolling_mean(rows: DataFrame, keys: list[str], time: str, value: str, size: int = 10,
                 tie: list[str] | None = None, out: str = "rolling") -> DataFrame:
    """Mean of the last ``size`` values, fewer at the start."""
    line = _past(keys, [time, *(tie or [])]).rowsBetween(-(size - 1), 0)
    wide = with_history(rows, keys, time, size - 1, tie)
    return _fresh(wide.withColumn(out, F.avg(value).over(line)))


def ladder(start: Column, ev: float, index: Column) -> Column:
    """Exposure of the bracket's index-th frame; EV steps count whole."""
    return start / F.pow(F.lit(2.0), index * int(ev))


MIN_EXPOSURE = 0.000032


def bracket_prefix(frames: DataFrame, keys: list[str], index: str = "k", minimum: float = MIN_EXPOSURE,
                   most: int = 3) -> DataFrame:
    """Frames of each bracket that are taken: up to the first one that is not
    overexposed or falls under the minimum exposure.  Adds ``n_fused``: at
    most ``most``, one when none was overexposed."""
    line = W.partitionBy(*keys).orderBy(index)
    too_short = (F.col("exposure") < minimum) & (F.col(index) > 0)
    stop = (F.col("overexposed") == 0).cast("int")
    before = F.coalesce(F.sum(stop).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = F.max(too_short.cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0))
    taken = frames.withColumns({"_before": before, "_cut": cut}).where("_before = 0 and _cut = 0")
    whole = W.partitionBy(*keys)
    fused = F.when(F.sum("overexposed").over(whole) == 0, 1).otherwise(
        F.least(F.count(F.lit(1)).over(whole), F.lit(most)))
    return taken.withColumn("n_fused", fused.cast("int")).drop("_before", "_cut")

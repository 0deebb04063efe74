"""Nearest-in-time join in both directions, for any number of right sides at once.

All instants of the left and of every right side become one table with a row
per (by, time).  Buckets of time carry in the last right row before them and
the first after them; both come from a summary of buckets in two levels, so no
window spans a timeline, with or without ``by``, however long or hot it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noctule.session import stored

@dataclass(frozen=True)
class Lookup:
    """One right side: its time column, the columns to take and the order
    that decides between rows of equal time."""

    right: DataFrame
    time: str
    payload: list[str]
    position: list[str]
    tolerance: int | None = None
    matched_time: str = "matched_time"


def nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: list[str],
            position: list[str], by: list[str] | None = None, tolerance: int | None = None,
            bucket_seconds: int = 86400, matched_time: str = "matched_time") -> DataFrame:
    """Every left row with the ``payload`` of the right row closest in time.

    Ties go to the earlier time, then to the smallest ``position``.  Rows
    without a match closer than ``tolerance``, if given, keep NULLs.  Times are whole
    seconds; ``by`` columns must be present on both sides under one name."""
    lookup = Lookup(right, right_time, payload, position, tolerance, matched_time)
    return nearest_all(left, left_time, [lookup], by, bucket_seconds)


#: Buckets of a group of the summary.  Groups are carried within an era, which holds every time there is.
GROUP, ERA = 1024, 1 << 50


def nearest_all(left: DataFrame, left_time: str, lookups: list[Lookup], by: list[str] | None = None,
                bucket_seconds: int = 86400) -> DataFrame:
    """Several nearest joins at once: the timeline is laid out once, and the
    left table, the big one, is joined to the answers a single time."""
    by = by or []
    each = range(len(lookups))
    line = left.select(*by, F.col(left_time).cast("long").alias("_t"), F.lit(1).alias("_left"))
    for i, lookup in enumerate(lookups):
        rights = lookup.right.select(*by, F.col(lookup.time).cast("long").alias("_t"), F.struct(*lookup.payload).alias(f"_p{i}"), F.struct(*lookup.position).alias(f"_q{i}"))
        line = line.unionByName(rights, allowMissingColumns=True)
    # a hot instant is one row; of rights of equal time the first in document order wins
    instants = line.where("_t is not null").groupBy(*by, "_t").agg(F.max("_left").alias("_left"), *[F.min_by(f"_p{i}", f"_q{i}").alias(f"_p{i}") for i in each])
    instants = stored(instants.withColumn("_bucket", F.floor(F.col("_t") / bucket_seconds)), "instants")
    here = lambda i: F.when(F.col(f"_p{i}").isNotNull(), F.struct("_t", F.col(f"_p{i}").alias("_p")))
    at = lambda i: F.when(F.col(f"_p{i}").isNotNull(), F.col("_t"))

    buckets = instants.groupBy(*by, "_bucket").agg(F.max("_left").alias("_used"), *[c for i in each for c in (
        F.min_by(here(i), at(i)).alias(f"_head{i}"), F.max_by(here(i), at(i)).alias(f"_tail{i}"))])
    buckets = stored(buckets.withColumn("_group", F.floor(F.col("_bucket") / GROUP)), "buckets")
    carried = _carried(buckets, by, bucket_seconds, each)

    met = instants.join(carried, [*by, "_bucket"])
    back, ahead = (W.partitionBy(*by, "_bucket").orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc("_t"), F.desc("_t")))
    answers = met.select(*by, "_t", "_left", *[c for i in each for c in (
        F.coalesce(F.last(here(i), ignorenulls=True).over(back), f"_before{i}").alias(f"_before{i}"),
        F.coalesce(F.last(here(i), ignorenulls=True).over(ahead), f"_after{i}").alias(f"_after{i}"))]).where("_left = 1")
    names = {c: f"_by_{i}" for i, c in enumerate(by)} | {"_t": "_lt"}
    answers = answers.select(*by, "_t", *[c for i, lookup in enumerate(lookups) for c in _chosen(i, lookup)]).withColumnsRenamed(names)
    on = [F.col(left_time) == F.col("_lt")] + [F.col(c) == F.col(names[c]) for c in by]
    return left.join(answers, on, "left").drop(*names.values())


def _carried(buckets: DataFrame, by: list[str], bucket_seconds: int, each: range) -> DataFrame:
    """For each bucket with left rows the last right before it and the first after it, by lookup.

    They are sought among the buckets of its group and, where there is none,
    in what the groups before and after it end with.  Frames only grow, which
    costs one step per row; a group has ``GROUP`` rows at most, a century of
    days 36 groups."""
    era = F.floor((F.col("_group") * (GROUP * bucket_seconds) + ERA // 2) / ERA)

    def passed(keys: list[str], order: Column) -> WindowSpec:
        return W.partitionBy(*by, *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)

    def seek(keys: list[str], order: str) -> list[Column]:
        return [c for i in each for c in (F.last(f"_tail{i}", ignorenulls=True).over(passed(keys, F.asc(order))).alias(f"_before{i}"),
                                          F.last(f"_head{i}", ignorenulls=True).over(passed(keys, F.desc(order))).alias(f"_after{i}"))]

    place = lambda c: F.when(F.col(c).isNotNull(), F.col("_bucket"))
    groups = buckets.groupBy(*by, "_group").agg(*[c for i in each for c in (
        F.min_by(f"_head{i}", place(f"_head{i}")).alias(f"_head{i}"), F.max_by(f"_tail{i}", place(f"_tail{i}")).alias(f"_tail{i}"))])
    groups = groups.withColumn("_era", era).select(*by, "_group", *seek(["_era"], "_group"))
    groups = groups.withColumnsRenamed({f"_{side}{i}": f"_far_{side}{i}" for i in each for side in ("before", "after")})
    near = buckets.select(*by, "_group", "_bucket", "_used", *seek(["_group"], "_bucket")).where("_used = 1")
    return near.join(groups, [*by, "_group"]).select(*by, "_bucket", *[F.coalesce(f"_{side}{i}", f"_far_{side}{i}").alias(f"_{side}{i}") for i in each for side in ("before", "after")])


def _chosen(i: int, lookup: Lookup) -> list[Column]:
    """Time and payload of the nearer of the two rights around a left time."""
    before, after = F.col(f"_before{i}"), F.col(f"_after{i}")
    closer = after["_t"] - F.col("_t") < F.col("_t") - before["_t"]
    choice = F.when(before.isNull() | closer, after).otherwise(before)
    if lookup.tolerance is not None:
        choice = F.when(F.abs(choice["_t"] - F.col("_t")) < lookup.tolerance, choice)
    return [choice["_t"].alias(lookup.matched_time), *[choice["_p"][c].alias(c) for c in lookup.payload]]


def reject_invalid(rows: DataFrame, payload: list[str], floors: dict[str, float],
                   matched_time: str = "matched_time") -> DataFrame:
    """Blank a match whose value lies below its floor: the lookup failed, but
    the observation is kept."""
    ok = F.lit(True)
    for column, floor in floors.items():
        ok = ok & (F.col(column) >= floor)
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in [*payload, matched_time]})


def by_hour(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: list[str],
            position: list[str], by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join on the hour; the first right row of an hour counts."""
    by = by or []
    hours = stored(right.groupBy(*by, F.floor(F.col(right_time) / 3600).alias("_hour")).agg(
        F.min_by(F.struct(*payload), F.struct(*position)).alias("_p")))
    joined = left.withColumn("_hour", F.floor(F.col(left_time) / 3600)).join(hours, [*by, "_hour"], how)
    return joined.select(*left.columns, "_p.*")

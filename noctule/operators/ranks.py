"""Exact order statistics per group without sorting a group in one task.

Rounds of binning narrow down the interval that holds a wanted rank.  The first
round bins by sign and logarithm, so that values of any size are told apart;
every later one cuts an interval into equal parts.  Bins keep the order of the
values, so an interval is known by its least and greatest value, and rounds end
once it holds few rows or a single value.  What is left is ranked value by value.

Every round is a partial aggregate, so what is shuffled is counts, and a group
that holds most of the table is still counted by all tasks.  No window sees
more than a round's bins of a group.  Two or three column-pruned scans replace
a sort of all values.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noctule.session import stored

Rank = Callable[[Column], Column]

#: Bins of a later round, and of one doubling in the first, which tells apart values down to FINEST.
BINS, PER_DOUBLING, FINEST = 4096, 64, 2.0 ** -20
#: An interval of so many rows is ranked value by value.
FEW = 4096
#: An interval spans 1/64 of a value at most, and a double has 53 bits: four rounds of 4096 parts separate any two.
ROUNDS = 6


def rank_values(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """Per group: ``n`` and, per named rank, the value at that 1-based rank.

    ``ranks`` maps a name to a function of the group size.  Values may be of
    any size and sign.  NULL and NaN must be filtered out by the caller."""
    source = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    size = F.count(F.lit(1)).alias("_n")
    ends = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    doubling = F.signum("_v") * F.log2(1.0 + F.abs("_v") / FINEST)
    counts = source.withColumn("_b", F.floor(doubling * PER_DOUBLING)).groupBy(*keys, "_b").agg(size, *ends)
    counts = counts.select("*", F.sum("_n").over(W.partitionBy(*keys)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("long").alias("_rank")) for name, rank in ranks.items()])
    line = [*keys, "n", "_name"]
    found = stored(_locate(counts.select("*", F.inline(wanted)), line, "_b").drop("_b"), "ranks")

    open_ = (F.col("_n") > FEW) & (F.col("_lo") < F.col("_hi"))
    for _ in range(ROUNDS):
        if found.where(open_).isEmpty():
            break
        inside = _inside(source, found.where(open_), keys)
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*line, "_rank", part.alias("_b")).agg(size, *ends)
        found = stored(_locate(counts, line, "_b").drop("_b").unionByName(found.where(~open_)), "ranks")

    inside = _inside(source, found.where("_lo < _hi"), keys)
    single = _locate(inside.groupBy(*line, "_rank", "_v").agg(size), line, "_v")
    whole = single.select(*line, "_v").unionByName(found.where("_lo = _hi").select(*line, F.col("_lo").alias("_v")))
    return whole.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def _inside(source: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Values within the interval of each wanted rank of their group."""
    return source.join(found.drop("_n"), keys).where("_v BETWEEN _lo AND _hi")


def _locate(counts: DataFrame, line: list[str], order: str) -> DataFrame:
    """The counted row in which ``_rank`` falls; the rank is made relative."""
    upto = F.sum("_n").over(W.partitionBy(*line).orderBy(order))
    before = F.col("_upto") - F.col("_n")
    return (counts.select("*", upto.alias("_upto")).where((F.col("_upto") >= F.col("_rank")) & (before < F.col("_rank")))
            .withColumn("_rank", F.col("_rank") - before).drop("_upto"))


def median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, n, median)``; an even group averages its two middle values."""
    middle = rank_values(rows, keys, value, {
        "_low": lambda n: F.floor((n + 1) / 2),
        "_high": lambda n: F.floor(n / 2) + 1,
    })
    return middle.select(*keys, "n", ((F.col("_low") + F.col("_high")) * 0.5).alias("median"))


def lowest_mean(rows: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """``(keys, n, mean)`` of the lowest ``fraction`` of values, one at least."""
    cut = rank_values(rows, keys, value, {
        "_cut": lambda n: F.greatest(F.floor(n * fraction), F.lit(1))})
    cut = stored(cut.withColumn("_k", F.greatest(F.floor(F.col("n") * fraction), F.lit(1))), "cut")
    below = rows.join(cut, keys).groupBy(*keys, "n", "_k", "_cut").agg(
        F.sum(F.when(F.col(value) < F.col("_cut"), F.col(value)).otherwise(0.0)).alias("_s"),
        F.count_if(F.col(value) < F.col("_cut")).alias("_below"))
    mean = (F.col("_s") + (F.col("_k") - F.col("_below")) * F.col("_cut")) / F.col("_k")
    return below.select(*keys, "n", mean.alias("mean"))

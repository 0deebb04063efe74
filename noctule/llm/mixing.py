"""Mix sources to target weights by weighted sampling without replacement.

Every row gets the Efraimidis-Spirakis key ``u ** (1 / quality)``, u being a
hash of its identity; it is held as its logarithm, which does not underflow.  A
source's rows are taken from the largest key down until their sizes reach the
source's budget.  A budget above the source's
size first takes whole epochs, and the keys settle the rest.

No source is sorted.  Keys are monotone, so key bins per source are
summed (partial aggregates), the running sum finds the one bin in which the
budget ends, and only that bin's keys are sorted.  Rows then compare their
key with the source's last taken key.  A source with a third of all rows costs
its share of a scan.  Tables of one row per source are all that is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctule.llm import text as T
from noctule.session import stored

#: Key bins for each doubling of ``-log(u) / quality``: a bin has at most 1 / 16,000 of the rows of any quality.
BINS = 4096
#: Resolution of the uniform numbers: 52 bits of a hash, never 0 or 1.
STEPS = 2**52


def sampling_key(digest: Column, quality: Column) -> Column:
    """log(u) / quality with u from a hexadecimal digest, below 0; larger is earlier."""
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(STEPS)
    return F.greatest(F.log(u) / quality, F.lit(-1e308))


def key_bin(key: Column) -> Column:
    """Bins of equal ratio, the largest keys first, so that every quality is spread alike."""
    return F.floor(F.log2(-key) * BINS).cast("int")


def identity(key: Column, text: Column) -> Column:
    """Digest of a document: of its key and text, so that NULL keys do not meet."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))


def word_share(text: Column) -> Column:
    """Quality weight in (0, 1]: words against words and markup symbols."""
    n, marks = T.n_words(text), F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return F.when(n > 0, n / (n + marks)).otherwise(1.0)


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Share the total of ``source_size`` by weight, at most ``most`` times each source's size.

    ``sizes`` has one row per source.  Sources in code point order, NULL last,
    take the weights in turn.  Ordered by cap / weight, the capped sources are
    a prefix; the level of the first one left sets all others.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("_rank") % len(weights) + 1)) \
        .withColumn("_cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("_weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = weighted.withColumn("_total", F.sum("source_size").over(everything)) \
        .withColumn("_level", (F.col("_total") - before) / behind)
    capped = level.withColumn("_full", F.min(F.col("_cap") <= F.col("_level") * F.col("_weight"))
                              .over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    water = F.min(F.when(~F.col("_full"), F.struct("_rank_fill", "_level"))).over(everything)["_level"]
    return capped.withColumn("_rank_fill", F.row_number().over(filling)).withColumn("_water", water) \
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_water"))) \
        .select("_source", "source_size", "target")


def mix(rows: DataFrame, source: str, size: Column, digest: Column, quality: Column,
        weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Add size, source_size, target and taken (size times repeats) to all rows.

    The row on which the budget ends is taken if that brings the source nearer
    to its target.  Columns of these names are replaced.  NULL sources are one
    source; rows of size 0 take nothing; rows with equal keys share their fate,
    so exact repeats of a row are taken together; an empty table gives none.
    ``quality`` must be positive.  Results depend on the rows only.
    """
    keep = [c for c in rows.columns if c not in ("size", "source_size", "target", "taken")]
    keyed = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{source}`").alias("_source"), size.alias("size"),
                        sampling_key(digest, quality).alias("_key"))
    keyed = keyed.withColumn("_bin", key_bin(F.col("_key")))
    same = F.col("_source").eqNullSafe
    bins = stored(keyed.groupBy("_source", "_bin").agg(F.sum("size").alias("_size")), "mix-bins")
    goal = targets(bins.groupBy("_source").agg(F.sum("_size").alias("source_size")), weights, most) \
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    goal = stored(goal, "mix-goal").withColumnRenamed("_source", "_of")
    running = bins.withColumn("_upto", F.sum("_size").over(Window.partitionBy("_source").orderBy("_bin")))
    ends = running.join(goal, same(F.col("_of"))).where(F.col("_upto") > F.col("_rest")).groupBy("_of") \
        .agg(F.min(F.struct("_bin", F.expr("_upto - _size AS _before"))).alias("_end")).select("_of", "_end.*")
    goal = stored(goal.join(ends.withColumnRenamed("_of", "_at"), F.col("_of").eqNullSafe(F.col("_at")), "left")
                  .withColumnRenamed("_bin", "_last").drop("_at"), "mix-ends")
    inside = keyed.join(goal, same(F.col("_of")) & (F.col("_bin") == F.col("_last"))) \
        .groupBy("_of", "_key", "_rest", "_before").agg(F.sum("size").alias("_size")) \
        .withColumn("_upto", F.sum("_size").over(Window.partitionBy("_of").orderBy(F.desc("_key"))) + F.col("_before"))
    floor = inside.where(2 * F.col("_upto") - F.col("_size") < 2 * F.col("_rest")).groupBy("_of") \
        .agg(F.min("_key").alias("_least")).withColumnRenamed("_of", "_at")
    goal = stored(goal.join(floor, F.col("_of").eqNullSafe(F.col("_at")), "left").drop("_at"), "mix-floor")
    chosen = (F.col("_bin") < F.col("_last")) | ((F.col("_bin") == F.col("_last")) & (F.col("_key") >= F.col("_least")))
    return keyed.join(goal, same(F.col("_of"))) \
        .withColumn("taken", F.col("size") * (F.col("_epochs") + F.when(chosen, 1).otherwise(0))) \
        .select(*(F.col(f"`{c}`") for c in keep), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))

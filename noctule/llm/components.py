"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctule.llm.tables import settled


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the least of its neighbours and itself."""
    every = both_ways(edges)
    least = every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return every.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of edges (a, b) with a smaller node in its component.

    Rounds grow with the logarithm of a component's size.  A star's centre is
    a hot key of joins only, which adaptive execution splits.
    """
    edges = settled(edges.where("a <> b").select("a", "b").distinct(), "stars")
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = settled(small_star(large_star(edges)), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))

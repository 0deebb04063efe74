"""Predicates with particular rules about missing or empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_if_missing(value: Column, lo, hi) -> Column:
    """In the range, or unknown."""
    return value.isNull() | value.between(lo, hi)


def with_sidecar(captures: DataFrame, sidecars: DataFrame, key: list[str]) -> DataFrame:
    """Captures with their sidecar; one without stays."""
    return captures.join(sidecars, key, "left")


def filter_or_all(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows that pass, or all of them when none does."""
    hits = rows.where(predicate).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.where(predicate | (hits == 0))

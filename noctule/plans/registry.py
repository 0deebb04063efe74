"""Register of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, root: str) -> DataFrame:
            # times are UTC throughout
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r6(column: Column | str, name: str | None = None) -> Column:
    """Round for comparison; adding 0 turns -0 into 0."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + 0.0).alias(name or column)


def s6(expression: str, name: str) -> str:
    """The SQL twin of ``r6``."""
    return f"round({expression}, 6) + 0e0 AS {name}"

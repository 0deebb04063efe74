"""Intermediate tables and session settings of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noctule.session import stored

#: Arrow batches end at this many bytes, so that long texts do not pile up in a Python worker.
BATCH_BYTES = "16777216"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored``, after which the shuffle files of the job that wrote it are removed.

    The table in the shared folder replaces them: a lost executor takes
    nothing with it that is still needed.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(CLEANUP, before)

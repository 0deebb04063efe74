"""Ingest, de-duplication, windows, running stacks and snapshots.

``run`` drives a stream over what is there now and returns what it wrote;
``start`` with an interval polls, as a deployment does.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noctule.session import scratch_path
from noctule.streaming.state import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def files(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*.parquet",
          files_per_batch: int = 1000) -> DataFrame:
    """Stream of parquet files dropped into a folder.  The number of files per
    micro-batch bounds what one step of a stateful operator has to hold."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(root)


def start(stream: DataFrame, name: str, mode: str = "append", partition_by: list[str] | None = None,
          batch: Callable[[DataFrame, int], None] | None = None, target: str | None = None,
          checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Start a stream: polling ``every`` interval, or once over what is there.

    Appends go to a parquet sink, which is exactly-once by itself; ``batch``
    replaces that sink.  Give ``target`` and ``checkpoint`` to go on later."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch_path(spark, name + "-checkpoint"))
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        if batch is not None:
            return writer.foreachBatch(batch).start()
        writer = writer.format("parquet").option("path", target or scratch_path(spark, name))
        return (writer.partitionBy(*partition_by) if partition_by else writer).start()
    finally:
        # the running stream has its own copy of the settings
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, name: str, target: str | None = None, **options) -> DataFrame | None:
    """Process everything available, stop, and return what was appended."""
    target = target or scratch_path(stream.sparkSession, name)
    start(stream, name, target=target, **options).awaitTermination()
    if options.get("batch") is not None:
        return None
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def versions(target: str) -> Callable[[DataFrame, int], None]:
    """Sink for updates: each micro-batch has a folder of its own, so a
    repeated batch overwrites itself."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def newest(spark: SparkSession, target: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Latest update per key of a ``versions`` folder."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(full).parquet(target)
    fields = [c for c in schema.fieldNames() if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_r"))
    return picked.select(*keys, "_r.*")


def dedup(rows: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """First arrival per key; keys are remembered for ``delay``."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def hourly(rows: DataFrame, time: str, delay: str, keys: list[str], *aggregates) -> DataFrame:
    """Tumbling hours; an hour is emitted once the watermark has passed it and
    rows later than that are dropped (and counted by the engine)."""
    window = F.window(time, "1 hour")
    out = rows.withWatermark(time, delay).groupBy(window, *keys).agg(*aggregates)
    return out.select(F.unix_seconds("window.start").alias("hour"), *[c for c in out.columns if c != "window"])


def sessions(rows: DataFrame, time: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Runs of captures without a pause of ``gap``; what lies between two runs
    is an outage."""
    out = rows.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(
        F.count(F.lit(1)).alias("captures"))
    return out.select(*keys, F.unix_seconds("s.start").alias("first"), F.unix_seconds("s.end").alias("until"), "captures")


def running_stack(frames: DataFrame) -> DataFrame:
    """Totals per pixel that grow with every frame; use update mode."""
    return frames.groupBy("series", "x", "y", "c").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


def latest_sink(spark: SparkSession, target: str, key: list[str], order: list[str],
                schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """Keeps one newest row per key: each batch merges its own newest rows with
    the snapshot before it and writes the next snapshot."""
    from noctule.sources.measurements import latest

    def write(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        merged = latest(rows, key, order)
        if batch_id > 0:  # a lost snapshot stops the stream: it must not be taken for an empty one
            before = session.read.schema(schema).parquet(f"{target}/snapshot={batch_id - 1}")
            merged = latest(merged.unionByName(before), key, order)
        merged.write.mode("overwrite").parquet(f"{target}/snapshot={batch_id}")

    return write


def snapshot(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The newest snapshot written by ``latest_sink``."""
    full = T.StructType([*schema.fields, T.StructField("snapshot", T.LongType())])
    rows = spark.read.schema(full).parquet(target)
    newest_id = rows.agg(F.max("snapshot")).scalar()
    return rows.where(F.col("snapshot") == newest_id).drop("snapshot")

"""Sinks of ``foreachBatch`` whose effect is the same however often a batch is repeated.

A batch writes files of its own, told apart by its id, and is then entered in a
log.  What it reads and what readers see are the batches in the log, so a batch
that was cut off between write and log leaves nothing behind: its repetition
overwrites the same files.  A batch that is in the log already changes nothing.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noctule.functions import text
from noctule.operators import stack
from noctule.sources.measurements import first_arrival

Sink = Callable[[DataFrame, int], None]
DYNAMIC = {"partitionOverwriteMode": "dynamic"}


class BatchLog:
    """Ids of the batches whose writes are complete.  A stream numbers its batches in order, so the last one says it all."""

    def __init__(self, root: str):
        self.path = f"{root}/log"

    def last(self, spark: SparkSession) -> int:
        """The last complete batch, -1 before the first."""
        try:
            found = spark.read.schema("id long").parquet(self.path).agg(F.max("id")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return -1 if found is None else found

    def enter(self, spark: SparkSession, batch_id: int) -> None:
        spark.range(batch_id, batch_id + 1, 1, 1).write.mode("append").parquet(self.path)


# --- one row per key, for good -----------------------------------------------

def inserted(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows of the table that ``insert_sink`` keeps, with their ``day``."""
    return _upto(spark, root, schema, BatchLog(root).last(spark))


def _upto(spark: SparkSession, root: str, schema: T.StructType, last: int) -> DataFrame:
    if last < 0:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("day", T.DateType())]))
    whole = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(f"{root}/rows").where(F.col("batch") <= last).drop("batch")


def insert_sink(root: str, key: list[str], arrival: Column, time: str = "timestamp") -> Sink:
    """Inserts rows whose key is new; of rows of one batch the first by ``arrival``.

    ``time`` is in ``key`` or follows from it, so that rows of one key fall on
    one day: a batch reads the keys of the days it touches and of no others.
    """
    log = BatchLog(root)

    def write(rows: DataFrame, batch_id: int) -> None:
        spark, schema = rows.sparkSession, rows.schema
        last = log.last(spark)
        if batch_id <= last:
            return
        dated = first_arrival(rows, key, arrival).withColumn("day", text.epoch_to_day(F.col(time)))
        # a row per day of the calendar at most
        days = [r["day"] for r in rows.select(text.epoch_to_day(F.col(time)).alias("day")).distinct().toLocalIterator()]
        there = _upto(spark, root, schema, last).where(F.col("day").isin(days)).select(*key)
        fresh = dated.join(there, key, "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
        fresh.hint("rebalance", "day").write.mode("overwrite").options(**DYNAMIC).partitionBy("day", "batch").parquet(f"{root}/rows")
        log.enter(spark, batch_id)

    return write


# --- running totals -----------------------------------------------------------

class Totals:
    """Running aggregates by key as partial results of batches, folded every ``every`` batches.

    ``merge`` maps a column to how two partial results of it are one: sum, min
    or max.  A batch writes what its own rows give; every ``every``-th batch
    writes the sum of all before it as the next snapshot.  Readers take the
    newest snapshot and the batches after it, ``every`` folders at most, and
    order of arrival makes no difference.
    """

    def __init__(self, root: str, keys: list[str], merge: dict[str, str], schema: T.StructType, every: int = 8):
        self.root, self.keys, self.merge, self.schema, self.every = root, keys, merge, schema, every
        self.log = BatchLog(root)

    def folded(self, parts: DataFrame) -> DataFrame:
        rules = {"sum": F.sum, "min": F.min, "max": F.max}
        return parts.groupBy(*self.keys).agg(*[rules[how](c).cast(self.schema[c].dataType).alias(c) for c, how in self.merge.items()])

    def folders(self, last: int) -> list[str]:
        """What holds all batches up to ``last``: a snapshot follows every ``every`` batches."""
        snapshot = (last + 1) // self.every * self.every
        return [*([f"{self.root}/snapshot={snapshot}"] if snapshot else []), *(f"{self.root}/batch={i}" for i in range(snapshot, last + 1))]

    def parts(self, spark: SparkSession, last: int) -> DataFrame:
        folders = self.folders(last)
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.folded(self.parts(spark, self.log.last(spark)))

    def sink(self, aggregate: Callable[[DataFrame], DataFrame]) -> Sink:
        def write(rows: DataFrame, batch_id: int) -> None:
            spark = rows.sparkSession
            if batch_id <= self.log.last(spark):
                return
            aggregate(rows).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
            if (batch_id + 1) % self.every == 0:
                own = spark.read.schema(self.schema).parquet(f"{self.root}/batch={batch_id}")
                whole = self.folded(self.parts(spark, batch_id - 1).unionByName(own))
                whole.write.mode("overwrite").parquet(f"{self.root}/snapshot={batch_id + 1}")
            self.log.enter(spark, batch_id)

        return write


# --- the job at the end of a night --------------------------------------------

NIGHT = "station long, night long"
STACK = "series string, x int, y int, c int, n_frames long, v int"


def night_sink(root: str, frames: Callable[[], DataFrame], mode: str = "avg") -> Sink:
    """Stacks the nights that a batch of ``state.ended_nights`` tells of, each once.

    ``frames`` gives the frames of all nights (series, station, night, seq, x,
    y, c, v), of which only those of newly ended nights are stacked.  A night
    that an earlier batch has stacked is left out; a repeated batch overwrites
    its own folders.
    """
    log = BatchLog(root)

    def write(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        last = log.last(spark)
        if batch_id <= last:
            return
        told = events.where("given AND NOT late").select("station", "night").distinct()
        told.join(_stored(spark, root, "ended", NIGHT, last), ["station", "night"], "left_anti").write.mode("overwrite").parquet(f"{root}/ended/batch={batch_id}")
        ended = spark.read.schema(NIGHT).parquet(f"{root}/ended/batch={batch_id}")
        own = frames().join(ended, ["station", "night"], "left_semi")
        stack.stack(own, mode).write.mode("overwrite").parquet(f"{root}/stacks/batch={batch_id}")
        log.enter(spark, batch_id)

    return write


def _stored(spark: SparkSession, root: str, name: str, schema: str, last: int) -> DataFrame:
    if last < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", batch long").parquet(f"{root}/{name}").where(F.col("batch") <= last).drop("batch")


def stacks(spark: SparkSession, root: str) -> DataFrame:
    """Stacks of the nights that have ended so far."""
    return _stored(spark, root, "stacks", STACK, BatchLog(root).last(spark))

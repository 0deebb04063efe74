"""Media archive: listings, frame lists, storage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctule.functions import text


def list_files(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """Recursive listing ``(path, length, modified)``; contents are not read
    because the column is pruned."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def path_stamp(path: Column, kind: str = "video", suffix: str = ".mp4") -> Column:
    """The 14-digit time in ``<kind>-YYYYMMDDhhmmss<suffix>``, else NULL."""
    pattern = kind + r"-([0-9]{14})" + suffix.replace(".", r"\.")
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def path_day(path: Column) -> Column:
    """The day folder a file lies in, whatever stands before it."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)([0-9]{8})/[^/]*$", 1), F.lit(""))


def listing(files: DataFrame, suffix: str = ".mp4", path: str = "path") -> DataFrame:
    """Files of one type with the day and time their path names."""
    stamp = path_stamp(F.col(path), suffix=suffix)
    return (files.where(F.lower(F.col(path)).endswith(suffix))
            .withColumn("day_text", path_day(F.col(path)))
            .withColumn("stamp", stamp)
            .withColumn("taken", text.stamp_to_epoch(stamp)))


def slice_names(names: DataFrame, column: str, prefix: str, suffix: str, drop: int) -> DataFrame:
    """Names with the prefix and suffix, cut to what lies between the first
    ``drop`` characters and the suffix."""
    name = F.col(column)
    keep = names.where(name.startswith(prefix) & name.endswith(suffix))
    return keep.withColumn("slice", F.substring(name, F.lit(drop + 1), F.length(name) - drop - len(suffix)))


def newest_first(files: DataFrame, path: str = "path") -> DataFrame:
    """Dated files by time, then the undated ones by name, all descending."""
    return files.orderBy(F.coalesce(path_stamp(F.col(path)), F.lit("")).desc(), F.col(path).desc())


def frame_list(texts: DataFrame, series: str, body: str = "text") -> DataFrame:
    """Line-per-path texts to an ordered manifest ``(series, seq, path)``."""
    lines = texts.select(F.col(series).alias("series"),
                         F.posexplode(F.filter(F.transform(F.split(body, "\n"), lambda line: F.trim(line)),
                                               lambda s: F.length(s) > 0)).alias("seq", "path"))
    return lines


def usage(files: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes and share of the total per key."""
    per_key = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"),
                                       F.sum("length").alias("bytes"))
    total = per_key.agg(F.sum("bytes").alias("_total")).scalar()
    return per_key.withColumn("share", F.try_divide(F.col("bytes").cast("double"), total))

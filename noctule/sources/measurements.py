"""Day-partitioned measurement tables: scan, insert, latest row, export."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctule import schemas
from noctule.functions import text

KEY = ["station", "timestamp"]


def day_predicate(start: int, end: int, day: str = "day") -> Column:
    """Days that overlap an inclusive epoch range.  The engine does not derive
    it from the timestamp bounds, so it is spelled out for partition pruning."""
    first = dt.datetime.fromtimestamp(start, dt.timezone.utc).date()
    last = dt.datetime.fromtimestamp(end, dt.timezone.utc).date()
    return F.col(day).between(F.lit(first), F.lit(last))


def scan(spark: SparkSession, root: str, kind: str, start: int, end: int) -> DataFrame:
    """Rows of one measurement table within an inclusive epoch range."""
    table = spark.read.schema(schemas.MEASUREMENTS[kind]).parquet(f"{root}/{kind}")
    return table.where(day_predicate(start, end) & F.col("timestamp").between(start, end))


def scan_day(spark: SparkSession, root: str, kind: str, day: str) -> DataFrame:
    table = spark.read.schema(schemas.MEASUREMENTS[kind]).parquet(f"{root}/{kind}")
    return table.where(F.col("day") == F.lit(dt.date.fromisoformat(day)))


def first_arrival(rows: DataFrame, key: list[str], arrival: Column) -> DataFrame:
    """One row per key, the earliest by ``arrival``.  An aggregate, so repeats
    of a hot key collapse before the shuffle."""
    picked = rows.groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(c) for c in rows.columns]), arrival).alias("_row"))
    return picked.select("_row.*")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str] = KEY,
                     arrival: Column | None = None) -> DataFrame:
    """Incoming rows whose key is neither stored nor repeated earlier."""
    fresh = first_arrival(incoming, key, arrival if arrival is not None else F.col(key[-1]))
    return fresh.join(existing.select(*key), key, "left_anti")


def append(rows: DataFrame, root: str, kind: str, mode: str = "append") -> None:
    """Write rows below one folder per UTC day, time-sorted within files.

    ``rebalance`` lets the adaptive planner split an oversized day over several
    files and merge tiny ones."""
    out = rows.withColumn("day", text.epoch_to_day(F.col("timestamp")))
    out = out.select(*schemas.MEASUREMENTS[kind].fieldNames())
    (out.hint("rebalance", "day").sortWithinPartitions("day", "timestamp")
        .write.mode(mode).partitionBy("day").parquet(f"{root}/{kind}"))


def insert(spark: SparkSession, rows: DataFrame, root: str, kind: str,
           arrival: Column | None = None) -> None:
    """Append the rows that are new to the stored table.

    Of a long history only the rows' own days are listed, and of these only
    the row groups between the rows' first and last time are read: files are
    sorted by time.  An anti join prunes nothing by itself."""
    days = rows.select(text.epoch_to_day(F.col("timestamp")).alias("day")).distinct()
    first, last, begin, end = rows.agg(F.min(text.epoch_to_day(F.col("timestamp"))), F.max(text.epoch_to_day(F.col("timestamp"))), F.min("timestamp"), F.max("timestamp")).first()
    try:
        existing = spark.read.schema(schemas.MEASUREMENTS[kind]).parquet(f"{root}/{kind}")
        existing = existing.where(F.col("day").between(F.lit(first), F.lit(last)) & F.col("timestamp").between(begin, end)).join(days, "day", "left_semi").select(*KEY)
    except AnalysisException as error:  # the first write finds no folder yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = spark.createDataFrame([], "station long, timestamp long")
    append(insert_if_absent(existing, rows, KEY, arrival), root, kind)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; ties go to the later ``order`` columns."""
    newest = rows.groupBy(*key).agg(
        F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def write_latest(rows: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    latest(rows, key, order).write.mode("overwrite").json(path)


# Decimals kept per exported field.
SIDECAR_DECIMALS = {
    **{f"exposure_t{i}": 6 for i in range(schemas.BRACKET_SIZE)},
    **{f"sigma_noise_t{i}": 6 for i in range(schemas.BRACKET_SIZE)},
    "gain": 0, "focus": 2, "sensor_temperature": 1, "temperature": 1, "humidity": 0,
    "pressure": 2, "mean_brightness": 2, "target_brightness": 2, "sqm": 1,
    "sun_altitude": 1, "moon_altitude": 1, "moon_phase_percentage": 0,
}
METEO_DECIMALS = {
    "temperature": 1, "humidity": 0, "dew_point": 1, "pressure_msl": 1,
    "surface_pressure": 1, "cloud_cover": 0, "cloud_low": 0, "cloud_mid": 0,
    "cloud_high": 0, "visibility": 0, "wind_speed_10m": 1, "wind_dir_10m": 0,
    "wind_speed_300hPa": 1,
}
AURORA_DECIMALS = {
    "probability_avg": 1, "kp_index": 1, "bt": 1, "bz": 1, "density": 1, "speed": 0,
    "temperature": 0,
}


def rounded(columns: list[str], decimals: dict[str, int]) -> list[Column]:
    return [F.round(F.col(c), decimals[c]).alias(c) if c in decimals else F.col(c) for c in columns]


def export_json(rows: DataFrame, decimals: dict[str, int], doc: str = "doc",
                keep: list[str] | None = None) -> DataFrame:
    """Each row as one JSON document with fields rounded per table rules."""
    keep = keep or []
    fields = [c for c in rows.columns if c not in keep]
    return rows.select(*keep, F.to_json(F.struct(*rounded(fields, decimals))).alias(doc))


def history(rows: DataFrame, start: int, end: int, descending: bool = False, **filters) -> DataFrame:
    """Captures in an inclusive time range with optional filters
    ``night_mode, hdr, sqm_min, sqm_max, stars_min, stars_max``.

    A filter that is not a number is ignored; without one, rows pass."""
    predicate = F.col("timestamp").between(start, end)
    if "day" in rows.columns:
        predicate = predicate & day_predicate(start, end)
    for name, value in filters.items():
        number = _number(value)
        if number is None:
            continue
        column, _, bound = name.rpartition("_") if name.endswith(("_min", "_max")) else (name, "", "")
        test = {"": F.col(column) == number, "min": F.col(column) >= number,
                "max": F.col(column) <= number}[bound]
        predicate = predicate & test
    order = F.col("timestamp").desc() if descending else F.col("timestamp").asc()
    return rows.where(predicate).orderBy(order)


def _number(value) -> float | None:
    try:
        number = None if value is None else float(value)
    except ValueError:
        return None
    return number if number is not None and math.isfinite(number) else None


def split_valid_times(rows: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable 14-digit start and end, and the others with the
    reason they were set aside."""
    checked = rows.select("*", text.stamp_to_epoch(F.col(start)).alias("start_ts"),
                          text.stamp_to_epoch(F.col(end)).alias("end_ts"))
    missing = F.col(start).isNull() | F.col(end).isNull() | (F.col(start) == "") | (F.col(end) == "")
    reason = (
        F.when(missing, "missing")
        .when(F.col("start_ts").isNull() | F.col("end_ts").isNull(), "invalid")
        .when(F.col("start_ts") > F.col("end_ts"), "reversed")
    )
    checked = checked.withColumn("reason", reason)
    return (checked.where("reason is null").drop("reason"), checked.where("reason is not null"))


# Chart series per table, series name -> (column, divisor).
IMAGE_SERIES = {c: (c, 1.0) for c in
                ["exposure", "gain", "noise", "sqm", "stars", "focus", "hdr", "brightness",
                 "mean_r", "mean_g", "mean_b"]}
METEO_SERIES = {c: (c, 1000.0 if c == "visibility" else 1.0) for c in schemas.METEO_COLUMNS[1:]}
AURORA_SERIES = {c: (c, 1.0) for c in schemas.AURORA_COLUMNS[1:]}


def chart_series(rows: DataFrame, ids: list[str], series: dict[str, tuple[str, float]]) -> DataFrame:
    """Wide measurements to long ``(series, value)`` rows, scaled for display."""
    scaled = rows.select(*ids, *[(F.col(c).cast("double") / d).alias(name)
                                 for name, (c, d) in series.items()])
    return scaled.unpivot(ids, list(series), "series", "value")

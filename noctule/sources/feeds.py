"""Readers that turn feed documents (one JSON text per row) into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule import schemas

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SQL_TIME = "yyyy-MM-dd HH:mm:ss"


def _epoch(value: Column, pattern: str) -> Column:
    return F.unix_seconds(F.try_to_timestamp(value, F.lit(pattern)))


def read_sidecars(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Capture sidecars; the per-exposure families become arrays."""
    flat = docs.select(F.from_json(doc, schemas.SIDECAR).alias("_d")).select("_d.*")
    families = ["exposure", "sigma_noise"]
    members = [f"{f}_t{i}" for f in families for i in range(schemas.BRACKET_SIZE)]
    return flat.select(
        *[c for c in flat.columns if c not in members],
        *[F.array(*[F.col(f"{f}_t{i}") for i in range(schemas.BRACKET_SIZE)]).alias(f"{f}s")
          for f in families],
    )


def read_stars(docs: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """Star list documents to one row per position."""
    parsed = docs.select(*keep, F.from_json(doc, schemas.STARS)["stars"].alias("_s"))
    return parsed.select(*keep, F.posexplode("_s").alias("pos", "_p")).select(*keep, "pos", "_p.x", "_p.y")


def read_grid(docs: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """Aurora probability grids.

    A document lacking one of its three members yields nothing; entries
    shorter than three numbers are skipped but keep their position."""
    parsed = docs.select(*keep, F.from_json(doc, schemas.GRID_DOCUMENT).alias("_d"))
    parsed = parsed.where(F.col("_d.`Observation Time`").isNotNull()
                          & F.col("_d.`Forecast Time`").isNotNull()
                          & F.col("_d.coordinates").isNotNull())
    rows = parsed.select(
        *keep,
        _epoch(F.col("_d.`Observation Time`"), ISO).alias("obs_time"),
        _epoch(F.col("_d.`Forecast Time`"), ISO).alias("forecast_time"),
        F.posexplode("_d.coordinates").alias("pos", "_e"),
    ).where(F.size("_e") >= 3)
    return rows.select(*keep, "obs_time", "forecast_time", "pos",
                       F.col("_e")[0].alias("lon"), F.col("_e")[1].alias("lat"),
                       F.floor(F.col("_e")[2]).cast("int").alias("val"))


# Header-row tables, column -> (header name, fallback position).
KP_TABLE = {"kp_index": ("Kp", 1)}
MAG_TABLE = {"bt": ("bt", 2), "bz": ("bz_gsm", 4)}
PLASMA_TABLE = {"density": ("density", 1), "speed": ("speed", 2), "temperature": ("temperature", 3)}
MIN_WIDTH = {"kp": 2, "mag": 6, "plasma": 5}


def read_header_rows(docs: DataFrame, keep: list[str], columns: dict[str, tuple[str, int]],
                     min_width: int, doc: str = "doc", by_position: bool = False) -> DataFrame:
    """Tables sent as an array of string arrays with a header row first.

    Columns are found by header name, else by position.  Rows that are too
    short or whose time does not parse are skipped."""
    parsed = docs.select(*keep, F.from_json(doc, schemas.HEADER_ROWS).alias("_t"))
    rows = parsed.select(*keep, F.col("_t")[0].alias("_h"), F.posexplode("_t").alias("pos", "_r"))
    rows = rows.where((F.col("pos") > 0) & (F.size("_r") >= min_width))

    def cell(name: str, position: int) -> Column:
        fallback = F.lit(position + 1)
        if by_position:
            index = fallback
        else:
            found = F.array_position("_h", name)
            index = F.when(found > 0, found).otherwise(fallback).cast("int")
        return F.try_element_at("_r", index).try_cast("double")

    out = rows.select(*keep, "pos", _epoch(F.col("_r")[0], SQL_TIME).alias("timestamp"),
                      *[cell(*spec).alias(c) for c, spec in columns.items()])
    return out.where("timestamp is not null")


def read_hourly(docs: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """Columnar hourly weather documents; a missing or short array is NULL."""
    d = F.from_json(doc, schemas.HOURLY_DOCUMENT)["hourly"]
    parsed = docs.select(*keep, d.alias("_h")).where(F.col("_h.time").isNotNull())
    rows = parsed.select(*keep, "_h", F.posexplode("_h.time").alias("pos", "_time"))
    return rows.select(
        *keep, "pos", _epoch(F.col("_time"), "yyyy-MM-dd'T'HH:mm").alias("timestamp"),
        *[F.get(F.col(f"_h.{array}"), F.col("pos")).alias(column)
          for array, column in schemas.HOURLY_FIELDS.items()],
    )


def read_detections(docs: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    parsed = docs.select(*keep, F.from_json(doc, schemas.DETECTIONS).alias("_d"))
    return parsed.select(*keep, "_d.image", F.explode("_d.objects").alias("_o")).select(*keep, "image", "_o.*")


def read_scores(docs: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    parsed = docs.select(*keep, F.from_json(doc, schemas.SCORES).alias("_d"))
    return parsed.select(*keep, "_d.image", F.posexplode("_d.result").alias("class_idx", "score"))


def read_comets(docs: DataFrame, keep: list[str], doc: str = "doc") -> DataFrame:
    """Comet lists sent either bare or below ``comets``.  A document with an
    error code yields nothing, and so do entries lacking name or position."""
    bare = F.from_json(doc, "array<" + schemas.COMET.simpleString() + ">")
    nested = F.from_json(F.get_json_object(doc, "$.comets"), "array<" + schemas.COMET.simpleString() + ">")
    is_list = F.col(doc).rlike(r"^\s*\[")
    code = F.when(~is_list, F.get_json_object(doc, "$.code"))
    rows = docs.where(code.isNull() | code.isin("", "200")).select(
        *keep, F.explode(F.when(is_list, bare).otherwise(nested)).alias("_c"))
    rows = rows.where("_c.comet_fullname <> '' and _c.best_ra is not null and _c.best_dec is not null")
    return rows.select(*keep, F.col("_c.comet_fullname").alias("name"),
                       F.col("_c.best_ra").try_cast("double").alias("ra"),
                       F.col("_c.best_dec").try_cast("double").alias("dec"))

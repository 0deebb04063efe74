"""Station settings: key=value texts, mode parameters, dictionary audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = r'^([^=]+)=\s*"([^"]+)'
PLAIN = r'^([^=]+)=\s*([^\s"]\S*)'


def parse(texts: DataFrame, station: str, body: str = "text",
          defaults: DataFrame | None = None) -> DataFrame:
    """Long ``(station, key, value)`` table; the last line of a key wins.

    Comment lines and lines under two characters are skipped.  ``defaults``
    holds ``(key, value)`` and fills keys a station does not set."""
    lines = texts.select(F.col(station).alias("station"),
                         F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    lines = lines.where(~F.col("line").startswith("#") & (F.length("line") >= 2))
    quoted = F.regexp_extract("line", QUOTED, 2)
    value = F.when(quoted != "", quoted).otherwise(F.regexp_extract("line", PLAIN, 2))
    key = F.trim(F.regexp_extract("line", r"^([^=]+)=", 1))
    pairs = lines.select("station", key.alias("key"), value.alias("value"), "line_no")
    pairs = pairs.where("key <> '' and value <> ''")
    if defaults is not None:
        base = texts.select(F.col(station).alias("station"),
                            F.explode(default_pairs(defaults)).alias("_p"))
        pairs = pairs.unionByName(base.select("station", "_p.key", "_p.value", F.lit(-1).alias("line_no")))
    return pairs.groupBy("station", "key").agg(F.max_by("value", "line_no").alias("value"))


def default_pairs(defaults: DataFrame) -> Column:
    """All default pairs as one array: the dictionary has a few hundred keys."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return defaults.groupBy("key").agg(F.max("value").alias("value")).agg(pairs).scalar()


def audit(settings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Settings against the dictionary ``(key, description, lo, hi)``.

    ``status``: ok, unknown (set but not documented), unset (documented but
    set nowhere), out_of_range, not_numeric (a bounded key with a text)."""
    # one row per key and station: hot keys, so no full outer join on the key
    joined = settings.join(dictionary, "key", "left")
    number = F.col("value").try_cast("double")
    status = (
        F.when(F.col("description").isNull(), "unknown")
        .when(F.col("lo").isNotNull() & number.isNull(), "not_numeric")
        .when((number < F.col("lo")) | (number > F.col("hi")), "out_of_range")
        .otherwise("ok")
    )
    checked = joined.select("station", "key", "value", "description", status.alias("status"))
    used = settings.groupBy("key").agg(F.lit(1).alias("_one"))
    unset = dictionary.join(used, "key", "left_anti").select(
        F.lit(None).cast(settings.schema["station"].dataType).alias("station"), "key",
        F.lit(None).cast("string").alias("value"), "description", F.lit("unset").alias("status"))
    return checked.unionByName(unset)


def explode_help(dictionary: DataFrame, column: str = "help") -> DataFrame:
    """Dictionary map to rows, the ``a-b`` range split into bounds."""
    rows = dictionary.select(F.explode(column).alias("key", "_v"))
    bound = r"^\s*(-?[0-9.]+)\s*-\s*(-?[0-9.]+)\s*$"
    return rows.select("key", F.col("_v.description").alias("description"),
                       F.regexp_extract("_v.range", bound, 1).try_cast("double").alias("lo"),
                       F.regexp_extract("_v.range", bound, 2).try_cast("double").alias("hi"))


def by_mode(settings: DataFrame, names: list[str]) -> DataFrame:
    """One row per station and ``night_mode`` with the mode's parameters.

    Keys are ``daytime_<name>`` and ``nighttime_<name>``."""
    prefix = F.regexp_extract("key", "^(daytime|nighttime)_", 1)
    rows = settings.where(prefix != "").select(
        "station", (prefix == "nighttime").cast("int").alias("night_mode"),
        F.regexp_replace("key", "^(daytime|nighttime)_", "").alias("name"),
        F.col("value").try_cast("double").alias("value"))
    return rows.groupBy("station", "night_mode").pivot("name", names).agg(F.max("value"))


def with_mode_parameters(observations: DataFrame, parameters: DataFrame) -> DataFrame:
    return observations.join(parameters, ["station", "night_mode"], "left")

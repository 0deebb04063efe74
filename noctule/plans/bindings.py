"""Input tables bound to the given parquet tables, once as DataFrames and once
as SQL common table expressions for the oracle.

Every binding is row-local (no window, no collected group), so it costs a scan
at any size.  Frame numbers come from dense keys: 32 embedding rows of 16
pixels make a frame, 3 make an exposure bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctule.functions import pixel as P

# site used for astronomy
LAT, LON = 51.2349, 7.4479

FRAME_WIDTH, FRAME_HEIGHT = 16, 32
STACK_SIDE = 8
BRACKET_SIDE = 4


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# --- observations from events -----------------------------------------------

def obs(spark: SparkSession, root: str) -> DataFrame:
    return obs_from(table(spark, root, "events"))


def obs_from(e: DataFrame) -> DataFrame:
    """Observations from event rows, batch or streaming."""
    # props is always {"k": n}; a pattern costs a fraction of a JSON parse
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    ts = F.col("ts").cast("timestamp")
    value = F.col("value")
    brightness = value / (value + 100.0)
    rows = e.select(
        "event_id", F.col("user_id").alias("station"), F.col("event_type").alias("feed"),
        F.unix_seconds(ts).alias("timestamp"), (F.col("user_id") % 3 * 3600).cast("int").alias("timezone_offset"),
        k.alias("k"), value.alias("value"), brightness.alias("brightness"), F.to_date(ts).alias("day"))
    hour = F.pmod(F.col("timestamp"), F.lit(86400)) / 3600
    return rows.select(
        "event_id", "station", "feed", "timestamp", "timezone_offset",
        (10.0 / (1 + F.col("k") % 7)).alias("exposure"), (F.col("k") * 2.0).alias("gain"), "brightness",
        (F.col("brightness") * 0.9).alias("mean_r"), F.col("brightness").alias("mean_g"),
        (F.col("brightness") * 1.1).alias("mean_b"), (F.col("value") / 10000.0).alias("noise"),
        (1 + F.col("k") % 3).cast("int").alias("hdr"),
        F.when((hour >= 18) | (hour < 6), 1).otherwise(0).alias("night_mode"),
        (F.col("k") * 10).cast("int").alias("stars"), (17.0 + F.col("value") / 100.0).alias("sqm"),
        (F.col("value") / 3.0).alias("focus"), "day", "k", "value")


OBS = """
obs0 AS (
  SELECT event_id, user_id AS station, event_type AS feed,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
         CAST(3600 * (user_id % 3) AS INT) AS timezone_offset,
         CAST(json_extract(props, '$.k') AS INT) AS k, value,
         value / (value + 1e2) AS brightness, CAST(ts AS DATE) AS day
  FROM events),
obs AS (
  SELECT event_id, station, feed, timestamp, timezone_offset,
         1e1 / (1 + k % 7) AS exposure, k * 2e0 AS gain, brightness,
         brightness * CAST(0.9 AS DOUBLE) AS mean_r, brightness AS mean_g,
         brightness * CAST(1.1 AS DOUBLE) AS mean_b, value / 1e4 AS noise,
         CAST(1 + k % 3 AS INT) AS hdr,
         CASE WHEN timestamp % 86400 >= 64800 OR timestamp % 86400 < 21600 THEN 1 ELSE 0 END AS night_mode,
         CAST(k * 10 AS INT) AS stars, 17e0 + value / 1e2 AS sqm, value / 3e0 AS focus, day, k, value
  FROM obs0)
"""


def meteo(spark: SparkSession, root: str) -> DataFrame:
    o = obs(spark, root).where("feed = 'purchase'")
    k, v = F.col("k"), F.col("value")
    return o.select(
        "event_id", "station", "timestamp", (v / 10.0 - 5.0).alias("temperature"), (k * 1.0).alias("humidity"),
        (v / 20.0).alias("dew_point"), (v / 50.0 + 1000.0).alias("pressure_msl"),
        (v / 50.0 + 990.0).alias("surface_pressure"), (k * 1.0).alias("cloud_cover"), (k / 2.0).alias("cloud_low"),
        (k / 4.0).alias("cloud_mid"), (k / 8.0).alias("cloud_high"), (v * 100.0).alias("visibility"),
        (v / 30.0).alias("wind_speed_10m"), (k * 3.5).alias("wind_dir_10m"), (v / 2.0).alias("wind_speed_300hPa"), "day")


METEO = OBS + """,
meteo AS (
  SELECT event_id, station, timestamp, value / 1e1 - 5e0 AS temperature, k * 1e0 AS humidity, value / 2e1 AS dew_point,
         value / 5e1 + 1e3 AS pressure_msl, value / 5e1 + 990e0 AS surface_pressure, k * 1e0 AS cloud_cover,
         k / 2e0 AS cloud_low, k / 4e0 AS cloud_mid, k / 8e0 AS cloud_high, value * 1e2 AS visibility,
         value / 3e1 AS wind_speed_10m, k * 35e-1 AS wind_dir_10m, value / 2e0 AS wind_speed_300hPa, day
  FROM obs WHERE feed = 'purchase')
"""


def aurora(spark: SparkSession, root: str) -> DataFrame:
    o = obs(spark, root).where("feed = 'click'")
    k, v = F.col("k"), F.col("value")
    return o.select(
        "event_id", "station", "timestamp", (k * 1.0).alias("probability_percent"),
        (k + 5.0).alias("probability_max"), (k / 2.0).alias("probability_avg"), (v / 60.0).alias("kp_index"),
        (v / 20.0).alias("bt"), (v / 20.0 - 5.0).alias("bz"), (v / 40.0).alias("density"),
        (v + 300.0).alias("speed"), (v * 1000.0).alias("temperature"), "day")


AURORA = OBS + """,
aurora AS (
  SELECT event_id, station, timestamp, k * 1e0 AS probability_percent, k + 5e0 AS probability_max,
         k / 2e0 AS probability_avg, value / 6e1 AS kp_index, value / 2e1 AS bt, value / 2e1 - 5e0 AS bz,
         value / 4e1 AS density, value + 3e2 AS speed, value * 1e3 AS temperature, day
  FROM obs WHERE feed = 'click')
"""


# --- pixels from embeddings -------------------------------------------------

def _level(index: Column) -> Column:
    return P.clamp(F.get("embedding", index).cast("double") + 0.5)


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """16 x 32 frames of four values per pixel, of differing brightness, with
    some black and some transparent pixels."""
    e = table(spark, root, "embeddings").select(
        F.floor(F.col("vec_id") / 32).alias("frame_id"), (F.col("vec_id") % 32).cast("int").alias("y"), "embedding")
    e = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    gain = 1.0 / (1 + F.col("frame_id") % 4 * 5)
    black = (F.col("x") * 7 + F.col("y") * 3) % 17 == 0
    clear = (F.col("x") + F.col("y") * 2) % 13 == 0
    return e.select(
        "frame_id", "x", "y",
        *[F.when(black, 0.0).otherwise(_level(F.col("x") * 4 + i) * gain).alias(c) for i, c in enumerate("rgb")],
        F.when(clear, 0.0).otherwise(_level(F.col("x") * 4 + 3)).alias("a"))


PIXELS = """
pixels0 AS (
  SELECT vec_id // 32 AS frame_id, CAST(vec_id % 32 AS INT) AS y, CAST(x AS INT) AS x, embedding,
         1e0 / (1 + (vec_id // 32) % 4 * 5) AS f
  FROM embeddings, range(16) t(x)),
pixels AS (
  SELECT frame_id, x, y,
         CASE WHEN (x * 7 + y * 3) % 17 = 0 THEN 0e0
              ELSE least(greatest(CAST(embedding[x * 4 + 1] AS DOUBLE) + 5e-1, 0e0), 1e0) * f END AS r,
         CASE WHEN (x * 7 + y * 3) % 17 = 0 THEN 0e0
              ELSE least(greatest(CAST(embedding[x * 4 + 2] AS DOUBLE) + 5e-1, 0e0), 1e0) * f END AS g,
         CASE WHEN (x * 7 + y * 3) % 17 = 0 THEN 0e0
              ELSE least(greatest(CAST(embedding[x * 4 + 3] AS DOUBLE) + 5e-1, 0e0), 1e0) * f END AS b,
         CASE WHEN (x + y * 2) % 13 = 0 THEN 0e0
              ELSE least(greatest(CAST(embedding[x * 4 + 4] AS DOUBLE) + 5e-1, 0e0), 1e0) END AS a
  FROM pixels0)
"""


def volume(spark: SparkSession, root: str) -> DataFrame:
    """A larger pixel table from line items: a frame per supplier."""
    li = table(spark, root, "lineitem")
    return li.select(F.col("l_suppkey").alias("frame_id"), F.col("l_linenumber").cast("int").alias("x"),
                     F.col("l_orderkey").alias("y"), (F.col("l_extendedprice").cast("double") / 131072.0).alias("r"),
                     (F.col("l_quantity").cast("double") / 64.0).alias("g"),
                     (F.col("l_discount").cast("double") * 8.0).alias("b"), F.lit(1.0).alias("a"))


VOLUME = """
pixels AS (
  SELECT l_suppkey AS frame_id, CAST(l_linenumber AS INT) AS x, l_orderkey AS y,
         CAST(l_extendedprice AS DOUBLE) / 131072e0 AS r, CAST(l_quantity AS DOUBLE) / 64e0 AS g,
         CAST(l_discount AS DOUBLE) * 8e0 AS b, 1e0 AS a
  FROM lineitem)
"""


def frames8(spark: SparkSession, root: str) -> DataFrame:
    """8 x 8 byte frames in ten series."""
    return frames8_from(table(spark, root, "embeddings"))


def frames8_from(e: DataFrame) -> DataFrame:
    e = e.select(
        F.col("label").alias("series"), F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("pos", "e"))
    return e.select("series", "seq", (F.col("pos") % STACK_SIDE).cast("int").alias("x"),
                    F.floor(F.col("pos") / STACK_SIDE).cast("int").alias("y"), F.lit(0).alias("c"),
                    F.floor(P.clamp(F.col("e").cast("double") + 0.5) * 255.0).cast("int").alias("v"))


FRAMES8 = """
frames8_0 AS (
  SELECT label AS series, vec_id AS seq, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS e
  FROM embeddings),
frames8 AS (
  SELECT series, seq, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y, 0 AS c,
         CAST(floor(least(greatest(CAST(e AS DOUBLE) + 5e-1, 0e0), 1e0) * 255e0) AS INT) AS v
  FROM frames8_0)
"""


def bracket_pixels(spark: SparkSession, root: str) -> DataFrame:
    """4 x 4 brackets of three exposures, the shorter ones darker, some pixels transparent."""
    e = table(spark, root, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 3).alias("bracket"), (F.col("vec_id") % 3).cast("int").alias("k"),
        "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    black = (F.col("p") + F.col("vec_id")) % 29 == 0
    gain = 2.0 / (1 + F.col("k"))
    return e.select(
        "bracket", "k", (F.col("p") % 4).cast("int").alias("x"), F.floor(F.col("p") / 4).cast("int").alias("y"),
        *[F.when(black, 0.0).otherwise(P.clamp(_level(F.col("p") + 16 * i) * gain)).alias(c)
          for i, c in enumerate("rgb")],
        P.clamp(F.get("embedding", F.col("p") + 48).cast("double") * 4.0 + 0.5).alias("a"))


BRACKET = """
bpixels0 AS (
  SELECT vec_id, vec_id // 3 AS bracket, CAST(vec_id % 3 AS INT) AS k, CAST(p AS INT) AS p, embedding,
         2e0 / (1 + vec_id % 3) AS f
  FROM embeddings, range(16) t(p)),
bpixels AS (
  SELECT bracket, k, p % 4 AS x, CAST(p // 4 AS INT) AS y,
         CASE WHEN (p + vec_id) % 29 = 0 THEN 0e0 ELSE
           least(greatest(least(greatest(CAST(embedding[p + 1] AS DOUBLE) + 5e-1, 0e0), 1e0) * f, 0e0), 1e0) END AS r,
         CASE WHEN (p + vec_id) % 29 = 0 THEN 0e0 ELSE
           least(greatest(least(greatest(CAST(embedding[p + 17] AS DOUBLE) + 5e-1, 0e0), 1e0) * f, 0e0), 1e0) END AS g,
         CASE WHEN (p + vec_id) % 29 = 0 THEN 0e0 ELSE
           least(greatest(least(greatest(CAST(embedding[p + 33] AS DOUBLE) + 5e-1, 0e0), 1e0) * f, 0e0), 1e0) END AS b,
         least(greatest(CAST(embedding[p + 49] AS DOUBLE) * 4e0 + 5e-1, 0e0), 1e0) AS a
  FROM bpixels0)
"""


# --- grid, sites, archive, settings -----------------------------------------

def grid(spark: SparkSession, root: str) -> DataFrame:
    """A 36 x 18 degree grid; a point's value comes from the orders on it."""
    o = table(spark, root, "orders").select(
        (F.col("o_orderkey") % 36).alias("lon"), (F.floor(F.col("o_orderkey") / 36) % 18).alias("lat"), "o_custkey")
    cells = o.groupBy("lon", "lat").agg((F.max("o_custkey") % 101).cast("int").alias("val"))
    return cells.select((F.col("lon") * 18 + F.col("lat")).alias("pos"), F.col("lon").cast("double").alias("lon"),
                        F.col("lat").cast("double").alias("lat"), "val")


def sites(spark: SparkSession, root: str) -> DataFrame:
    """Customers as sites; a few lie far off the grid."""
    c = F.col("c_custkey")
    far = F.when(c % 97 == 0, 120.0).otherwise(0.0)
    return table(spark, root, "customer").select(
        c.alias("site"), ((c * 37) % 3500 / 100.0 + far).alias("lon"), ((c * 17) % 1700 / 100.0).alias("lat"))


GRID = """
grid AS (
  SELECT lon * 18 + lat AS pos, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat,
         CAST(max(o_custkey) % 101 AS INT) AS val
  FROM (SELECT o_orderkey % 36 AS lon, (o_orderkey // 36) % 18 AS lat, o_custkey FROM orders)
  GROUP BY lon, lat),
sites AS (
  SELECT c_custkey AS site, (c_custkey * 37) % 3500 / 1e2 + CASE WHEN c_custkey % 97 = 0 THEN 12e1 ELSE 0e0 END AS lon,
         (c_custkey * 17) % 1700 / 1e2 AS lat
  FROM customer)
"""


def archive(spark: SparkSession, root: str) -> DataFrame:
    """Pages as media files of five days; every seventh has no date in its name."""
    p = F.col("page_id")
    day = F.concat(F.lit("2024010"), (p % 5 + 1).cast("string"))
    stamp = F.concat(day, F.lpad((p % 24).cast("string"), 2, "0"),
                     F.lpad((p % 60).cast("string"), 2, "0"), F.lit("00"))
    kind = F.when(p % 3 == 0, "image").otherwise("video")
    suffix = F.when(p % 3 == 0, ".jpg").otherwise(".mp4")
    name = F.concat(kind, F.lit("-"), F.when(p % 7 == 0, "x").otherwise(stamp), suffix)
    return table(spark, root, "pages").select(
        "page_id", F.concat(day, F.lit("/"), name).alias("path"), name.alias("name"),
        F.length("html").cast("long").alias("length"), kind.alias("kind"))


ARCHIVE = """
archive0 AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image' ELSE 'video' END AS kind,
         CASE WHEN page_id % 3 = 0 THEN '.jpg' ELSE '.mp4' END AS suffix,
         CASE WHEN page_id % 7 = 0 THEN 'x' ELSE '2024010' || (page_id % 5 + 1) || lpad(CAST(page_id % 24 AS VARCHAR), 2, '0')
              || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || '00' END AS stamp,
         CAST(length(html) AS BIGINT) AS length
  FROM pages),
archive AS (
  SELECT page_id, '2024010' || (page_id % 5 + 1) || '/' || kind || '-' || stamp || suffix AS path, kind || '-' || stamp || suffix AS name,
         length, kind FROM archive0)
"""


def settings_texts(spark: SparkSession, root: str) -> DataFrame:
    """A settings file per supplier with comments, quotes and repeated keys."""
    s = table(spark, root, "supplier")
    key, bal = F.col("s_suppkey"), F.col("s_acctbal")
    text = F.concat_ws(
        "\n", F.lit("# station settings"), F.lit(""),
        F.concat(F.lit("daytime_capture="), (key % 2).cast("string")),
        F.concat(F.lit("daytime_meanbrightness=0."), (key % 7 + 1).cast("string")),
        F.concat(F.lit("nighttime_meanbrightness = 0."), (F.col("s_nationkey") % 5 + 1).cast("string")),
        F.concat(F.lit('city="'), F.col("s_name"), F.lit(' north"')),
        F.concat(F.lit("crop_width="), F.floor(bal).cast("string")),
        F.lit("crop_width=64"), F.lit("x"),
        F.when(key % 4 == 0, F.lit("sqm_center_x=989")),
        F.when(key % 3 == 0, F.concat(F.lit("crop_width="), (key * 10).cast("string"))),
        F.lit("#crop_width=1"))
    return s.select(key.alias("station"), text.alias("text"))


# key, default, description, range
SETTINGS_DICTIONARY = [
    ("daytime_capture", "1", "Capture by day", "0-1"),
    ("daytime_meanbrightness", "0.2", "Target brightness by day", "0-1"),
    ("nighttime_meanbrightness", "0.15", "Target brightness by night", "0-0.4"),
    ("nighttime_gain", "50", "Start gain by night", "0-100"),
    ("crop_width", "640", "Width of the crop", "0-300"),
    ("city", None, "Place name", None),
    ("owner", None, "Owner name", None),
]

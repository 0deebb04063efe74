"""Queries over measurement tables, feed documents, archive and settings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from noctule import schemas
from noctule.functions import text
from noctule.operators import filters, photometry, scoring, timeline
from noctule.plans import bindings as b
from noctule.plans.registry import query, r6, s6
from noctule.session import scratch_path
from noctule.sources import archive, feeds, measurements, settings

START, END = 1704412800, 1705276799  # 2024-01-05 .. 2024-01-14, both whole days
IMAGE = ", ".join(schemas.IMAGE_COLUMNS)


# --- scan, insert, latest, export -------------------------------------------

@query("scan_day_range", f"""
WITH {b.OBS}
SELECT station, {IMAGE} FROM obs WHERE timestamp BETWEEN {START} AND {END}
QUALIFY row_number() OVER (PARTITION BY station, timestamp ORDER BY event_id) = 1""")
def scan_day_range(spark, root):
    path = scratch_path(spark, "measurements")
    rows = measurements.first_arrival(b.obs(spark, root), ["station", "timestamp"], F.col("event_id"))
    measurements.append(rows, path, "image")
    return measurements.scan(spark, path, "image", START, END).drop("day")


@query("insert_if_absent", f"""
WITH {b.OBS},
stored AS (SELECT * FROM obs WHERE feed IN ('view', 'click')),
fresh AS (SELECT *, timestamp // 600 AS slot FROM obs WHERE feed NOT IN ('view', 'click'))
SELECT station, slot, min(event_id) AS event_id FROM fresh
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station = fresh.station AND s.timestamp // 600 = fresh.slot)
GROUP BY station, slot""")
def insert_if_absent(spark, root):
    # a slot of ten minutes as the unique key, so that there are repeats
    rows = b.obs(spark, root).withColumn("slot", F.floor(F.col("timestamp") / 600))
    stored = rows.where(F.col("feed").isin("view", "click"))
    incoming = rows.where(~F.col("feed").isin("view", "click")).select("station", "slot", "event_id")
    return measurements.insert_if_absent(stored, incoming, ["station", "slot"], F.col("event_id"))


@query("latest_per_station", f"""
WITH {b.OBS}
SELECT station, timestamp, event_id, exposure, gain, {s6('brightness', 'brightness')}, hdr FROM obs
QUALIFY row_number() OVER (PARTITION BY station ORDER BY timestamp DESC, event_id DESC) = 1""")
def latest_per_station(spark, root):
    rows = measurements.latest(b.obs(spark, root), ["station"], ["timestamp", "event_id"])
    return rows.select("station", "timestamp", "event_id", "exposure", "gain", r6("brightness"), "hdr")


_METEO_ROUNDED = ", ".join(f"round({c}, {n}) + 0e0 AS {c}" for c, n in measurements.METEO_DECIMALS.items())


@query("export_rounded", f"WITH {b.METEO} SELECT event_id, {_METEO_ROUNDED} FROM meteo")
def export_rounded(spark, root):
    rows = b.meteo(spark, root).select("event_id", *measurements.METEO_DECIMALS)
    docs = measurements.export_json(rows, measurements.METEO_DECIMALS, keep=["event_id"])
    schema = ", ".join(f"{c} double" for c in measurements.METEO_DECIMALS)
    back = docs.select("event_id", F.from_json("doc", schema).alias("d"))
    return back.select("event_id", *[(F.col(f"d.{c}") + 0.0).alias(c) for c in measurements.METEO_DECIMALS])


# --- feed documents ---------------------------------------------------------

def _sidecar_docs(spark, root):
    o = b.obs(spark, root)
    parts = {"timestamp": F.col("timestamp"), "timezone_offset": F.col("timezone_offset"),
             **{f"exposure_t{i}": timeline.ladder(F.col("exposure"), 1, F.lit(i)) for i in range(5)},
             **{f"sigma_noise_t{i}": F.col("noise") * (i + 1) for i in range(4)},
             "gain": F.col("gain"), "hdr": F.col("hdr")}
    return o.select(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])).alias("doc"))


@query("sidecar_arrays", f"""
WITH {b.OBS}
SELECT timestamp, timezone_offset, gain, hdr, CAST(i AS INT) AS i,
       {s6('exposure / pow(2e0, i)', 'exposure')},
       CASE WHEN i < 4 THEN round(noise * (i + 1), 6) + 0e0 END AS sigma_noise
FROM obs, range(5) t(i)""")
def sidecar_arrays(spark, root):
    cars = feeds.read_sidecars(_sidecar_docs(spark, root))
    rows = cars.select("timestamp", "timezone_offset", "gain", "hdr",
                       F.posexplode(F.arrays_zip("exposures", "sigma_noises")).alias("i", "p"))
    return rows.select("timestamp", "timezone_offset", "gain", "hdr", "i",
                       r6("p.exposures", "exposure"), r6("p.sigma_noises", "sigma_noise"))


@query("explode_stars", """
SELECT vec_id, CAST(i AS INT) AS pos, CAST(floor(abs(embedding[i + 1]) * 1e3) AS INT) AS x,
       CAST(floor(abs(embedding[i + 33]) * 1e3) AS INT) AS y
FROM embeddings, range(32) t(i)""")
def explode_stars(spark, root):
    e = b.table(spark, root, "embeddings")
    place = lambda c: F.floor(F.abs(c.cast("double")) * 1000.0).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        place(F.get("embedding", i)).alias("x"), place(F.get("embedding", i + 32)).alias("y")))
    docs = e.select("vec_id", F.to_json(F.struct(pairs.alias("stars"))).alias("doc"))
    return feeds.read_stars(docs, ["vec_id"])


def _grid_docs(spark, root):
    """A forecast document per embedding; some lack a member, each has a short entry."""
    e = b.table(spark, root, "embeddings")
    whole = lambda c: F.floor(c.cast("double") * 100.0).cast("double")
    entries = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when(
        i == 7, F.array(whole(F.get("embedding", i)))).otherwise(F.array(
            whole(F.get("embedding", i * 3)), whole(F.get("embedding", i * 3 + 1)),
            F.abs(whole(F.get("embedding", i * 3 + 2))))))
    stamp = lambda seconds: F.date_format(F.timestamp_seconds(seconds), feeds.ISO)
    begin = F.lit(START) + F.col("vec_id") * 60
    return e.select("vec_id", F.to_json(F.struct(
        F.when(F.col("vec_id") % 10 != 3, stamp(begin)).alias("Observation Time"),
        stamp(begin + 1800).alias("Forecast Time"), entries.alias("coordinates"))).alias("doc"))


@query("read_grid_doc", f"""
SELECT vec_id, CAST({START} + vec_id * 60 AS BIGINT) AS obs_time, CAST({START} + vec_id * 60 + 1800 AS BIGINT) AS forecast_time,
       CAST(i AS INT) AS pos, floor(CAST(embedding[i * 3 + 1] AS DOUBLE) * 1e2) + 0e0 AS lon,
       floor(CAST(embedding[i * 3 + 2] AS DOUBLE) * 1e2) + 0e0 AS lat,
       CAST(abs(floor(CAST(embedding[i * 3 + 3] AS DOUBLE) * 1e2)) AS INT) AS val
FROM embeddings, range(21) t(i) WHERE i <> 7 AND vec_id % 10 <> 3""")
def read_grid_doc(spark, root):
    return feeds.read_grid(_grid_docs(spark, root), ["vec_id"])


def _header_docs(spark, root):
    """A magnetometer table per click: header, a row, a short row, a bad time, a row."""
    o = b.obs(spark, root).where("feed = 'click'")
    when = lambda s: F.date_format(F.timestamp_seconds(s), feeds.SQL_TIME)
    num = lambda c: F.round(c, 3).cast("string")
    v, t = F.col("value"), F.col("timestamp")
    header = F.array(*map(F.lit, ["time_tag", "bx_gsm", "by_gsm", "bz_gsm", "lon_gsm", "bt"]))
    row = lambda t, v: F.array(when(t), F.lit("0"), F.lit("1"), num(v), F.lit("3"), num(v * 2))
    rows = F.array(header, row(t, v), F.array(when(t), F.lit("0")),
                   F.array(F.lit("soon"), *[F.lit("1")] * 5), row(t + 60, v + 1))
    return o.select("event_id", F.to_json(rows).alias("doc"))


@query("read_header_rows", f"""
WITH {b.OBS}
SELECT event_id, CAST(1 AS INT) AS pos, timestamp, round(value * 2, 3) + 0e0 AS bt, round(value, 3) + 0e0 AS bz,
       1e0 AS bt_positional, 3e0 AS bz_positional
FROM obs WHERE feed = 'click'
UNION ALL
SELECT event_id, CAST(4 AS INT), timestamp + 60, round((value + 1) * 2, 3) + 0e0, round(value + 1, 3) + 0e0, 1e0, 3e0
FROM obs WHERE feed = 'click'""")
def read_header_rows(spark, root):
    docs = _header_docs(spark, root)
    both = {**feeds.MAG_TABLE, "bt_positional": ("-", 2), "bz_positional": ("-", 4)}
    rows = feeds.read_header_rows(docs, ["event_id"], both, feeds.MIN_WIDTH["mag"])
    return rows.withColumnRenamed("bz", "bz")


@query("read_hourly_arrays", f"""
SELECT vec_id, CAST(i AS INT) AS pos, CAST({START} + i * 3600 AS BIGINT) AS timestamp,
       {s6('CAST(embedding[i + 1] AS DOUBLE) * 4e1', 'temperature')},
       CASE WHEN i < 60 THEN round(CAST(embedding[i + 5] AS DOUBLE) * 1e2, 6) + 0e0 END AS humidity,
       CAST(NULL AS DOUBLE) AS visibility
FROM embeddings, range(64) t(i)""")
def read_hourly_arrays(spark, root):
    e = b.table(spark, root, "embeddings")
    hours = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.date_format(
        F.timestamp_seconds(F.lit(START) + i * 3600), "yyyy-MM-dd'T'HH:mm"))
    # the humidity array is four hours short, others are missing
    docs = e.select("vec_id", F.to_json(F.struct(F.struct(
        hours.alias("time"),
        F.transform("embedding", lambda v: v.cast("double") * 40.0).alias("temperature_2m"),
        F.transform(F.slice("embedding", 5, 60), lambda v: v.cast("double") * 100.0).alias("relative_humidity_2m"),
    ).alias("hourly"))).alias("doc"))
    rows = feeds.read_hourly(docs, ["vec_id"])
    return rows.select("vec_id", "pos", "timestamp", r6("temperature"), r6("humidity"), "visibility")


def _detection_docs(spark, root):
    o = b.obs(spark, root).where("feed = 'error'")
    names = F.array(*map(F.lit, ["meteor", "plane", "satellite"]))
    k, v = F.col("k"), F.col("value")
    thing = lambda i: F.struct(
        ((k + i) % 3).cast("int").alias("cls"), F.get(names, (k + i) % 3).alias("name"),
        F.round(F.pmod(v * (i + 1), F.lit(1.0)), 4).alias("conf"), (k * 1.0).alias("x1"), (k * 2.0).alias("y1"),
        (k * 1.0 + 8.0).alias("x2"), (k * 2.0 + 8.0).alias("y2"))
    objects = F.transform(F.sequence(F.lit(0), k % 4), thing)
    image = F.concat(F.lit("image-"), F.col("event_id").cast("string"))
    return o.select("event_id", F.to_json(F.struct(image.alias("image"), objects.alias("objects"))).alias("doc"))


DETECTIONS = b.OBS + """,
detections AS (
  SELECT event_id, 'image-' || event_id AS image, CAST((k + i) % 3 AS INT) AS cls,
         ['meteor', 'plane', 'satellite'][(k + i) % 3 + 1] AS name,
         round((value * (i + 1)) % 1e0, 4) AS conf, k * 1e0 AS x1, k * 2e0 AS y1, k * 1e0 + 8e0 AS x2, k * 2e0 + 8e0 AS y2
  FROM obs, range(4) t(i) WHERE feed = 'error' AND i <= k % 4)
"""


@query("explode_detections", f"WITH {DETECTIONS} SELECT * FROM detections")
def explode_detections(spark, root):
    return feeds.read_detections(_detection_docs(spark, root), ["event_id"])


@query("detection_summary", f"""
WITH {DETECTIONS}
SELECT image, name, count(*) AS n, max(conf) AS max_conf, {s6('avg(conf)', 'avg_conf')} FROM detections GROUP BY image, name""")
def detection_summary(spark, root):
    rows = scoring.detection_summary(feeds.read_detections(_detection_docs(spark, root), []))
    return rows.withColumn("avg_conf", r6("avg_conf"))


def _score_docs(spark, root):
    e = b.table(spark, root, "embeddings")
    scores = F.transform("embedding", lambda v: F.round(v.cast("double"), 1))
    image = F.concat(F.lit("frame-"), F.col("vec_id").cast("string"))
    return e.select(F.to_json(F.struct(image.alias("image"), scores.alias("result"))).alias("doc"))


SCORES = """
scores AS (
  SELECT 'frame-' || vec_id AS image, CAST(i AS INT) AS class_idx,
         round(CAST(embedding[i + 1] AS DOUBLE), 1) + 0e0 AS score
  FROM embeddings, range(64) t(i))
"""


@query("explode_scores", f"WITH {SCORES} SELECT * FROM scores")
def explode_scores(spark, root):
    rows = feeds.read_scores(_score_docs(spark, root), [])
    return rows.withColumn("score", F.col("score") + 0.0)


@query("top_class", f"""
WITH {SCORES}
SELECT image, class_idx, score FROM scores
QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, class_idx) = 1""")
def top_class(spark, root):
    rows = scoring.top_class(feeds.read_scores(_score_docs(spark, root), []))
    return rows.withColumn("score", F.col("score") + 0.0)


def comet_docs(spark, root):
    """Bare lists, nested lists and error replies by turns."""
    c = b.table(spark, root, "customer").select("c_custkey", "c_name", "c_acctbal")
    n = F.col("c_custkey")
    good = F.struct(F.col("c_name").alias("comet_fullname"), ((n * 7) % 360).cast("string").alias("best_ra"),
                    ((n * 3) % 180 - 90).cast("string").alias("best_dec"))
    unplaced = F.struct(F.lit("unplaced").alias("comet_fullname"), F.lit(None).cast("string").alias("best_ra"),
                        F.lit("1").alias("best_dec"))
    items = F.array(good, unplaced)
    return c.select(n.alias("doc_id"), F.when(n % 3 == 0, F.to_json(items))
                    .when(n % 3 == 1, F.to_json(F.struct(items.alias("comets"))))
                    .otherwise(F.to_json(F.struct(F.lit("429").alias("code"), items.alias("comets")))).alias("doc"))


COMETS = """
comets AS (
  SELECT c_custkey AS doc_id, c_name AS name, CAST((c_custkey * 7) % 360 AS DOUBLE) AS ra,
         CAST((c_custkey * 3) % 180 - 90 AS DOUBLE) AS dec
  FROM customer WHERE c_custkey % 3 <> 2)
"""


@query("read_comets", f"WITH {COMETS} SELECT * FROM comets")
def read_comets(spark, root):
    return feeds.read_comets(comet_docs(spark, root), ["doc_id"])


@query("frame_list", """
SELECT page_id AS series, CAST(i AS INT) AS seq, '/frames/image-' || page_id || '-' || (i + 1) || '.jpg' AS path
FROM pages, range(3) t(i)""")
def frame_list(spark, root):
    p = F.col("page_id").cast("string")
    line = lambda i: F.concat(F.lit("/frames/image-"), p, F.lit(f"-{i}.jpg"))
    texts = b.table(spark, root, "pages").select(
        "page_id", F.concat_ws("\n", line(1), line(2), F.lit("  "), line(3), F.lit("")).alias("text"))
    return archive.frame_list(texts, "page_id")


# --- settings ---------------------------------------------------------------

SETTINGS = """
settings0 AS (
  SELECT s_suppkey AS station, unnest([
    {'key': 'daytime_capture', 'value': CAST(s_suppkey % 2 AS VARCHAR)},
    {'key': 'daytime_meanbrightness', 'value': '0.' || (s_suppkey % 7 + 1)},
    {'key': 'nighttime_meanbrightness', 'value': '0.' || (s_nationkey % 5 + 1)},
    {'key': 'nighttime_gain', 'value': '50'},
    {'key': 'city', 'value': s_name || ' north'},
    {'key': 'sqm_center_x', 'value': CASE WHEN s_suppkey % 4 = 0 THEN '989' END},
    {'key': 'crop_width', 'value': CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey * 10 AS VARCHAR) ELSE '64' END}]) AS p
  FROM supplier),
settings AS (SELECT station, p.key AS key, p.value AS value FROM settings0 WHERE p.value IS NOT NULL)
"""


def _defaults(spark):
    rows = [(k, d) for k, d, _, _ in b.SETTINGS_DICTIONARY if d is not None]
    return spark.createDataFrame(rows, "key string, value string")


def _settings(spark, root):
    return settings.parse(b.settings_texts(spark, root), "station", defaults=_defaults(spark))


@query("parse_config", f"WITH {SETTINGS} SELECT station, key, value FROM settings")
def parse_config(spark, root):
    return _settings(spark, root)


@query("config_help", f"""
WITH {SETTINGS},
dictionary AS (SELECT * FROM (VALUES
  ('daytime_capture', 'Capture by day', 0e0, 1e0),
  ('daytime_meanbrightness', 'Target brightness by day', 0e0, 1e0),
  ('nighttime_meanbrightness', 'Target brightness by night', 0e0, 4e-1),
  ('nighttime_gain', 'Start gain by night', 0e0, 1e2),
  ('crop_width', 'Width of the crop', 0e0, 3e2),
  ('city', 'Place name', NULL, NULL),
  ('owner', 'Owner name', NULL, NULL)) t(key, description, lo, hi))
SELECT s.station, coalesce(s.key, d.key) AS key, s.value, d.description,
       CASE WHEN s.station IS NULL THEN 'unset' WHEN d.description IS NULL THEN 'unknown'
            WHEN d.lo IS NOT NULL AND try_cast(s.value AS DOUBLE) IS NULL THEN 'not_numeric'
            WHEN try_cast(s.value AS DOUBLE) < d.lo OR try_cast(s.value AS DOUBLE) > d.hi THEN 'out_of_range'
            ELSE 'ok' END AS status
FROM settings s FULL OUTER JOIN dictionary d ON s.key = d.key""")
def config_help(spark, root):
    entries = [(k, (text_, "", range_, default or "", [])) for k, default, text_, range_ in b.SETTINGS_DICTIONARY]
    schema = "help map<string, " + schemas.SETTING_HELP.simpleString() + ">"
    dictionary = settings.explode_help(spark.createDataFrame([(dict(entries),)], schema))
    return settings.audit(_settings(spark, root), dictionary)


@query("params_by_mode", f"""
WITH {b.OBS}, {SETTINGS},
modes AS (
  SELECT station, CASE WHEN key LIKE 'nighttime_%' THEN 1 ELSE 0 END AS night_mode,
         CAST(max(CASE WHEN key LIKE '%_meanbrightness' THEN value END) AS DOUBLE) AS meanbrightness,
         CAST(max(CASE WHEN key LIKE '%_gain' THEN value END) AS DOUBLE) AS gain_start
  FROM settings WHERE key LIKE 'daytime_%' OR key LIKE 'nighttime_%' GROUP BY 1, 2)
SELECT o.event_id, o.station, o.night_mode, m.meanbrightness, m.gain_start
FROM obs o LEFT JOIN modes m ON o.station = m.station AND o.night_mode = m.night_mode""")
def params_by_mode(spark, root):
    parameters = settings.by_mode(_settings(spark, root), ["meanbrightness", "gain"])
    parameters = parameters.withColumnRenamed("gain", "gain_start")
    rows = b.obs(spark, root).select("event_id", "station", "night_mode")
    return settings.with_mode_parameters(rows, parameters)


# --- archive ----------------------------------------------------------------

@query("archive_listing", f"""
WITH {b.ARCHIVE}
SELECT path, length, left(path, 8) AS day_text, nullif(regexp_extract(path, 'video-([0-9]{{14}})\\.mp4', 1), '') AS stamp,
       CAST(epoch(try_strptime(nullif(regexp_extract(path, 'video-([0-9]{{14}})\\.mp4', 1), ''), '%Y%m%d%H%M%S')) AS BIGINT) AS taken
FROM archive WHERE path LIKE '%.mp4' ORDER BY path""")
def archive_listing(spark, root):
    files = b.archive(spark, root).select("path", "length")
    return archive.listing(files).orderBy("path")


@query("name_slice", f"""
WITH {b.ARCHIVE}
SELECT name, substring(name, 7, length(name) - 10) AS slice FROM archive
WHERE name LIKE 'image-20240101%' AND name LIKE '%.jpg'""")
def name_slice(spark, root):
    names = b.archive(spark, root).select("name")
    return archive.slice_names(names, "name", "image-20240101", ".jpg", len("image-"))


@query("videos_sorted", f"""
WITH {b.ARCHIVE}
SELECT path, length FROM archive WHERE path LIKE '%.mp4'
ORDER BY coalesce(nullif(regexp_extract(path, 'video-([0-9]{{14}})\\.mp4', 1), ''), '') DESC, path DESC""")
def videos_sorted(spark, root):
    files = b.archive(spark, root).where(F.col("path").endswith(".mp4")).select("path", "length")
    return archive.newest_first(files)


@query("archive_usage", f"""
WITH {b.ARCHIVE}, u AS (SELECT kind, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM archive GROUP BY kind)
SELECT kind, files, bytes, {s6('CAST(bytes AS DOUBLE) / (SELECT sum(bytes) FROM u)', 'share')} FROM u""")
def archive_usage(spark, root):
    return archive.usage(b.archive(spark, root), ["kind"]).withColumn("share", r6("share"))


@query("archive_usage_by_day", f"""
WITH {b.ARCHIVE}, u AS (SELECT left(path, 8) AS day_text, kind, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM archive GROUP BY ALL)
SELECT day_text, kind, files, bytes, {s6('CAST(bytes AS DOUBLE) / (SELECT sum(bytes) FROM u)', 'share')} FROM u""")
def archive_usage_by_day(spark, root):
    files = b.archive(spark, root).withColumn("day_text", archive.path_day(F.col("path")))
    return archive.usage(files, ["day_text", "kind"]).withColumn("share", r6("share"))


@query("keep_if_missing", f"""
WITH {b.ARCHIVE},
v AS (SELECT path, CAST(epoch(try_strptime(nullif(regexp_extract(path, 'video-([0-9]{{14}})\\.mp4', 1), ''), '%Y%m%d%H%M%S')) AS BIGINT) AS taken
      FROM archive WHERE path LIKE '%.mp4')
SELECT path, taken FROM v WHERE taken IS NULL OR taken BETWEEN 1704088800 AND 1704110400""")
def keep_if_missing(spark, root):
    files = archive.listing(b.archive(spark, root))
    return files.where(filters.keep_if_missing(F.col("taken"), 1704088800, 1704110400)).select("path", "taken")


@query("filter_or_all", f"""
WITH {b.OBS}
SELECT 'some' AS filter, event_id FROM obs WHERE stars > 900
UNION ALL SELECT 'none', event_id FROM obs""")
def filter_or_all(spark, root):
    rows = b.obs(spark, root).select("event_id", "stars")
    some = filters.filter_or_all(rows, F.col("stars") > 900).select(F.lit("some").alias("filter"), "event_id")
    none = filters.filter_or_all(rows, F.col("stars") > 10_000).select(F.lit("none").alias("filter"), "event_id")
    return some.unionByName(none)


# --- day and history reads --------------------------------------------------

DAY = "2024-01-10"


def _day(rows, columns):
    return rows.where(F.col("day") == F.lit(dt.date.fromisoformat(DAY))).select(*columns).orderBy("timestamp")


@query("day_image", f"WITH {b.OBS} SELECT {IMAGE} FROM obs WHERE day = DATE '{DAY}' ORDER BY timestamp")
def day_image(spark, root):
    return _day(b.obs(spark, root), schemas.IMAGE_COLUMNS)


@query("day_meteo", f"WITH {b.METEO} SELECT {', '.join(schemas.METEO_COLUMNS)} FROM meteo "
                    f"WHERE day = DATE '{DAY}' ORDER BY timestamp")
def day_meteo(spark, root):
    return _day(b.meteo(spark, root), schemas.METEO_COLUMNS)


@query("day_aurora", f"WITH {b.AURORA} SELECT {', '.join(schemas.AURORA_COLUMNS)} FROM aurora "
                     f"WHERE day = DATE '{DAY}' ORDER BY timestamp")
def day_aurora(spark, root):
    return _day(b.aurora(spark, root), schemas.AURORA_COLUMNS)


def _series_sql(source, series):
    return " UNION ALL ".join(
        f"SELECT event_id, '{name}' AS series, round(CAST({c} AS DOUBLE) / {d!r}e0, 6) + 0e0 AS value FROM {source}"
        .replace(".0e0", "e0") for name, (c, d) in series.items())


@query("chart_series", f"WITH {b.METEO} " + _series_sql("meteo", measurements.METEO_SERIES) + " UNION ALL "
       + _series_sql("obs", measurements.IMAGE_SERIES))
def chart_series(spark, root):
    weather = measurements.chart_series(b.meteo(spark, root), ["event_id"], measurements.METEO_SERIES)
    image = measurements.chart_series(b.obs(spark, root), ["event_id"], measurements.IMAGE_SERIES)
    return weather.unionByName(image).withColumn("value", r6("value"))


_HISTORY = f"""
WITH {b.OBS}
SELECT event_id, timestamp, timezone_offset FROM obs
WHERE timestamp BETWEEN {START} AND {END} AND night_mode = 1 AND hdr = 2 AND sqm >= 171e-1 AND sqm <= 19e0
  AND stars >= 100 AND stars <= 800"""


def _history(spark, root, **order):
    rows = measurements.history(b.obs(spark, root), START, END, night_mode="1", hdr=2, sqm_min="17.1", sqm_max=19,
                                stars_min="100", stars_max="800", **order)
    return rows.select("event_id", "timestamp", "timezone_offset")


@query("history", _HISTORY + " ORDER BY timestamp")
def history(spark, root):
    return _history(spark, root)


@query("history_desc", _HISTORY + " ORDER BY timestamp DESC")
def history_desc(spark, root):
    return _history(spark, root, descending=True)


@query("union_days", f"""
WITH {b.METEO}, {b.AURORA.split(b.OBS)[1].lstrip(',').lstrip()}
SELECT event_id, timestamp, temperature, humidity, CAST(NULL AS DOUBLE) AS kp_index FROM meteo
UNION ALL SELECT event_id, timestamp, temperature, NULL, kp_index FROM aurora""".replace(",\n\naurora", ", aurora"))
def union_days(spark, root):
    left = b.meteo(spark, root).select("event_id", "timestamp", "temperature", "humidity")
    right = b.aurora(spark, root).select("event_id", "timestamp", "temperature", "kp_index")
    return left.unionByName(right, allowMissingColumns=True)


def _time_texts(spark, root):
    o = b.obs(spark, root)
    stamp = text.epoch_to_stamp(F.col("timestamp"))
    start = F.when(F.col("k") % 5 == 0, F.lit("2024-01-01")).when(F.col("k") % 5 == 1, F.lit("20241350000000")).otherwise(stamp)
    end = F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 7 == 1, F.lit("20230101000000")).otherwise(stamp)
    return o.select("event_id", start.alias("start"), end.alias("end"))


@query("valid_timestamps", f"""
WITH {b.OBS},
t AS (SELECT event_id, timestamp,
        CASE k % 5 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '20241350000000' ELSE strftime(make_timestamp(timestamp * 1000000), '%Y%m%d%H%M%S') END AS "start",
        CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '20230101000000' ELSE strftime(make_timestamp(timestamp * 1000000), '%Y%m%d%H%M%S') END AS "end"
      FROM obs)
SELECT event_id, "start", "end",
       CASE WHEN "end" IS NULL THEN 'missing' WHEN length("start") <> 14 OR "start" = '20241350000000' THEN 'invalid'
            WHEN "start" > "end" THEN 'reversed' ELSE 'valid' END AS status
FROM t""")
def valid_timestamps(spark, root):
    valid, rejected = measurements.split_valid_times(_time_texts(spark, root), "start", "end")
    columns = ["event_id", "start", "end"]
    return valid.select(*columns, F.lit("valid").alias("status")).unionByName(
        rejected.select(*columns, F.col("reason").alias("status")))


@query("gated_metrics", f"""
WITH {b.OBS}
SELECT event_id, CASE WHEN exposure > 1 AND mean_g <= 21e-2 THEN sqm END AS sqm,
       CASE WHEN exposure > 1 AND mean_g <= 21e-2 THEN stars END AS stars,
       CASE WHEN night_mode = 1 AND gain > 0 THEN noise END AS noise
FROM obs WHERE night_mode = 1 OR station % 2 = 0""")
def gated_metrics(spark, root):
    rows = photometry.skip_daytime(b.obs(spark, root), F.col("station") % 2 == 0)
    return photometry.gate(rows).select("event_id", "sqm", "stars", "noise")


# --- station timelines ------------------------------------------------------

@query("night_end_events", f"""
WITH {b.OBS},
w AS (SELECT event_id, station, timestamp, night_mode,
             lag(night_mode) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS was FROM obs)
SELECT event_id, station, timestamp FROM w WHERE was = 1 AND night_mode = 0""")
def night_end_events(spark, root):
    rows = b.obs(spark, root).select("event_id", "station", "timestamp", "night_mode")
    ends = timeline.state_changes(rows, ["station"], "timestamp", "night_mode", ["event_id"], before=1, after=0)
    return ends.select("event_id", "station", "timestamp")


@query("hour_breaks", f"""
WITH {b.OBS},
h AS (SELECT event_id, station, timestamp, CAST(((timestamp + timezone_offset) % 86400) // 3600 AS INT) AS label FROM obs),
w AS (SELECT *, lag(label) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS was FROM h)
SELECT event_id, station, timestamp, label FROM w WHERE was IS NULL OR was <> label""")
def hour_breaks(spark, root):
    rows = b.obs(spark, root).select("event_id", "station", "timestamp", "timezone_offset")
    label = text.local_hour(F.col("timestamp"), F.col("timezone_offset"))
    return timeline.starts(rows, ["station"], "timestamp", label, ["event_id"]).drop("timezone_offset")


@query("capture_gaps", f"""
WITH {b.OBS},
w AS (SELECT event_id, station, timestamp, lag(timestamp) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS previous FROM obs)
SELECT *, timestamp - previous AS gap FROM w WHERE timestamp - previous > 43200""")
def capture_gaps(spark, root):
    rows = b.obs(spark, root).select("event_id", "station", "timestamp")
    return timeline.gaps(rows, ["station"], "timestamp", 43200, ["event_id"])


@query("rolling_median10", f"""
WITH {b.OBS}
SELECT event_id, {s6('avg(brightness) OVER (PARTITION BY station ORDER BY timestamp, event_id ROWS 9 PRECEDING)', 'rolling')}
FROM obs""")
def rolling_median10(spark, root):
    rows = b.obs(spark, root).select("event_id", "station", "timestamp", "brightness")
    out = timeline.rolling_mean(rows, ["station"], "timestamp", "brightness", 10, ["event_id"])
    return out.select("event_id", r6("rolling"))


def _ladder(spark, root):
    o = b.obs(spark, root).select("event_id", "exposure", "k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    frames = o.select("event_id", F.col("i").alias("index"),
                      timeline.ladder(F.col("exposure"), 2.7, F.col("i")).alias("exposure"), "k")
    return frames


@query("exposure_ladder", f"""
WITH {b.OBS} SELECT event_id, CAST(i AS INT) AS index, {s6('exposure / pow(2e0, i * 2)', 'exposure')} FROM obs, range(5) t(i)""")
def exposure_ladder(spark, root):
    return _ladder(spark, root).select("event_id", "index", r6("exposure"))


@query("bracket_prefix", f"""
WITH {b.OBS},
f AS (SELECT event_id, i AS index, exposure / pow(2e0, i * 2) AS exposure, CASE WHEN i < k % 6 THEN 1 ELSE 0 END AS overexposed
      FROM obs, range(5) t(i)),
cut AS (SELECT event_id, coalesce(min(index) FILTER (WHERE overexposed = 0), 4) AS last_ok,
               coalesce(min(index) FILTER (WHERE exposure < 5e-2 AND index > 0), 5) AS first_short FROM f GROUP BY event_id),
taken AS (SELECT f.* FROM f JOIN cut USING (event_id) WHERE index <= last_ok AND index < first_short)
SELECT event_id, CAST(index AS INT) AS index, {s6('exposure', 'exposure')}, overexposed,
       CAST(CASE WHEN sum(overexposed) OVER (PARTITION BY event_id) = 0 THEN 1
            ELSE least(count(*) OVER (PARTITION BY event_id), 3) END AS INT) AS n_fused
FROM taken""")
def bracket_prefix(spark, root):
    frames = _ladder(spark, root).withColumn("overexposed", (F.col("index") < F.col("k") % 6).cast("int")).drop("k")
    taken = timeline.bracket_prefix(frames, ["event_id"], "index", minimum=0.05)
    return taken.withColumn("exposure", r6("exposure"))


# --- scoring ----------------------------------------------------------------

def _brightest_channel():
    """Stand-in model: the score of class i is the share of channel i."""
    def score(batch):
        import pandas as pd

        total = batch[["r", "g", "b"]].sum(axis=1)
        parts = []
        for i, c in enumerate("rgb"):
            parts.append(pd.DataFrame({"image": batch["image"], "class_idx": i,
                                       "score": (batch[c] / total).fillna(0.0)}))
        return pd.concat(parts)

    return score


@query("score_frames", f"""
WITH {b.PIXELS}, m AS (SELECT frame_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY 1),
s AS (SELECT 'frame-' || frame_id AS image, unnest([0, 1, 2]) AS class_idx, unnest([r, g, b]) AS v, r + g + b AS total FROM m)
SELECT image, class_idx, {s6('CASE WHEN total = 0 THEN 0e0 ELSE v / total END', 'score')} FROM s""")
def score_frames(spark, root):
    p = b.pixels(spark, root).groupBy("frame_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    frames = p.select(F.concat(F.lit("frame-"), F.col("frame_id").cast("string")).alias("image"), "r", "g", "b")
    return scoring.score_frames(frames, _brightest_channel).withColumn("score", r6("score"))

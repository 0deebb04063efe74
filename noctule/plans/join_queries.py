"""Queries that join observations with feeds, grids and sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctule.functions import text
from noctule.operators import filters, nearest, spatial
from noctule.plans import bindings as b
from noctule.plans.registry import query, r6, s6

_PAYLOAD_SQL = {
    "kp": ("signup", {"kp_index": "value / 50"}),
    "mag": ("click", {"bt": "value / 20 - 1", "bz": "value / 20 - 5"}),
    "plasma": ("purchase", {"density": "value / 40 - 0.2", "speed": "value + 300", "temperature": "value * 1000"}),
}


def _right(spark, root, kind):
    feed, columns = _PAYLOAD_SQL[kind]
    return b.obs(spark, root).where(F.col("feed") == feed).select(
        F.col("event_id").alias("pos"), "timestamp",
        *[F.expr(e.replace("0.2", "0.2D")).alias(c) for c, e in columns.items()])


def _left(spark, root):
    return b.obs(spark, root).where("feed = 'view'").select("event_id", "station", "timestamp")


def _nearest_sql(kind, floors=None):
    feed, columns = _PAYLOAD_SQL[kind]
    fields = ", ".join(f"{e.replace('0.2', '2e-1')} AS {c}" for c, e in columns.items())
    ok = " AND ".join(f"m.{c} >= {f}" for c, f in (floors or {}).items()) or "TRUE"
    out = ", ".join(f"round(CASE WHEN {ok} THEN m.{c} END, 6) + 0e0 AS {c}" for c in columns)
    return f"""
WITH {b.OBS},
r AS (SELECT event_id AS pos, timestamp AS matched_time, {fields} FROM obs WHERE feed = '{feed}'),
l AS (SELECT event_id, timestamp FROM obs WHERE feed = 'view'),
m AS (SELECT l.event_id, arg_min(r, (abs(l.timestamp - r.matched_time), r.matched_time, r.pos)) AS m FROM l, r GROUP BY 1)
SELECT event_id, CASE WHEN {ok} THEN m.matched_time END AS matched_time, {out} FROM m"""


def _nearest(spark, root, kind, floors=None):
    columns = list(_PAYLOAD_SQL[kind][1])
    rows = nearest.nearest(_left(spark, root), _right(spark, root, kind), "timestamp", "timestamp", columns, ["pos"])
    if floors:
        rows = nearest.reject_invalid(rows, columns, floors)
    return rows.select("event_id", "matched_time", *[r6(c) for c in columns])


@query("nearest_kp", _nearest_sql("kp"))
def nearest_kp(spark, root):
    return _nearest(spark, root, "kp")


MAG_FLOORS = {"bt": 0, "bz": -100000}
PLASMA_FLOORS = {"density": 0, "speed": 0, "temperature": 0}


@query("nearest_mag", _nearest_sql("mag", MAG_FLOORS))
def nearest_mag(spark, root):
    return _nearest(spark, root, "mag", MAG_FLOORS)


@query("nearest_plasma", _nearest_sql("plasma", PLASMA_FLOORS))
def nearest_plasma(spark, root):
    return _nearest(spark, root, "plasma", PLASMA_FLOORS)


@query("nearest_by_station", f"""
WITH {b.OBS},
l AS (SELECT event_id, station, timestamp FROM obs WHERE feed = 'view'),
r AS (SELECT event_id AS pos, station, timestamp AS matched_time, value FROM obs WHERE feed <> 'view'),
m AS (SELECT l.event_id, arg_min(r, (abs(l.timestamp - r.matched_time), r.matched_time, r.pos)) AS m
      FROM l JOIN r ON l.station = r.station AND abs(l.timestamp - r.matched_time) < 7200 GROUP BY 1)
SELECT l.event_id, m.m.matched_time AS matched_time, m.m.value AS value FROM l LEFT JOIN m ON l.event_id = m.event_id""")
def nearest_by_station(spark, root):
    right = b.obs(spark, root).where("feed <> 'view'").select(
        F.col("event_id").alias("pos"), "station", "timestamp", "value")
    rows = nearest.nearest(_left(spark, root), right, "timestamp", "timestamp", ["value"], ["pos"], by=["station"],
                           tolerance=7200)
    return rows.select("event_id", "matched_time", "value")


HOURS = """
hours AS (SELECT timestamp // 3600 AS hour, avg(value) / 1e1 - 5e0 AS temperature, avg(k) AS humidity
          FROM obs GROUP BY 1)
"""


def _weather(spark, root):
    """Hourly weather from the mean of an hour's observations."""
    o = b.obs(spark, root)
    return o.groupBy(F.floor(F.col("timestamp") / 3600).alias("hour")).agg(
        (F.avg("value") / 10.0 - 5.0).alias("temperature"), F.avg("k").alias("humidity")).select(
        F.lit(0).alias("pos"), (F.col("hour") * 3600).alias("timestamp"), "temperature", "humidity")


@query("hour_join", f"""
WITH {b.OBS}, {HOURS}
SELECT o.event_id, {s6('h.temperature', 'temperature')}, {s6('h.humidity', 'humidity')}
FROM obs o JOIN hours h ON o.timestamp // 3600 = h.hour WHERE o.feed = 'view'""")
def hour_join(spark, root):
    rows = nearest.by_hour(_left(spark, root), _weather(spark, root), "timestamp", "timestamp",
                           ["temperature", "humidity"], ["timestamp", "pos"])
    return rows.select("event_id", r6("temperature"), r6("humidity"))


@query("enriched_observations", f"""
WITH {b.OBS}, {HOURS},
l AS (SELECT * FROM obs WHERE feed = 'view'),
rk AS (SELECT event_id AS pos, timestamp AS t, value / 50 AS kp_index FROM obs WHERE feed = 'signup'),
rm AS (SELECT event_id AS pos, timestamp AS t, value / 20 - 1 AS bt, value / 20 - 5 AS bz FROM obs WHERE feed = 'click'),
mk AS (SELECT l.event_id, arg_min(rk, (abs(l.timestamp - rk.t), rk.t, rk.pos)) AS m FROM l, rk GROUP BY 1),
mm AS (SELECT l.event_id, arg_min(rm, (abs(l.timestamp - rm.t), rm.t, rm.pos)) AS m FROM l, rm GROUP BY 1)
SELECT l.event_id, l.station, l.timestamp, {s6('l.brightness', 'brightness')}, l.night_mode, {s6('l.sqm', 'sqm')},
       {s6('mk.m.kp_index', 'kp_index')}, round(CASE WHEN mm.m.bt >= 0 THEN mm.m.bt END, 6) + 0e0 AS bt,
       round(CASE WHEN mm.m.bt >= 0 THEN mm.m.bz END, 6) + 0e0 AS bz,
       {s6('h.temperature', 'temperature')}, {s6('h.humidity', 'humidity')}
FROM l LEFT JOIN mk ON mk.event_id = l.event_id LEFT JOIN mm ON mm.event_id = l.event_id
LEFT JOIN hours h ON h.hour = l.timestamp // 3600""")
def enriched_observations(spark, root):
    rows = b.obs(spark, root).where("feed = 'view'").select(
        "event_id", "station", "timestamp", "brightness", "night_mode", "sqm")
    rows = nearest.nearest_all(rows, "timestamp", [
        nearest.Lookup(_right(spark, root, "kp"), "timestamp", ["kp_index"], ["pos"], matched_time="kp_time"),
        nearest.Lookup(_right(spark, root, "mag"), "timestamp", ["bt", "bz"], ["pos"], matched_time="mag_time")])
    rows = nearest.reject_invalid(rows, ["bt", "bz"], MAG_FLOORS, "mag_time")
    rows = nearest.by_hour(rows, _weather(spark, root), "timestamp", "timestamp", ["temperature", "humidity"],
                           ["timestamp", "pos"], how="left")
    return rows.select("event_id", "station", "timestamp", r6("brightness"), "night_mode", r6("sqm"), r6("kp_index"),
                       r6("bt"), r6("bz"), r6("temperature"), r6("humidity"))


@query("nearest_grid", f"""
WITH {b.GRID},
m AS (SELECT s.site, arg_min({{'val': g.val, 'd': (g.lon - s.lon) * (g.lon - s.lon) + (g.lat - s.lat) * (g.lat - s.lat)}},
        ((g.lon - s.lon) * (g.lon - s.lon) + (g.lat - s.lat) * (g.lat - s.lat), g.pos)) AS m FROM sites s, grid g GROUP BY 1)
SELECT site, m.val AS val, {s6('sqrt(m.d)', 'distance')} FROM m""")
def nearest_grid(spark, root):
    rows = spatial.nearest_point(b.sites(spark, root), b.grid(spark, root))
    return rows.select("site", "val", r6("distance"))


#: Three grid points a document, 0.1 degree apart in a quarter of the sky: dense, with gaps, and far from most sites.
DENSE = """dense AS (
  SELECT doc_id * 3 + k AS pos, (doc_id * 7 + k * 1301) % 900 * 1e-1 AS lon, ((doc_id * 11 + k * 577) // 7) % 300 * 1e-1 AS lat, coalesce(n_chars, 0) AS val
  FROM documents, range(3) r(k))"""


def _dense(spark, root):
    k, doc = F.col("k"), F.col("doc_id")
    rows = b.table(spark, root, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return rows.select((doc * 3 + k).alias("pos"), ((doc * 7 + k * 1301) % 900 * 0.1).alias("lon"),
                       (F.floor((doc * 11 + k * 577) / 7) % 300 * 0.1).alias("lat"), F.coalesce("n_chars", F.lit(0)).alias("val"))


@query("nearest_grid_dense", f"""
WITH {b.GRID}, {DENSE},
m AS (SELECT s.site, arg_min({{'val': g.val, 'd': (g.lon - s.lon) * (g.lon - s.lon) + (g.lat - s.lat) * (g.lat - s.lat)}},
        ((g.lon - s.lon) * (g.lon - s.lon) + (g.lat - s.lat) * (g.lat - s.lat), g.pos)) AS m FROM sites s, dense g GROUP BY 1)
SELECT site, m.val AS val, {s6('sqrt(m.d)', 'distance')} FROM m""")
def nearest_grid_dense(spark, root):
    rows = spatial.nearest_point(b.sites(spark, root), _dense(spark, root))
    return rows.select("site", "val", r6("distance"))


@query("box_stats", f"""
WITH {b.GRID}
SELECT site, max(val) AS max_val, {s6('avg(val)', 'avg_val')}, count(*) AS n_points
FROM sites s JOIN grid g ON abs(g.lat - s.lat) <= 25e-1 AND abs(g.lon - s.lon) <= 25e-1 GROUP BY site""")
def box_stats(spark, root):
    rows = spatial.box_statistics(b.sites(spark, root), b.grid(spark, root))
    return rows.select("site", "max_val", r6("avg_val"), "n_points")



@query("history_moon", f"""
WITH {b.OBS},
side AS (SELECT event_id, CASE WHEN k % 7 <> 0 THEN value / 4e0 - 2e1 END AS moon_altitude FROM obs WHERE k % 4 <> 0)
SELECT o.event_id, o.timestamp, {s6('s.moon_altitude', 'moon_altitude')} FROM obs o LEFT JOIN side s USING (event_id)
WHERE o.night_mode = 1 AND (s.moon_altitude IS NULL OR s.moon_altitude BETWEEN -10 AND 20)""")
def history_moon(spark, root):
    o = b.obs(spark, root)
    sidecars = o.where("k % 4 <> 0").select(
        "event_id", F.when(F.col("k") % 7 != 0, F.col("value") / 4.0 - 20.0).alias("moon_altitude"))
    rows = filters.with_sidecar(o.where("night_mode = 1").select("event_id", "timestamp"), sidecars, ["event_id"])
    rows = rows.where(filters.keep_if_missing(F.col("moon_altitude"), -10, 20))
    return rows.select("event_id", "timestamp", r6("moon_altitude"))


# --- texts and scalars over rows --------------------------------------------

@query("ts_text", f"""
WITH {b.OBS}
SELECT event_id, strftime(make_timestamp(timestamp * 1000000), '%Y%m%d%H%M%S') AS stamp, timestamp AS back,
       strftime(make_timestamp((timestamp + timezone_offset) * 1000000), '%Y-%m-%d %H:%M:%S') AS local
FROM obs""")
def ts_text(spark, root):
    o = b.obs(spark, root)
    stamp = text.epoch_to_stamp(F.col("timestamp"))
    return o.select("event_id", stamp.alias("stamp"), text.stamp_to_epoch(stamp).alias("back"),
                    text.epoch_to_local(F.col("timestamp"), F.col("timezone_offset")).alias("local"))


@query("parse_coordinate", """
WITH t AS (SELECT c_custkey AS site, (c_custkey * 37) % 9000 / 1e2 AS v, c_custkey % 6 AS m FROM customer)
SELECT site, round(CASE m WHEN 0 THEN v WHEN 1 THEN -v WHEN 2 THEN -v WHEN 3 THEN v WHEN 4 THEN -v END, 6) + 0e0 AS degrees
FROM t""")
def parse_coordinate(spark, root):
    c = F.col("c_custkey")
    v = ((c * 37) % 9000 / 100.0).cast("string")
    form = F.array(F.concat(v, F.lit("N")), F.concat(v, F.lit(" s")), F.concat(F.lit("-"), v), F.concat(v, F.lit(" E")),
                   F.concat(v, F.lit("W")), F.concat(v, F.lit("x")))
    rows = b.table(spark, root, "customer").select(c.alias("site"), F.get(form, (c % 6).cast("int")).alias("text"))
    return rows.select("site", r6(text.parse_coordinate(F.col("text")), "degrees"))


@query("format_radec", """
WITH t AS (SELECT c_custkey AS site, (c_custkey * 739) % 36000 / 1e2 AS ra, (c_custkey * 379) % 18000 / 1e2 - 9e1 AS dec FROM customer),
u AS (SELECT *, ra / 15 AS h, abs(dec) AS a FROM t),
w AS (SELECT *, (h - floor(h)) * 60 AS hm, (a - floor(a)) * 60 AS am FROM u)
SELECT site, lpad(CAST(CAST(floor(h) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(hm) AS INT) AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(CAST(floor((hm - floor(hm)) * 60 + 5e-1) AS INT) AS VARCHAR), 2, '0') AS ra_text,
       CASE WHEN dec < 0 THEN '-' ELSE '+' END || lpad(CAST(CAST(floor(a) AS INT) AS VARCHAR), 2, '0') || '°' ||
         lpad(CAST(CAST(floor(am) AS INT) AS VARCHAR), 2, '0') || '′' ||
         lpad(CAST(CAST(floor((am - floor(am)) * 60 + 5e-1) AS INT) AS VARCHAR), 2, '0') || '″' AS dec_text
FROM w""")
def format_radec(spark, root):
    c = F.col("c_custkey")
    rows = b.table(spark, root, "customer").select(
        c.alias("site"), ((c * 739) % 36000 / 100.0).alias("ra"), ((c * 379) % 18000 / 100.0 - 90.0).alias("dec"))
    return rows.select("site", text.ra_text(F.col("ra"), carry=False).alias("ra_text"),
                       text.dec_text(F.col("dec"), carry=False).alias("dec_text"))


@query("format_radec_carried", """
WITH t AS (SELECT c_custkey AS site, (c_custkey * 739) % 36000 / 1e2 AS ra, (c_custkey * 379) % 18000 / 1e2 - 9e1 AS dec FROM customer),
u AS (SELECT *, CAST(floor(ra / 15 * 3600 + 5e-1) AS BIGINT) AS h, CAST(floor(abs(dec) * 3600 + 5e-1) AS BIGINT) AS a FROM t)
SELECT site, lpad(CAST(h // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(h // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(h % 60 AS VARCHAR), 2, '0') AS ra_text,
       CASE WHEN dec < 0 THEN '-' ELSE '+' END || lpad(CAST(a // 3600 AS VARCHAR), 2, '0') || '°' || lpad(CAST(a // 60 % 60 AS VARCHAR), 2, '0') || '′' ||
         lpad(CAST(a % 60 AS VARCHAR), 2, '0') || '″' AS dec_text
FROM u""")
def format_radec_carried(spark, root):
    c = F.col("c_custkey")
    rows = b.table(spark, root, "customer").select(
        c.alias("site"), ((c * 739) % 36000 / 100.0).alias("ra"), ((c * 379) % 18000 / 100.0 - 90.0).alias("dec"))
    return rows.select("site", text.ra_text(F.col("ra")).alias("ra_text"), text.dec_text(F.col("dec")).alias("dec_text"))

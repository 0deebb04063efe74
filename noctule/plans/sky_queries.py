"""Queries over celestial positions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from noctule.functions import labels, sky, text
from noctule.operators import catalog
from noctule.plans import bindings as b
from noctule.plans.measurement_queries import COMETS, comet_docs
from noctule.plans.registry import query, r6, s6
from noctule.sources import feeds

LAT, LON = b.LAT, b.LON


# --- SQL twins of the series (degree-based macros written out) --------------

def _rad(e):
    return f"radians({e})"


def _days(t):
    return f"({t} / 864e2 + 24405875e-1 - 2451545e0)"


def _wrap(e):
    r = f"(({e}) % 360e0)"
    return f"(CASE WHEN {r} < 0 THEN ({r} + 360e0) % 360e0 ELSE {r} END)"


def _lst(t):
    d = _days(t)
    gmst = (f"28046061837e-8 + 36098564736629e-11 * {d} + 387933e-9 * ({d}/36525e0) * ({d}/36525e0) "
            f"- ({d}/36525e0) * ({d}/36525e0) * ({d}/36525e0) / 3871e4")
    # positive for any date after 1999
    return f"((({gmst}) % 360e0 + {LON}::DOUBLE) % 360e0)"


def _eps(t):
    c = f"({_days(t)} / 36525e0)"
    return f"(23e0 + 26e0/6e1 + (21448e-3 - 46815e-3 * {c} - 59e-5 * {c} * {c} + 1813e-6 * {c} * {c} * {c}) / 36e2)"


def _sun_lon(t):
    d = _days(t)
    g = f"radians(357528e-3 + 9856003e-7 * {d})"
    return _wrap(f"28046e-2 + 9856474e-7 * {d} + 1915e-3 * sin({g}) + 2e-2 * sin(2 * {g})")


def _sum(t, terms):
    c = f"({_days(t)} / 36525e0)"
    return "(" + " + ".join(f"{a!r}::DOUBLE * sin(radians({p!r}::DOUBLE + {r!r}::DOUBLE * {c}))" for a, p, r in terms) + ")"


def _moon_lon(t):
    return _wrap(f"21832e-2 + 481267881e-3 * ({_days(t)} / 36525e0) + {_sum(t, sky.MOON_LONGITUDE_TERMS)}")


def _moon_lat(t):
    return _sum(t, sky.MOON_LATITUDE_TERMS)


def _positions(source, t="t", lst=True):
    """CTE chain: ecliptic, equatorial and altitude of sun and moon for rows of `source`."""
    hor = ", ".join(
        f"degrees(asin(least(greatest(sin(radians({o}_dec)) * sin(radians({LAT}::DOUBLE)) + cos(radians({o}_dec)) * cos(radians({LAT}::DOUBLE)) "
        f"* cos(radians(lst - {o}_ra)), -1e0), 1e0))) AS {o}_alt" for o in ("sun", "moon"))
    return f"""
ecl AS (SELECT *, {_sun_lon(t)} AS sl, {_moon_lon(t)} AS ml, {_moon_lat(t)} AS mb, {_eps(t)} AS eps, {_lst(t)} AS lst FROM {source}),
equ AS (SELECT *,
    ((degrees(atan2(sin(radians(sl)) * cos(radians(eps)), cos(radians(sl)))) + 360e0) % 360e0) AS sun_ra,
    degrees(asin(sin(radians(eps)) * sin(radians(sl)))) AS sun_dec,
    ((degrees(atan2(sin(radians(ml)) * cos(radians(eps)) - tan(radians(mb)) * sin(radians(eps)), cos(radians(ml)))) + 360e0) % 360e0) AS moon_ra,
    degrees(asin(sin(radians(mb)) * cos(radians(eps)) + cos(radians(mb)) * sin(radians(eps)) * sin(radians(ml)))) AS moon_dec FROM ecl),
hor AS (SELECT *, {hor} FROM equ)
"""


_T = f"WITH {b.OBS}, src AS (SELECT event_id, timestamp AS t, timezone_offset, k, value FROM obs), {_positions('src')}"


def _obs(spark, root):
    return b.obs(spark, root)


@query("sidereal", f"{_T} SELECT event_id, {s6('t / 864e2 + 24405875e-1', 'jd')}, {s6('lst', 'lst')}, {s6('eps', 'obliquity')} FROM hor")
def sidereal(spark, root):
    t = F.col("timestamp")
    return _obs(spark, root).select("event_id", r6(sky.julian_date(t), "jd"), r6(sky.sidereal_time(t, LON), "lst"),
                                    r6(sky.obliquity(t), "obliquity"))


@query("moon_radec", f"{_T} SELECT event_id, {s6('moon_ra', 'ra')}, {s6('moon_dec', 'dec')}, {s6('sun_ra', 'sun_ra')}, {s6('sun_dec', 'sun_dec')} FROM hor")
def moon_radec(spark, root):
    t = F.col("timestamp")
    ra, dec = sky.moon_position(t)
    sun_ra, sun_dec = sky.sun_position(t)
    return _obs(spark, root).select("event_id", r6(ra, "ra"), r6(dec, "dec"), r6(sun_ra, "sun_ra"), r6(sun_dec, "sun_dec"))


@query("sun_altitude", f"{_T} SELECT event_id, {s6('sun_alt', 'altitude')} FROM hor")
def sun_altitude(spark, root):
    return _obs(spark, root).select("event_id", r6(sky.sun_altitude(F.col("timestamp"), LAT, LON), "altitude"))


@query("moon_altitude", f"{_T} SELECT event_id, {s6('moon_alt', 'altitude')} FROM hor")
def moon_altitude(spark, root):
    return _obs(spark, root).select("event_id", r6(sky.moon_altitude(F.col("timestamp"), LAT, LON), "altitude"))


@query("night_flags", f"""{_T} SELECT event_id, CAST(sun_alt < -6 AS INT) AS night, CAST(sun_alt < -18 AS INT) AS astronomical,
  0 AS far_north, CAST(sun_alt < -12 AS INT) AS nautical FROM hor""")
def night_flags(spark, root):
    t = F.col("timestamp")
    return _obs(spark, root).select(
        "event_id", sky.is_night(t, LAT, LON).alias("night"), sky.is_astronomical_night(t, LAT, LON).alias("astronomical"),
        sky.is_night(t, 65.0, LON).alias("far_north"), sky.sun_below(t, LAT, LON, 12.0, None).alias("nautical"))


@query("moon_phase", f"""{_T}, p AS (SELECT event_id, {_wrap('ml - sl')} AS e, mb FROM hor), a AS (SELECT *, e / 360 * 29530588853e-9 AS age FROM p)
SELECT event_id, {s6('age', 'age')}, {s6('(1 - cos(acos(cos(radians(mb)) * cos(radians(e))))) / 2 * 100', 'illumination')},
  CASE WHEN age < 184566e-5 THEN 'New moon' WHEN age < 553699e-5 THEN 'Waxing crescent moon' WHEN age < 922831e-5 THEN 'First quarter moon'
   WHEN age < 1291963e-5 THEN 'Waxing gibbous moon' WHEN age < 1661096e-5 THEN 'Full moon' WHEN age < 2030228e-5 THEN 'Waning gibbous moon'
   WHEN age < 2399361e-5 THEN 'Last quarter moon' ELSE 'Waning crescent moon' END AS phase FROM a""")
def moon_phase(spark, root):
    t = F.col("timestamp")
    return _obs(spark, root).select("event_id", r6(sky.moon_age(t), "age"), r6(sky.moon_illumination(t), "illumination"),
                                    sky.moon_phase(sky.moon_age(t)).alias("phase"))


# --- coordinates ------------------------------------------------------------

_AZ = "(k * 361e-2)"
_ALT = "(value % 9e1)"


@query("azalt_radec", f"""{_T},
d AS (SELECT event_id, lst, radians({_AZ}) AS az, radians({_ALT}) AS al, radians({LAT}::DOUBLE) AS ph FROM hor),
e AS (SELECT *, asin(least(greatest(sin(al) * sin(ph) + cos(al) * cos(ph) * cos(az), -1e0), 1e0)) AS de FROM d),
h AS (SELECT *, degrees(atan2(-sin(az) * cos(al) / cos(de), least(greatest((sin(al) - sin(ph) * sin(de)) / (cos(ph) * cos(de)), -1e0), 1e0))) AS ha FROM e)
SELECT event_id, {s6(_wrap('lst - ha'), 'ra')}, {s6('degrees(de)', 'dec')} FROM h""")
def azalt_radec(spark, root):
    az, alt, t = F.col("k") * 3.61, F.pmod(F.col("value"), F.lit(90.0)), F.col("timestamp")
    return _obs(spark, root).select("event_id", r6(sky.right_ascension_of(az, alt, LAT, LON, t), "ra"),
                                    r6(sky.declination_of(az, alt, LAT), "dec"))


@query("image_xy", f"""WITH {b.OBS}, p AS (SELECT event_id, radians(((360 - {_AZ}) % 360e0 + 360e0) % 360e0 + 15e0) AS an, {_ALT} AS al FROM obs)
SELECT event_id, {s6('500 + sin(an) * (400 * (90 - al) / 90)', 'x')}, {s6('480 - cos(an) * (400 * (90 - al) / 90)', 'y')},
  {s6('500 + sin(an) * (400 * sin(radians(90 - al)))', 'x_sinus')}, {s6('480 - cos(an) * (400 * sin(radians(90 - al)))', 'y_sinus')} FROM p""")
def image_xy(spark, root):
    az, alt = F.col("k") * 3.61, F.pmod(F.col("value"), F.lit(90.0))
    x, y = sky.image_position(az, alt, 500.0, 480.0, 400.0, 15.0)
    xs, ys = sky.image_position(az, alt, 500.0, 480.0, 400.0, 15.0, "sinus")
    return _obs(spark, root).select("event_id", r6(x, "x"), r6(y, "y"), r6(xs, "x_sinus"), r6(ys, "y_sinus"))


_STAR_ROWS = ", ".join(f"('{n}', {ra!r}::DOUBLE, {de!r}::DOUBLE)" for n, ra, de in catalog.BRIGHT_STARS)


def _horizontal_sql(source):
    """Altitude and azimuth for rows with lst, ra, dec."""
    return f"""
ha AS (SELECT *, radians({_wrap('lst - ra')}) AS h, radians(dec) AS de, radians({LAT}::DOUBLE) AS ph FROM {source}),
al AS (SELECT *, asin(least(greatest(sin(de) * sin(ph) + cos(de) * cos(ph) * cos(h), -1e0), 1e0)) AS a FROM ha),
az AS (SELECT *, degrees(acos(least(greatest((sin(de) - sin(a) * sin(ph)) / (cos(a) * cos(ph)), -1e0), 1e0))) AS z FROM al WHERE degrees(a) >= 0)
"""


_HOR_OUT = f"{s6('degrees(a)', 'altitude')}, {s6('CASE WHEN sin(h) > 0 THEN 360 - z ELSE z END', 'azimuth')}"


@query("visible_objects", f"""
WITH {b.OBS}, src AS (SELECT event_id, {_lst('timestamp')} AS lst FROM obs),
st AS (SELECT * FROM (VALUES {_STAR_ROWS}) t(name, ra, dec)), so AS (SELECT * FROM src, st), {_horizontal_sql('so')}
SELECT event_id, name, {_HOR_OUT} FROM az""")
def visible_objects(spark, root):
    rows = catalog.visible_stars(_obs(spark, root), ["event_id", "timestamp"], LAT, LON)
    return rows.select("event_id", "name", r6("altitude"), r6("azimuth"))


@query("visible_comets", f"""
WITH {b.OBS}, {COMETS},
cd AS (SELECT *, DATE '2024-01-01' + CAST(doc_id % 3000 AS INT) AS day FROM comets),
src AS (SELECT event_id, day, {_lst('timestamp')} AS lst FROM obs), so AS (SELECT s.*, c.name, c.ra, c.dec FROM src s JOIN cd c USING (day)),
{_horizontal_sql('so')} SELECT event_id, name, {_HOR_OUT} FROM az""")
def visible_comets(spark, root):
    comets = feeds.read_comets(comet_docs(spark, root), ["doc_id"])
    comets = comets.select("name", "ra", "dec", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 3000).cast("int")).alias("day"))
    rows = catalog.visible_objects(_obs(spark, root), comets, ["event_id", "timestamp"], LAT, LON)
    return rows.select("event_id", "name", r6("altitude"), r6("azimuth"))


_SHOWER_ROWS = ", ".join(
    f"('{code}', '{n}', {s[0]}, {s[1]}, {e[0]}, {e[1]}, {(p[0] + q[0]) / 2!r}::DOUBLE, {(p[1] + q[1]) / 2!r}::DOUBLE)"
    for code, (n, s, e, p, q) in catalog.METEOR_SHOWERS.items())
_SHOWERS = f"sh AS (SELECT * FROM (VALUES {_SHOWER_ROWS}) t(code, name, m0, d0, m1, d1, ra, dec))"


def _active(day):
    y = f"year({day})"
    start = f"make_date(CASE WHEN m0 > m1 AND {day} <= make_date({y}, m1, d1) THEN {y} - 1 ELSE {y} END, m0, d0)"
    end = f"make_date(CASE WHEN m0 > m1 AND {day} > make_date({y}, m1, d1) THEN {y} + 1 ELSE {y} END, m1, d1)"
    return f"{day} BETWEEN {start} AND {end}"


@query("active_showers", f"""
WITH {_SHOWERS}, o AS (SELECT o_orderkey, o_orderdate AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders))
SELECT o_orderkey, code, {s6('ra', 'ra')}, {s6('dec', 'dec')} FROM o JOIN sh ON {_active('day')}""")
def active_showers(spark, root):
    rows = b.table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return catalog.active_showers(rows, ["o_orderkey"]).select("o_orderkey", "code", r6("ra"), r6("dec"))


_DAYS = f"dd AS (SELECT DISTINCT day FROM obs), src AS (SELECT CAST(epoch(day) AS BIGINT) + 43200 AS t FROM dd)"


@query("sky_catalogue", f"""
WITH {b.OBS}, {COMETS}, {_SHOWERS}, st AS (SELECT * FROM (VALUES {_STAR_ROWS}) t(name, ra, dec)), {_DAYS}, {_positions('src')}
SELECT t AS timestamp, 'star' AS kind, name, {s6('ra', 'ra')}, {s6('dec', 'dec')} FROM src, st
UNION ALL SELECT t, 'shower', name, round(ra, 6) + 0e0, round(dec, 6) + 0e0 FROM src JOIN sh ON {_active('CAST(make_timestamp(t * 1000000) AS DATE)')}
UNION ALL SELECT t, 'sun', 'sun', round(sun_ra, 6) + 0e0, round(sun_dec, 6) + 0e0 FROM hor
UNION ALL SELECT t, 'moon', 'moon', round(moon_ra, 6) + 0e0, round(moon_dec, 6) + 0e0 FROM hor
UNION ALL SELECT CAST(1704110400 + doc_id AS BIGINT), 'comet', name, ra, dec FROM comets""")
def sky_catalogue(spark, root):
    times = _obs(spark, root).groupBy("day").agg((F.floor(F.min("timestamp") / 86400) * 86400 + 43200).alias("timestamp"))
    comets = feeds.read_comets(comet_docs(spark, root), ["doc_id"]).withColumn("timestamp", F.col("doc_id") + 1704110400)
    rows = catalog.all_objects(comets, times.select("timestamp"))
    return rows.select("timestamp", "kind", "name", r6("ra"), r6("dec"))


# --- rise and set -----------------------------------------------------------

_STATION_DAYS = """
sd AS (SELECT DISTINCT station, timezone_offset, CAST((timestamp + timezone_offset) // 86400 * 86400 - timezone_offset AS BIGINT) AS day_start FROM obs),
ds AS (SELECT DISTINCT day_start FROM sd),
src AS (SELECT day_start, CAST(day_start + i * 300 AS BIGINT) AS t FROM ds, range(288) g(i))
"""


def _cross_sql(column, level="0"):
    return f"""
lg AS (SELECT day_start, t, {column} - ({level}) AS a, lag({column} - ({level})) OVER (PARTITION BY day_start ORDER BY t) AS p FROM hor),
rs AS (SELECT day_start, min(t) FILTER (p < 0 AND a >= 0) AS rise, min(t) FILTER (p > 0 AND a <= 0) AS set FROM lg GROUP BY 1)
"""


def _station_days(spark, root):
    o = _obs(spark, root)
    start = sky.local_day_start(F.col("timestamp"), F.col("timezone_offset"))
    return o.select("station", "timezone_offset", start.alias("day_start")).groupBy("station", "timezone_offset", "day_start").agg(
        F.lit(1).alias("_one")).drop("_one")


@query("rise_set", f"WITH {b.OBS}, {_STATION_DAYS}, {_positions('src')}, {_cross_sql('moon_alt')} "
                   "SELECT station, day_start, rise, set FROM sd JOIN rs USING (day_start)")
def rise_set(spark, root):
    rows = catalog.rise_set(_station_days(spark, root), "moon", LAT, LON)
    return rows.select("station", "day_start", "rise", "set")


@query("civil_twilight", f"WITH {b.OBS}, {_STATION_DAYS}, {_positions('src')}, {_cross_sql('sun_alt', '-6')} "
                         "SELECT station, day_start, rise AS dawn, set AS dusk FROM sd JOIN rs USING (day_start)")
def civil_twilight(spark, root):
    rows = catalog.rise_set(_station_days(spark, root), "sun", LAT, LON, threshold=-6.0, names=("dawn", "dusk"))
    return rows.select("station", "day_start", "dawn", "dusk")


def _halve_sql():
    """Twenty halvings as a recursive table, for sunrise."""
    alt = (f"degrees(asin(sin(radians(de)) * sin(radians({LAT}::DOUBLE)) + cos(radians(de)) * cos(radians({LAT}::DOUBLE)) * cos(radians(ls - ra))))")
    mid = "((lo + hi) / 2)"
    return f"""
bis AS (SELECT day_start, 0 AS i, CAST(rise - 300 AS DOUBLE) AS lo, CAST(rise AS DOUBLE) AS hi FROM rs WHERE rise IS NOT NULL
  UNION ALL
  SELECT day_start, i + 1, CASE WHEN alt >= 0 THEN lo ELSE mid END, CASE WHEN alt >= 0 THEN mid ELSE hi END FROM (
    SELECT *, {alt} AS alt FROM (
      SELECT *, degrees(atan2(sin(radians(sl)) * cos(radians(ep)), cos(radians(sl)))) AS ra, degrees(asin(sin(radians(ep)) * sin(radians(sl)))) AS de FROM (
        SELECT *, {mid} AS mid, {_sun_lon(mid)} AS sl, {_eps(mid)} AS ep, {_lst(mid)} AS ls FROM bis WHERE i < 20))))
"""


@query("rise_set_refined", f"WITH RECURSIVE {b.OBS}, {_STATION_DAYS}, {_positions('src')}, {_cross_sql('sun_alt')}, {_halve_sql()} "
                           f"SELECT station, day_start, round((lo + hi) / 2, 1) + 0e0 AS sunrise FROM sd JOIN bis USING (day_start) WHERE i = 20")
def rise_set_refined(spark, root):
    rows = catalog.rise_set(_station_days(spark, root), "sun", LAT, LON, refine=True)
    return rows.where("rise is not null").select("station", "day_start", (F.round("rise", 1) + 0.0).alias("sunrise"))


@query("time_until", f"""
WITH {b.OBS}, {_STATION_DAYS}, {_positions('src')}, {_cross_sql('sun_alt')},
n AS (SELECT o.event_id, o.timestamp AS t, r.rise, r.set FROM obs o JOIN rs r ON r.day_start = (o.timestamp + o.timezone_offset) // 86400 * 86400 - o.timezone_offset),
u AS (SELECT event_id, CASE WHEN rise >= t THEN rise - t ELSE rise + 86400 - t END AS r, CASE WHEN set >= t THEN set - t ELSE set + 86400 - t END AS s FROM n)
SELECT event_id, lpad(CAST(r // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(r % 3600 // 60 AS VARCHAR), 2, '0') AS until_rise,
  lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') AS until_set FROM u""")
def time_until(spark, root):
    start = sky.local_day_start(F.col("timestamp"), F.col("timezone_offset"))
    rows = catalog.rise_set(_obs(spark, root).withColumn("day_start", start), "sun", LAT, LON)
    until = {n: sky.seconds_until(F.col(c), F.col("timestamp")) for n, c in (("until_rise", "rise"), ("until_set", "set"))}
    return rows.select("event_id", *[text.clock(e).alias(n) for n, e in until.items()])


# --- labels and exposure ----------------------------------------------------

def _cloud_sql(i):
    stops = labels.CLOUD_STOPS
    cases = " ".join(f"WHEN p <= {p1} THEN floor({c0[i]} + {c1[i] - c0[i]} * ((p - {p0}) / {p1 - p0}e0) + 5e-1)"
                     for (p0, c0), (p1, c1) in zip(stops, stops[1:]))
    return f"CAST(CASE {cases} END AS INT)"


@query("cloud_color", f"""
WITH {b.OBS}, c AS (SELECT event_id, least(greatest(value - 1e1, 0e0), 1e2) AS p FROM obs)
SELECT event_id, 'rgb(' || {_cloud_sql(0)} || ', ' || {_cloud_sql(1)} || ', ' || {_cloud_sql(2)} || ')' AS color FROM c""")
def cloud_color(spark, root):
    return _obs(spark, root).select("event_id", labels.cloud_color(F.col("value") - 10.0).alias("color"))


@query("seeing_label", f"""
WITH {b.OBS} SELECT event_id, CASE WHEN value <= 30 THEN 'excellent' WHEN value <= 60 THEN 'good' WHEN value <= 90 THEN 'fair'
  WHEN value <= 120 THEN 'poor' ELSE 'very poor' END AS label, CASE WHEN value <= 30 THEN 'green' WHEN value <= 60 THEN 'limegreen'
  WHEN value <= 90 THEN 'orange' WHEN value <= 120 THEN 'orangered' ELSE 'red' END AS color FROM obs""")
def seeing_label(spark, root):
    return _obs(spark, root).select("event_id", labels.seeing_label(F.col("value")).alias("label"),
                                    labels.seeing_color(F.col("value")).alias("color"))

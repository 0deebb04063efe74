import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from noctule.functions import labels, sky, text
from noctule.operators import catalog, nearest, spatial


def at(*when):
    return calendar.timegm(dt.datetime(*when).timetuple())


def values(spark, epoch, **columns):
    return spark.range(1).select(F.lit(epoch).alias("t")).select(*[f(F.col("t")).alias(n) for n, f in columns.items()]).first()


def test_published_positions(spark):
    """Worked examples of the astronomical literature."""
    r = values(spark, at(1987, 4, 10), lst=lambda t: sky.sidereal_time(t, 0.0), eps=sky.obliquity)
    assert r.lst == pytest.approx(197.693195, abs=1e-5) and r.eps == pytest.approx(23.440946, abs=1e-5)
    r = values(spark, at(1992, 10, 13), ra=lambda t: sky.sun_position(t)[0], dec=lambda t: sky.sun_position(t)[1])
    assert r.ra == pytest.approx(198.38083, abs=0.02) and r.dec == pytest.approx(-7.78507, abs=0.02)
    r = values(spark, at(1992, 4, 12), lon=sky.moon_longitude, lat=sky.moon_latitude, ra=lambda t: sky.moon_position(t)[0],
               dec=lambda t: sky.moon_position(t)[1], lit=sky.moon_illumination)
    assert r.lon == pytest.approx(133.1627, abs=0.4) and r.lat == pytest.approx(-3.2291, abs=0.3)
    assert r.ra == pytest.approx(134.6885, abs=0.5) and r.dec == pytest.approx(13.7684, abs=0.5)
    assert r.lit == pytest.approx(67.86, abs=1.0)


def test_coordinates_go_back_and_forth(spark):
    table = spark.createDataFrame([(200.0, 30.0), (10.0, -20.0), (300.0, 80.0)], "ra double, dec double")
    t, lat, lon = F.lit(at(2024, 1, 5, 20)), 51.0, 7.0
    az = sky.azimuth(F.col("ra"), F.col("dec"), lat, lon, t)
    alt = sky.altitude(F.col("ra"), F.col("dec"), lat, lon, t)
    out = table.select("ra", "dec", az.alias("az"), alt.alias("alt")).select(
        "ra", "dec", sky.right_ascension_of(F.col("az"), F.col("alt"), lat, lon, t).alias("ra2"),
        sky.declination_of(F.col("az"), F.col("alt"), lat).alias("dec2"))
    for r in out.collect():
        assert (r.ra2, r.dec2) == pytest.approx((r.ra, r.dec), abs=1e-6)


def test_night_flags_have_a_latitude_shortcut(spark):
    midnight = at(2024, 1, 5, 0)
    r = values(spark, midnight, a=lambda t: sky.is_night(t, 51.0, 7.0), b=lambda t: sky.is_night(t, 61.0, 7.0),
               c=lambda t: sky.is_astronomical_night(t, 55.0, 7.0), d=lambda t: sky.sun_below(t, 61.0, 7.0, 6.0, None))
    assert tuple(r) == (1, 0, 0, 1)


def test_sunrise_and_polar_day(spark):
    days = spark.createDataFrame([(at(2024, 6, 21), 51.5, 0.0), (at(2024, 6, 21), 75.0, 0.0)], "day_start long, lat double, lon double")
    out = {r.lat: r for r in catalog.rise_set(days, "sun", "lat", "lon", refine=True).collect()}
    # geometric horizon: refraction and the sun's radius, some five minutes, are left out
    assert out[51.5].rise == pytest.approx(at(2024, 6, 21, 3, 49), abs=300)
    assert out[51.5].set == pytest.approx(at(2024, 6, 21, 20, 14), abs=300)
    assert out[75.0].rise is None and out[75.0].set is None


def test_showers_over_new_year(spark):
    days = spark.createDataFrame([(dt.date(2023, 12, 30),), (dt.date(2024, 1, 10),), (dt.date(2024, 1, 11),), (dt.date(2024, 8, 24),)], "day date")

    def codes(**options):
        out = {}
        for r in catalog.active_showers(days, ["day"], **options).collect():
            out.setdefault(r.day.isoformat(), set()).add(r.code)
        return out

    ours, strict = codes(), codes(strict_reference=True)
    assert ours["2023-12-30"] == {"QUA", "DLM"} and "2023-12-30" not in strict
    assert ours["2024-01-10"] == {"QUA", "DLM"} == strict["2024-01-10"] and ours["2024-01-11"] == {"DLM"}
    assert ours["2024-08-24"] == {"PER", "KCG"}


def test_cloud_colors(spark):
    table = spark.createDataFrame([(-5.0,), (15.0,), (30.0,), (100.0,), (250.0,)], "p double")
    got = [r[0] for r in table.select(labels.cloud_color(F.col("p"))).collect()]
    assert got == ["rgb(0, 0, 60)", "rgb(36, 36, 81)", "rgb(72, 72, 102)", "rgb(240, 240, 200)", "rgb(240, 240, 200)"]


def test_seconds_carry(spark):
    rows = spark.createDataFrame([(15 * (1 + 59.9999 / 3600), 10 + 59 / 60 + 59.7 / 3600), (359.9999, -0.5)], "ra double, dec double")
    got = [tuple(r) for r in rows.select(text.ra_text(F.col("ra")), text.dec_text(F.col("dec"))).collect()]
    assert got == [("01:01:00", "+11°00′00″"), ("00:00:00", "-00°30′00″")]


def test_nearest_point_across_the_seam_and_off_the_sphere(spark):
    sites = spark.createDataFrame([(1, 350.0, 0.0), (2, -181.0, 0.0)], "site int, lon double, lat double")
    grid = spark.createDataFrame([(0, 30.0, 0.0, 1.0), (1, 200.0, 0.0, 2.0)], "pos int, lon double, lat double, val double")
    got = {r.site: (r.val, r.distance) for r in spatial.nearest_point(sites, grid, wrap_lon=True).collect()}
    assert got[1] == (1.0, 40.0) and got[2] == (2.0, 21.0)
    beside = grid.unionByName(spark.createDataFrame([(2, -181.2, 0.0, 3.0)], grid.schema))
    assert {r.site: r.val for r in spatial.nearest_point(sites, beside).collect()}[2] == 3.0


def test_nearest_in_time_has_no_limit_by_default(spark):
    left = spark.createDataFrame([(500_000_000,)], "t long")
    right = spark.createDataFrame([(1_800_000_000, 1, 7)], "u long, pos int, v int")
    assert nearest.nearest(left, right, "t", "u", ["v"], ["pos"]).first().v == 7
    assert nearest.nearest(left, right, "t", "u", ["v"], ["pos"], tolerance=1_000_000_000).first().v is None


def test_pairs_of_one_day_are_spread(spark):
    """One file of one day's observations: its pairs are the work of many tasks, and are all there."""
    day = dt.date(2024, 1, 1)
    times = [1704067200 + 600 * i for i in range(64)]
    seen = spark.createDataFrame([(i if i % 9 else None, t, day if i % 13 else None) for i, t in enumerate(times)] + [(1, times[1], day)], "event_id long, timestamp long, day date").coalesce(1)
    comets = [(f"c{i}", i * 37.0 % 360, i * 11.0 % 180 - 90) for i in range(20)]
    objects = spark.createDataFrame([(*c, d) for c in [*comets, comets[3], ("none", None, 1.0)] for d in (day, day + dt.timedelta(1), None)], "name string, ra double, dec double, day date")
    found = catalog.visible_objects(seen, objects, ["event_id", "timestamp"], 51.0, 7.0)
    at = found.withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in at}) > 1
    plain = seen.where("day IS NOT NULL").crossJoin(objects.where(F.col("day") == F.lit(day)).drop("day"))
    plain = plain.withColumn("altitude", sky.altitude(F.col("ra"), F.col("dec"), 51.0, 7.0, F.col("timestamp"))).where("altitude >= 0")
    key = lambda r: (r["event_id"] or -1, r["timestamp"], r["name"], round(r["altitude"], 9))
    assert found.columns == ["day", "event_id", "timestamp", "name", "ra", "dec", "altitude", "azimuth"]
    assert sorted(map(key, at)) == sorted(map(key, plain.collect())) and at

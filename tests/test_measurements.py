import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noctule import schemas
from noctule.functions import text
from noctule.operators import filters, nearest, timeline
from noctule.session import scratch_path
from noctule.sources import archive, feeds, measurements, settings


def rows(df):
    return sorted(map(tuple, df.collect()))


def image_rows(spark, *pairs):
    blank = {c: None for c in schemas.IMAGE.fieldNames()}
    data = [{**blank, "station": s, "timestamp": t, "exposure": float(i)} for i, (s, t) in enumerate(pairs)]
    return spark.createDataFrame([tuple(d[c] for c in schemas.IMAGE.fieldNames()) for d in data], schemas.IMAGE)


def test_insert_keeps_first_arrival_and_prunes_days(spark):
    root = scratch_path(spark, "t")
    day = 86400
    measurements.insert(spark, image_rows(spark, (1, 10), (1, 10), (1, day + 5)), root, "image", F.col("exposure"))
    measurements.insert(spark, image_rows(spark, (1, 10), (2, 10), (1, 3 * day)), root, "image", F.col("exposure"))
    stored = measurements.scan(spark, root, "image", 0, 10 * day)
    assert rows(stored.select("station", "timestamp", "exposure")) == [
        (1, 10, 0.0), (1, day + 5, 2.0), (1, 3 * day, 2.0), (2, 10, 1.0)]
    # both ends count, and only the overlapping days are read
    part = measurements.scan(spark, root, "image", 10, day + 5)
    assert part.count() == 3
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:200]
    assert measurements.scan_day(spark, root, "image", "1970-01-02").count() == 1


def test_history_ignores_unreadable_filters(spark):
    table = image_rows(spark, (1, 5), (1, 6), (1, 7)).withColumn("night_mode", F.lit(1))
    out = measurements.history(table.drop("day"), 5, 6, night_mode="night", stars_min="", hdr=None)
    assert [r.timestamp for r in out.collect()] == [5, 6]


def test_latest_breaks_ties_by_order(spark):
    table = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 9)], "station long, timestamp long, id long")
    assert rows(measurements.latest(table, ["station"], ["timestamp", "id"])) == [(1, 5, 2)]


def test_time_texts_split(spark):
    table = spark.createDataFrame([("20240101000000", "20240101000001"), ("20240101000002", "20240101000001"),
                                   ("2024", "20240101000001"), ("20240230000000", "20240301000000"), (None, "x")],
                                  "a string, b string")
    good, bad = measurements.split_valid_times(table, "a", "b")
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["invalid", "invalid", "missing", "reversed"]


def test_export_rounds_half_up(spark):
    table = spark.createDataFrame([(0.25, 7)], "bt double, id int")
    doc = measurements.export_json(table, {"bt": 1}, keep=["id"]).first().doc
    assert json.loads(doc) == {"bt": 0.3}


def test_header_rows_skip_what_does_not_parse(spark):
    doc = json.dumps([["time_tag", "Kp"], ["2025-01-01 00:00:00", "2.33"], ["2025-01-01 03:00:00"], ["soon", "1"],
                      ["2025-01-01 06:00:00", "x"]])
    docs = spark.createDataFrame([(1, doc), (2, json.dumps([["time_tag", "Kp"]])), (3, "no json")], "id int, doc string")
    out = feeds.read_header_rows(docs, ["id"], feeds.KP_TABLE, feeds.MIN_WIDTH["kp"])
    assert [tuple(r) for r in out.orderBy("pos").collect()] == [(1, 1, 1735689600, 2.33), (1, 4, 1735711200, None)]


def test_header_rows_by_name_or_position(spark):
    doc = json.dumps([["time_tag", "bx", "by", "bz_gsm", "lon", "bt"],
                      ["2025-01-01 00:00:00", "0", "1", "-2", "3", "4"]])
    docs = spark.createDataFrame([(doc,)], "doc string")
    named = feeds.read_header_rows(docs, [], feeds.MAG_TABLE, 6).first()
    placed = feeds.read_header_rows(docs, [], feeds.MAG_TABLE, 6, by_position=True).first()
    assert (named.bt, named.bz) == (4.0, -2.0) and (placed.bt, placed.bz) == (1.0, 3.0)


def test_grid_document_needs_all_members(spark):
    good = {"Observation Time": "2025-01-01T00:00:00Z", "Forecast Time": "2025-01-01T01:00:00Z",
            "coordinates": [[1, 2, 3], [4, 5], [6, 7, 8, 9]]}
    docs = spark.createDataFrame([(json.dumps(good),), (json.dumps({k: v for k, v in good.items() if k != "coordinates"}),)],
                                 "doc string")
    out = feeds.read_grid(docs, []).select("pos", "lon", "lat", "val")
    assert rows(out) == [(0, 1.0, 2.0, 3), (2, 6.0, 7.0, 8)]


def test_hourly_document_with_missing_and_short_arrays(spark):
    doc = json.dumps({"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m": [1.5],
                                 "visibility": [10.0, None]}})
    out = feeds.read_hourly(spark.createDataFrame([(doc,)], "doc string"), []).orderBy("pos").collect()
    assert [(r.temperature, r.visibility, r.humidity) for r in out] == [(1.5, 10.0, None), (None, None, None)]


def test_comets_in_all_shapes(spark):
    comet = {"comet_fullname": "C/1", "best_ra": "10.5", "best_dec": "-3"}
    docs = [json.dumps([comet, {"best_ra": "1", "best_dec": "2"}]), json.dumps({"comets": [comet]}),
            json.dumps({"code": "500", "comets": [comet]}), json.dumps({"code": "200", "comets": [comet]}), "{}"]
    out = feeds.read_comets(spark.createDataFrame(list(enumerate(docs)), "id int, doc string"), ["id"])
    assert rows(out) == [(i, "C/1", 10.5, -3.0) for i in (0, 1, 3)]


def test_settings_rules(spark):
    body = '# a=1\nx\na=2\nb = "two words"\na=3\nc=\n  \nd = tail end\n'
    defaults = spark.createDataFrame([("a", "0"), ("z", "9")], "key string, value string")
    out = settings.parse(spark.createDataFrame([(7, body)], "station int, text string"), "station", defaults=defaults)
    assert rows(out) == [(7, "a", "3"), (7, "b", "two words"), (7, "d", "tail"), (7, "z", "9")]


def test_coordinates(spark):
    cases = {"51.5": 51.5, "7.4 W": -7.4, "12S": -12.0, " -3.5e1n": -35.0, "x": None, "5q": None, "": None}
    table = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in table.select("t", text.parse_coordinate(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_archive_listing_reads_a_folder(spark, tmp_path):
    folder = tmp_path / "20240101"
    folder.mkdir()
    for name in ("video-20240101120000.mp4", "video-x.mp4", "image-20240101120000.jpg"):
        (folder / name).write_bytes(b"12345")
    out = archive.list_files(spark, str(tmp_path)).select(F.element_at(F.split("path", str(tmp_path) + "/"), -1).alias("path"), "length")
    listed = {r.path: (r.day_text, r.stamp, r.taken) for r in archive.listing(out).collect()}
    assert listed == {"20240101/video-20240101120000.mp4": ("20240101", "20240101120000", 1704110400),
                      "20240101/video-x.mp4": ("20240101", None, None)}
    assert [r.path for r in archive.newest_first(archive.listing(out)).collect()][0].endswith("20000.mp4")



def test_filter_or_all(spark):
    table = spark.range(5)
    assert filters.filter_or_all(table, F.col("id") > 3).count() == 1
    assert filters.filter_or_all(table, F.col("id") > 9).count() == 5


def test_nearest_ties_gaps_and_failures(spark):
    day = 86400
    left = spark.createDataFrame([(1, 100), (2, 50 * day), (3, 200 * day + 7), (4, None)], "id int, t long")
    # equal distance: the earlier one; equal time: the first position
    right = spark.createDataFrame([(0, 90, 1.0), (1, 110, 2.0), (3, 60 * day, 3.5), (2, 60 * day, 3.0), (5, 150 * day, -1.0)],
                                  "pos int, t long, v double")
    for bucket in (60, day, 1000 * day):
        out = nearest.nearest(left, right, "t", "t", ["v"], ["pos"], bucket_seconds=bucket)
        assert [tuple(r) for r in out.orderBy("id").collect()] == [
            (1, 100, 90, 1.0), (2, 50 * day, 60 * day, 3.0), (3, 200 * day + 7, 150 * day, -1.0), (4, None, None, None)]
    checked = nearest.reject_invalid(out, ["v"], {"v": 0})
    assert [r.v for r in checked.orderBy("id").collect()] == [1.0, 3.0, None, None]
    near = nearest.nearest(left, right, "t", "t", ["v"], ["pos"], tolerance=11)
    assert [r.v for r in near.orderBy("id").collect()] == [1.0, None, None, None]


def test_nearest_per_station_with_one_hot_station(spark):
    left = spark.range(3000).select((F.col("id") % 10 == 0).cast("long").alias("s"), (F.col("id") * 7 % 100000).alias("t"), "id")
    right = spark.range(400).select((F.col("id") % 2).alias("s"), (F.col("id") * 251 % 100000).alias("t"),
                                    F.col("id").alias("pos"), F.col("id").alias("v"))
    out = {r.id: r.v for r in nearest.nearest(left, right, "t", "t", ["v"], ["pos"], ["s"], bucket_seconds=5000).collect()}
    table = [tuple(r) for r in right.collect()]
    for s, t, i in [tuple(r) for r in left.collect()][::37]:
        want = min((abs(t - rt), rt, pos, v) for rs, rt, pos, v in table if rs == s)[3]
        assert out[i] == want


def test_several_lookups_at_once_equal_one_by_one(spark):
    left = spark.createDataFrame([(i, i % 3, 997 * i) for i in range(80)], "id int, s int, t long")
    right = spark.createDataFrame([(i, i % 2, 1511 * i, float(i)) for i in range(40)], "pos int, s int, t long, v double")
    other = right.select("pos", "s", (F.col("t") + 300).alias("at"), (F.col("v") * 2).alias("w"))
    both = nearest.nearest_all(left, "t", [nearest.Lookup(right, "t", ["v"], ["pos"], 400, "vt"),
                                           nearest.Lookup(other, "at", ["w"], ["pos"], 900, "wt")], ["s"], 20000)
    one = nearest.nearest(left, right, "t", "t", ["v"], ["pos"], ["s"], 400, matched_time="vt")
    one = nearest.nearest(one, other, "t", "at", ["w"], ["pos"], ["s"], 900, matched_time="wt")
    columns = ["id", "vt", "v", "wt", "w"]
    key = lambda r: r[0]
    got, want = (sorted(map(tuple, d.select(columns).collect()), key=key) for d in (both, one))
    assert got == want and any(r[1] is None and r[3] is not None for r in got)


def test_first_row_of_an_hour_wins(spark):
    left = spark.createDataFrame([(1, 3700), (2, 9000)], "id int, t long")
    right = spark.createDataFrame([(1, 3600, 5.0), (0, 3600, 4.0)], "pos int, t long, v double")
    assert rows(nearest.by_hour(left, right, "t", "t", ["v"], ["t", "pos"])) == [(1, 3700, 4.0)]


def test_timelines_look_back_over_empty_days(spark):
    day = 86400
    times = [0, 10, 5 * day, 5 * day + 1, 90 * day]
    table = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "s int, t long, n int")
    gaps = timeline.gaps(table, ["s"], "t", 5)
    assert [(r.t, r.previous, r.gap) for r in gaps.orderBy("t").collect()] == [
        (10, 0, 10), (5 * day, 10, 5 * day - 10), (90 * day, 5 * day + 1, 85 * day - 1)]
    rolling = timeline.rolling_mean(table, ["s"], "t", "n", 3)
    assert [r.rolling for r in rolling.orderBy("t").collect()] == [0.0, 0.5, 1.0, 2.0, 3.0]


def test_bracket_prefix(spark):
    table = spark.createDataFrame(
        [(1, k, 8.0 / 4**k, int(k < 1)) for k in range(5)] + [(2, k, 8.0, 1) for k in range(5)]
        + [(3, k, 8.0, 0) for k in range(5)] + [(4, k, 1.0 if k < 2 else 0.00001, 1) for k in range(5)],
        "b int, k int, exposure double, overexposed int")
    out = timeline.bracket_prefix(table, ["b"])
    got = {r.b: (r.n, r.f) for r in out.groupBy("b").agg(F.count("*").alias("n"), F.max("n_fused").alias("f")).collect()}
    assert got == {1: (2, 2), 2: (5, 3), 3: (1, 1), 4: (2, 2)}


def test_settings_have_no_length_limits(spark):
    long, key = "v" * 150, "k" * 60
    texts = spark.createDataFrame([(1, f'{key}="{long} x"\nplain={long}')], "station long, text string")
    assert {r.key: r.value for r in settings.parse(texts, "station").collect()} == {key: long + " x", "plain": long}


def test_day_of_a_listed_path(spark):
    rows = spark.createDataFrame([("file:/media/a/20240102/video-20240102030405.mp4", 1), ("20240103/x.mp4", 1), ("/a/b.mp4", 1)], "path string, length long")
    assert [r.day_text for r in archive.listing(rows).collect()] == ["20240102", "20240103", None]


def test_history_ignores_what_is_no_number(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 15.0)], "timestamp long, sqm double")
    for value in ("nan", "inf", "x", None, float("nan")):
        assert measurements.history(rows, 0, 9, sqm_min=value).count() == 2
    assert measurements.history(rows, 0, 9, sqm_min="10").count() == 1


def test_no_timeline_in_one_task(spark, monkeypatch):
    import __spark_entry__ as entry

    plans, stored = [], nearest.stored
    keep = lambda frame, *name: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or stored(frame, *name)
    monkeypatch.setattr(nearest, "stored", keep)
    for name in ("nearest_kp", "enriched_observations"):
        plans.clear()
        frame = entry.queries()[name](spark, "/root/testdata/sf0.001")
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        whole = "\n".join(plans)
        assert "SinglePartition" not in whole
        # four of them on summaries with a row per bucket or per group of buckets
        assert whole.count("Exchange hashpartitioning") <= 10, (name, whole)


@pytest.mark.parametrize("by", [None, ["s"]])
def test_nearest_carries_over_empty_groups(spark, by):
    """Rights lie thousands of buckets from the lefts, before 1970 and after."""
    import random

    rng = random.Random(5)
    left = [(i, i % 2, rng.randrange(-10**8, 10**8)) for i in range(300)]
    right = [(i, i % 2, t) for i, t in enumerate([-99_000_000, -98_999_999, -5, 7, 40_000_000, 40_000_000, 99_999_999] + [rng.randrange(-10**8, 10**8) for _ in range(5)])]
    a, b = spark.createDataFrame(left, "id int, s int, t long"), spark.createDataFrame(right, "v int, s int, t long")
    out = {r.id: (r.v, r.matched_time) for r in nearest.nearest(a, b, "t", "t", ["v"], ["v"], by, bucket_seconds=1000).collect()}
    for i, s, t in left:
        own = [(abs(u - t), u, v) for v, z, u in right if by is None or z == s]
        assert out[i] == min(own)[:0:-1]


def test_inserts_read_what_lies_between_their_rows(spark, tmp_path, monkeypatch):
    root, day, plans = str(tmp_path), 86400, []
    measurements.insert(spark, image_rows(spark, *[(1, 60 * i) for i in range(3000)]), root, "image")
    insert = measurements.insert_if_absent
    monkeypatch.setattr(measurements, "insert_if_absent", lambda existing, *rest: plans.append(existing._jdf.queryExecution().executedPlan().toString()) or insert(existing, *rest))
    measurements.insert(spark, image_rows(spark, (1, day + 59), (1, day + 60), (1, day + 121)), root, "image")
    assert f"GreaterThanOrEqual(timestamp,{day + 59})" in plans[0] and f"LessThanOrEqual(timestamp,{day + 121})" in plans[0] and "1970-01-02" in plans[0]
    assert spark.read.parquet(f"{root}/image").count() == 3002

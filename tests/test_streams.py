import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from noctule.functions.exposure import Controller, Limits, advance, step
from noctule.streaming import flows, sinks, state, timers

ROWS = "station long, event_id long, timestamp long, brightness double, night_mode int"
LIMITS = Limits(max_exposure=20.0)


def observations(n=60):
    return [(i % 2, i, 1000 + 37 * i, ((i * 29) % 97) / 100.0, int(i % 13 < 6)) for i in range(n)]


def drop_files(spark, folder, batches):
    """One file per batch, in the order they are to arrive."""
    for i, batch in enumerate(batches):
        path = f"{folder}/part-{i}"
        spark.createDataFrame(batch, ROWS).coalesce(1).write.parquet(path)
        time.sleep(1.1)
    return folder


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Three files; the last brings rows older than what was seen before."""
    data = observations()
    folder = str(tmp_path_factory.mktemp("arriving"))
    late = [(0, 900, 5, 0.5, 0), (1, 901, 6, 0.5, 1)]
    drop_files(spark, folder, [data[:20], data[20:45], data[45:] + late])

    def stream():
        reader = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return reader.parquet(folder)

    return data, stream


LATE = [(0, 900, 5, 0.5, 0), (1, 901, 6, 0.5, 1)]


def exposures(data):
    held, want = {0: (1.0, 100.0), 1: (1.0, 100.0)}, {}
    for s, i, _, b, night in sorted(data, key=lambda r: r[2]):
        held[s] = want[i] = advance(b, *held[s], (0.3, 0.15)[night], LIMITS)
    return want


def test_exposure_is_carried_over_batches_and_late_rows_are_given_out(spark, arriving):
    data, stream = arriving
    operator = lambda rows: state.exposure_control(rows, LIMITS, (1.0, 100.0), (0.3, 0.15))
    out = flows.run(operator(stream()), "exposure")
    assert {r.event_id: (r.exposure, r.gain) for r in out.where("NOT late").collect()} == exposures(data)
    assert {r.event_id for r in out.where("late").collect()} == {900, 901}
    assert out.count() == len(data) + len(LATE)
    table = spark.createDataFrame(data + LATE, ROWS)
    settled = state.settle(out, table, operator).collect()
    assert {r.event_id: (r.exposure, r.gain) for r in settled} == exposures(data + LATE) and len(settled) == len(data) + len(LATE)
    assert {r.event_id: (r.exposure, r.gain) for r in operator(spark.createDataFrame(data, ROWS)).collect()} == exposures(data)


@pytest.mark.parametrize("delay", [50, 700])
def test_rows_are_held_until_later_ones_have_come(spark, arriving, delay):
    data, stream = arriving
    operator = lambda rows: state.exposure_control(rows, LIMITS, (1.0, 100.0), (0.3, 0.15), delay)
    out = flows.run(operator(stream()), "held").collect()
    newest = {s: max(r[2] for r in data if r[0] == s) for s in (0, 1)}
    waiting = {r[1] for r in data if r[2] > newest[r[0]] - delay}
    released, late = {r.event_id for r in out if not r.late}, {r.event_id for r in out if r.late}
    assert released | late | waiting == {r[1] for r in data + LATE} and len(out) + len(waiting) == len(data) + len(LATE)
    table = spark.createDataFrame(data + LATE, ROWS)
    settled = state.settle(flows.run(operator(stream()), "held"), table, operator, delay).collect()
    assert {r.event_id: (r.exposure, r.gain) for r in settled} == exposures(data + LATE) and len(settled) == len(data) + len(LATE)


def test_times_before_1970(spark):
    rows = spark.createDataFrame([(0, 1, -500, 0.2, 1), (0, 2, -100, 0.2, 0)], ROWS)
    assert [r.event_id for r in state.throttle(rows, 1000).collect()] == [1]
    assert [r.event_id for r in state.night_ends(rows).collect()] == [2]


def test_controller_is_carried_over_batches(arriving):
    data, stream = arriving
    controller = Controller(target=0.4)
    out = flows.run(state.damped_control(stream(), controller, (1.0, 2.0)), "controller")
    got = {r.event_id: (r.shutter, r.gain, r.lamp) for r in out.where("NOT late").collect()}
    held, want = {s: ([], 1.0, 2.0, 0) for s in (0, 1)}, {}
    for s, i, _, b, _ in data:
        if 0 < b <= 1:
            held[s] = controller.advance(b, *held[s])
        want[i] = held[s][1:]
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i])


def test_night_ends_and_throttle_over_batches(arriving):
    data, stream = arriving
    ends = flows.run(state.night_ends(stream()), "ends")
    was, want = {}, set()
    for s, i, _, _, night in data:
        if was.get(s) == 1 and night == 0:
            want.add(i)
        was[s] = night
    assert {r.event_id for r in ends.where("NOT late").collect()} == want
    kept = flows.run(state.throttle(stream(), 150), "throttle")
    last, want = {}, set()
    for s, i, t, _, _ in data:
        if s not in last or t > last[s] + 150:
            want.add(i)
            last[s] = t
    assert {r.event_id for r in kept.where("NOT late").collect()} == want


def test_running_stack_and_latest_over_batches(spark, arriving, tmp_path):
    data, stream = arriving
    frames = stream().select(F.col("station").alias("series"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("c"),
                             F.col("event_id").alias("v"))
    totals = flows.running_stack(frames)
    flows.run(totals, "stack", mode="update", batch=flows.versions(str(tmp_path / "s")))
    out = {r.series: (r.n, r.total) for r in flows.newest(spark, str(tmp_path / "s"), ["series", "x", "y", "c"], totals.schema).collect()}
    assert out == {0: (31, sum(range(0, 60, 2)) + 900), 1: (31, sum(range(1, 60, 2)) + 901)}
    rows = stream().select("station", "timestamp", "event_id")
    target = str(tmp_path / "l")
    flows.run(rows, "latest", batch=flows.latest_sink(spark, target, ["station"], ["timestamp", "event_id"], rows.schema))
    assert {tuple(r) for r in flows.snapshot(spark, target, rows.schema).select("station", "event_id").collect()} == {(0, 58), (1, 59)}


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    data = observations(20)
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    drop_files(spark, folder, [data[:10]])
    read = lambda: spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(folder)
    rows = lambda: state.exposure_control(read(), LIMITS, (1.0, 100.0), (0.3, 0.15))
    flows.run(rows(), "r", target=target, checkpoint=checkpoint)
    spark.createDataFrame(data[10:], ROWS).coalesce(1).write.parquet(folder + "/part-1")
    out = flows.run(rows(), "r", target=target, checkpoint=checkpoint)
    held, want = {0: (1.0, 100.0), 1: (1.0, 100.0)}, {}
    for s, i, _, b, night in data:
        held[s] = want[i] = advance(b, *held[s], (0.3, 0.15)[night], LIMITS)
    assert {r.event_id: (r.exposure, r.gain) for r in out.collect()} == want


def test_step_as_columns_equals_the_function(spark):
    cases = [(b, e, g) for b in (0.0, 0.05, 0.1495, 0.15, 0.4, 0.9) for e in (0.00004, 1.0, 20.0) for g in (0.0, 10.0, 295.0)]
    table = spark.createDataFrame(cases, "b double, e double, g double")
    exposure, gain = step(F.col("b"), F.col("e"), F.col("g"), F.lit(0.15), LIMITS)
    for r in table.select("*", exposure.alias("e2"), gain.alias("g2")).collect():
        assert (r.e2, r.g2) == pytest.approx(advance(r.b, r.e, r.g, 0.15, LIMITS))


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """Six files of rows over eight days, in an order that has nothing to do with time."""
    rows = [(i % 2, i, 86400 * 400 + 5000 * i + 13 * (i % 7), ((i * 29) % 97) / 100.0, int(i % 11 < 5)) for i in range(140)]
    folder = str(tmp_path_factory.mktemp("scattered"))
    batches = [[r for r in rows if r[1] * 5 % 6 == k] for k in range(6)]
    drop_files(spark, folder, batches)
    return rows, batches, lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_rows_correct_what_was_given(spark, scattered):
    rows, _, stream = scattered
    log = flows.run(state.exposure_control(stream(), LIMITS, (1.0, 100.0), (0.3, 0.15), keep=30 * 86400), "corrected")
    assert log.count() > len(rows) and not log.where("late").count()
    got = {r.event_id: (r.exposure, r.gain) for r in state.current(log).collect()}
    assert got == exposures(rows)
    ends = flows.run(state.night_ends(stream(), keep=30 * 86400), "corrected-ends")
    assert ends.where("NOT given").count()  # events that a late row took back
    assert {r.event_id for r in state.current(ends).collect()} == {r.event_id for r in state.night_ends(spark.createDataFrame(rows, ROWS)).collect()}


@pytest.mark.parametrize("keep, delay", [(86400, 0), (2 * 86400, 0), (86400, 40000), (0, 100000), (12345, 0)])
def test_rows_beyond_keep_are_late_and_change_nothing(scattered, keep, delay):
    rows, batches, stream = scattered
    log = flows.run(state.exposure_control(stream(), LIMITS, (1.0, 100.0), (0.3, 0.15), delay, keep), "short")
    newest, last, late, kept = {}, {}, set(), []
    for batch in batches:
        for r in sorted(batch, key=lambda r: r[2]):
            behind = last.get(r[0])
            if behind is not None and (r[2] < behind - keep):
                late.add(r[1])
            else:
                kept.append(r)
        for s in {r[0] for r in batch}:
            newest[s] = max([newest.get(s, 0), *(r[2] for r in batch if r[0] == s)])
            last[s] = max([r[2] for r in kept if r[0] == s and r[2] <= newest[s] - delay], default=None)
    assert {r.event_id for r in state.late(log).collect()} == late
    want = {e: v for e, v in exposures(kept).items() if next(r[2] <= newest[r[0]] - delay for r in kept if r[1] == e)}
    assert {r.event_id: (r.exposure, r.gain) for r in state.current(log).collect()} == want


def test_state_is_bounded_by_what_is_kept():
    """The processor alone, on a dictionary in the place of the state store."""
    import pandas as pd

    class Values(dict):
        exists = lambda self: bool(self)
        get = lambda self: dict.__getitem__(self, 0)
        update = lambda self, v: self.__setitem__(0, v)
        getValue = lambda self, k: self[k]
        updateValue = lambda self, k, v: self.__setitem__(k, v)
        removeKey = lambda self, k: self.pop(k)

    class Handle:
        def getMapState(self, *_):
            return Values()

        def getValueState(self, *_):
            return Values()

    from pyspark.sql import types as T

    schema = T._parse_datatype_string("station long, event_id long, timestamp long")
    fold = state.Fold(lambda s, r: ((s[0] + 1,), (s[0] + 1,)), "n bigint", (0,), "n bigint")
    one = state.CorrectedFold(fold, schema, 0, 3 * 86400)
    one.init(Handle())
    for day in range(60):
        frame = pd.DataFrame({"timestamp": [day * 86400 + 600 * i for i in range(100)], "event_id": [100 * day + i for i in range(100)]})
        given = pd.concat(one.handleInputRows((1,), iter([frame]), None))
        assert len(one.days) <= 5 and sum(len(v[1]) for v in one.days.values()) <= 600
    assert given["n"].max() == 6000
    late = pd.DataFrame({"timestamp": [5], "event_id": [-1]})
    assert pd.concat(one.handleInputRows((1,), iter([late]), None))["late"].tolist() == [True]


def test_an_empty_stream_gives_nothing(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    assert state.current(flows.run(state.throttle(stream, 10), "none")).count() == 0
    flows.run(stream, "none", batch=sinks.insert_sink(str(tmp_path / "t"), ["station", "timestamp"], F.col("event_id")))
    assert sinks.inserted(spark, str(tmp_path / "t"), stream.schema).count() == 0
    totals = sinks.Totals(str(tmp_path / "totals"), ["station"], {"n": "sum"}, spark.createDataFrame([], "station long, n long").schema)
    assert totals.read(spark).count() == 0


KEYED = "station long, timestamp long, event_id long"


def test_a_repeated_batch_inserts_nothing(spark, tmp_path):
    root = str(tmp_path)
    sink = sinks.insert_sink(root, ["station", "timestamp"], F.col("event_id"))
    batch = lambda *rows: spark.createDataFrame(rows, KEYED)
    read = lambda: sorted(tuple(r) for r in sinks.inserted(spark, root, batch((1, 1, 1)).schema).select("station", "timestamp", "event_id").collect())
    sink(batch((1, 10, 5), (1, 10, 4), (1, 90000, 6)), 0)
    sink(batch((1, 10, 1), (2, 10, 7)), 1)
    want = [(1, 10, 4), (1, 90000, 6), (2, 10, 7)]
    assert read() == want
    sink(batch((1, 10, 1), (2, 10, 7)), 1)
    sink(batch((3, 3, 3)), 0)
    assert read() == want


def test_a_batch_killed_between_write_and_log_is_repeated_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    sink = sinks.insert_sink(root, ["station", "timestamp"], F.col("event_id"))
    batch = lambda *rows: spark.createDataFrame(rows, KEYED)
    read = lambda: sorted(tuple(r) for r in sinks.inserted(spark, root, batch((1, 1, 1)).schema).select("station", "timestamp", "event_id").collect())
    sink(batch((1, 10, 4)), 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks.BatchLog, "enter", killed)
        with pytest.raises(KeyboardInterrupt):
            sink(batch((1, 10, 1), (2, 20, 7)), 1)
    assert read() == [(1, 10, 4)]  # what was cut off is not seen
    sink(batch((1, 10, 1), (2, 20, 7)), 1)
    assert read() == [(1, 10, 4), (2, 20, 7)]


def test_inserts_read_the_days_they_touch(spark, tmp_path):
    root = str(tmp_path)
    sink = sinks.insert_sink(root, ["station", "timestamp"], F.col("event_id"))
    for k in range(4):
        sink(spark.createDataFrame([(1, 86400 * k + 5, k)], KEYED), k)
    rows = sinks.inserted(spark, root, spark.createDataFrame([], KEYED).schema).where(F.col("day").isin([dt.date(1970, 1, 2)]))
    assert rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters: ["):].split("PushedFilters")[0]
    assert "day#" in scan and "1970-01-02" in scan and "batch#" in scan


def test_totals_are_read_from_a_bounded_number_of_folders(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long, low long, high long").schema
    totals = sinks.Totals(str(tmp_path), ["k"], {"n": "sum", "low": "min", "high": "max"}, schema, every=3)
    sink = totals.sink(lambda rows: rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    seen = []
    for i in range(10):
        rows = [(j % 2, 7 * i + j) for j in range(5)]
        seen += rows
        sink(spark.createDataFrame(rows, "k long, v long"), i)
        sink(spark.createDataFrame(rows, "k long, v long"), i)  # again: nothing changes
        assert len(totals.folders(i)) <= 3
        want = {(k, sum(r[0] == k for r in seen), min(r[1] for r in seen if r[0] == k), max(r[1] for r in seen if r[0] == k)) for k in (0, 1)}
        assert {tuple(r) for r in totals.read(spark).collect()} == want


def test_silence_gives_a_row_and_failures_are_counted(spark, tmp_path):
    """Station 1 falls silent for good; only others move the watermark on."""
    schema = "station long, event_id long, timestamp long, failed boolean"
    batches = [[(1, 1, 1000, False), (2, 2, 1500, True), (1, 3, 1010, True)], [(2, 4, 1490, True), (1, 5, 1005, True), (2, 6, 1600, True)],
               [(2, 7, 5000, False), (2, 8, 4900, None)], [(2, 9, 9000, False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part-{i}")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = flows.run(timers.watch(stream.withColumn("ts", F.timestamp_seconds("timestamp")), 2000, 3, "600 seconds"), "watch")
    got = {tuple(r) for r in out.collect()}
    assert got == {(1, "timeout", 1010, 3010, 3, 2, 2, 1), (2, "timeout", 1600, 3600, 3, 3, 3, 1), (2, "failures", 1600, 1600, 3, 3, 3, 0), (2, "timeout", 5000, 7000, 5, 4, 0, 2)}


def test_a_night_is_stacked_once(spark, tmp_path):
    frames = spark.createDataFrame([("1/0", 1, 0, i, 0, 0, 0, 10 * i) for i in range(4)] + [("1/1", 1, 1, 9, 0, 0, 0, 7)],
                                   "series string, station long, night long, seq int, x int, y int, c int, v int")
    calls = []

    def read():
        calls.append(1)
        return frames

    sink = sinks.night_sink(str(tmp_path), read)
    events = lambda *nights: spark.createDataFrame([(1, n, True, False) for n in nights], "station long, night long, given boolean, late boolean")
    sink(events(0), 0)
    sink(events(0), 0)
    assert len(calls) == 1
    sink(events(0, 1), 1)
    sink(events(), 2)
    assert sorted((r.series, r.n_frames, r.v) for r in sinks.stacks(spark, str(tmp_path)).collect()) == [("1/0", 4, 15), ("1/1", 1, 7)]


@pytest.mark.parametrize("median, shutter, gain, lamp, want", [
    (0.2, 10.0, 2.0, 0, (15.0, 2.0, 1)), (0.2, 30.0, 2.0, 1, (30.0, 3.0, 1)), (0.2, 25.0, 2.0, 1, (30.0, 2.0, 1)), (0.2, 30.0, 15.0, 0, (30.0, 16.0, 1)),
    (0.8, 10.0, 2.0, 1, (10.0, 1.5, 0)), (0.8, 10.0, 1.0, 0, (7.5, 1.0, 0)), (0.8, 10.0, 1.1, 0, (10.0, 1.0, 0)), (0.28, 30.0, 1.0, 1, (30.0, 1.0 + 0.5 * (0.4 / 0.28 - 1), 1))])
def test_controller_moves_one_quantity_to_its_bound(median, shutter, gain, lamp, want):
    _, *got = Controller(target=0.4).advance(median, [], shutter, gain, lamp)
    assert got == pytest.approx(list(want))


class Counted(dict):
    """A state variable on a dictionary that counts the calls to it."""

    calls = 0

    def get(self):
        self.calls += 1
        return dict.get(self, 0)

    def update(self, value):
        self.calls += 1
        self[0] = value

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key)


class CountedHandle:
    def __init__(self):
        self.variables = []

    def getMapState(self, *_):
        self.variables.append(Counted())
        return self.variables[-1]

    getValueState = getMapState
    deleteTimer = registerTimer = lambda self, at: None


def test_calls_to_the_state_follow_days_and_not_stations(spark):
    import pandas as pd
    from pyspark.sql import types as T

    step = lambda held, row: ((held[0] + row.brightness,), (held[0] + row.brightness,))
    fold = state.Fold(step, "total double", (0.0,), "total double")
    for keep, bound in ((3650 * 86400, 3 * (2 * 10 + 2)), (0, 3 * (2 * 2 + 2))):
        handle, log = CountedHandle(), []
        bucket = state.BucketFold(fold, T._parse_datatype_string(ROWS), 0, keep)
        bucket.init(handle)
        rows = [(s, 1000 * s + i, 86400 * (i // 3) + 7 * i, 1.0, 0) for s in range(50) for i in range(30)]
        batches = [rows[k::3] for k in range(3)] if keep else [[r for r in rows if r[2] // 86400 // 4 == k] for k in range(3)]
        for batch in batches:
            log += [tuple(r) for f in bucket.handleInputRows((0,), iter([pd.DataFrame(batch, columns=["station", "event_id", "timestamp", "brightness", "night_mode"])]), None) for r in f.itertuples(index=False)]
        newest = {}
        for station, event, _, total, version, given, late in log:
            assert given and not late
            newest[station, event] = max(newest.get((station, event), (0, 0)), (version, total))
        assert {k: v[1] for k, v in newest.items()} == {(s, 1000 * s + i): i + 1.0 for s in range(50) for i in range(30)}
        assert sum(v.calls for v in handle.variables) <= bound


def test_timers_of_many_stations_are_one_value_of_the_state():
    import pandas as pd
    from types import SimpleNamespace

    handle, watch = CountedHandle(), timers.Watch(2000, 3)
    watch.init(handle)
    rows = pd.DataFrame([(s, 10 * s + i, 1000 + 10 * i, True) for s in range(50) for i in range(3)], columns=["station", "event_id", "timestamp", "failed"])
    assert not len(pd.concat(watch.handleInputRows((0,), iter([rows]), None)))
    told = pd.concat(watch.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 9000000), None))
    assert sorted(map(tuple, told.values.tolist())) == sorted(
        [(s, "failures", 1020, 1020, 3, 3, 3, 0) for s in range(50)] + [(s, "timeout", 1020, 3020, 3, 3, 3, 1) for s in range(50)])
    assert sum(v.calls for v in handle.variables) <= 4


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    from noctule.plans import stream_queries

    rows = [(i, i % 2, [0.1 * (i % 5)] * 64) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    totals = stream_queries.stream_stack(spark, str(tmp_path)).collect()
    assert len(totals) == 128 and {r.n for r in totals} == {20}

"""Streams over the events and embeddings files, run until caught up."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctule.functions import exposure
from noctule.functions.exposure import Controller, Limits
from noctule.operators import timeline
from noctule.plans import bindings as b
from noctule.plans.registry import ORACLE, query, r6, s6
from noctule.session import scratch_path
from noctule.streaming import flows, sinks, state, timers

LIMITS = Limits(max_exposure=20.0)
START = (1.0, 100.0)
TARGETS = (0.30, 0.15)


PARTS = 8
#: Seconds by which rows are late at most in order of arrival, and over which shuffled rows are corrected.
LATE, KEEP = 21600, 3650 * 86400


def _stream(spark, root, name="events"):
    # a pattern, because a plain path has to be a folder: the table may be a file or a folder of files
    return flows.files(spark, f"{root}/{name}[.]parquet", b.table(spark, root, name).schema)


def _parts(spark, root, number, name="events", parts=PARTS):
    """Stream of a table's rows in ``parts`` files, one a micro-batch, in order of ``number``."""
    rows, folder = b.table(spark, root, name), scratch_path(spark, name + "-parts")
    for i in range(parts):  # one after the other: the source takes files by age
        rows.where(number == i).repartition(1).write.mode("append").parquet(folder)
    return flows.files(spark, folder, rows.schema, files_per_batch=1)


def _shuffled(spark, root):
    """Observations in an order that has nothing to do with time."""
    return b.obs_from(_parts(spark, root, F.pmod("event_id", F.lit(PARTS))))


def _arriving(spark, root):
    """Observations in order of time, but for delays under ``LATE``."""
    came = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.col("event_id") * 7919, F.lit(LATE))
    first, last = b.table(spark, root, "events").agg(F.min(came), F.max(came)).first()
    width = ((last or 0) - (first or 0)) // PARTS + 1
    return b.obs_from(_parts(spark, root, F.floor((came - (first or 0)) / width)))


def _obs(spark, root, split=False):
    return _shuffled(spark, root) if split else b.obs_from(_stream(spark, root))


def _timed(rows):
    return rows.withColumn("ts", F.timestamp_seconds("timestamp"))


@query("exposure_step", f"""
WITH {b.OBS},
i AS (SELECT event_id, brightness AS br, CASE WHEN k % 3 = 0 THEN 20e0 ELSE exposure END AS ex, CASE WHEN k % 5 = 0 THEN 0e0 ELSE gain END AS ga,
  CASE night_mode WHEN 1 THEN 15e-2 ELSE 3e-1 END AS ta FROM obs),
e AS (SELECT *, ta - br AS er, least(greatest(1 + 3 * (ta - br), 5e-1), 2e0) AS f FROM i)
SELECT event_id,
  {s6("CASE WHEN br = 0 OR abs(er) < 2e-3 THEN ex WHEN ex = 20 AND (er > 0 OR ga <> 0) THEN ex ELSE least(greatest(ex * f, 32e-6), 20e0) END", 'exposure')},
  {s6("CASE WHEN br = 0 OR abs(er) < 2e-3 THEN ga WHEN ex = 20 AND er > 0 THEN least(ga + 30, 300e0) WHEN ex = 20 AND ga <> 0 THEN greatest(ga - 30, 0e0) ELSE ga END", 'gain')}
FROM e""")
def exposure_step(spark, root):
    o = b.obs(spark, root)
    ex = F.when(F.col("k") % 3 == 0, 20.0).otherwise(F.col("exposure"))
    ga = F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("gain"))
    target = F.when(F.col("night_mode") == 1, 0.15).otherwise(0.30)
    new_exposure, new_gain = exposure.step(F.col("brightness"), ex, ga, target, LIMITS)
    return o.select("event_id", r6(new_exposure, "exposure"), r6(new_gain, "gain"))


@query("stream_ingest", f"""
WITH {b.OBS} SELECT event_id, station, timestamp, CAST(timestamp // 86400 AS BIGINT) AS day_number, {s6('brightness', 'brightness')} FROM obs""")
def stream_ingest(spark, root):
    rows = _obs(spark, root).select("event_id", "station", "timestamp", r6("brightness"), "day")
    kept = flows.run(rows, "ingest", partition_by=["day"])
    return kept.select("event_id", "station", "timestamp", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("day_number"),
                       "brightness")


@query("stream_dedup", f"WITH {b.OBS} SELECT DISTINCT station, timestamp // 600 AS slot FROM obs")
def stream_dedup(spark, root, split=False):
    slots = _timed(_obs(spark, root, split)).withColumn("slot", F.floor(F.col("timestamp") / 600))
    if not split:
        return flows.run(flows.dedup(slots, ["station", "slot"], "ts", "20 minutes").select("station", "slot"), "dedup")
    # rows that come in any order have no watermark to remember keys by: the table itself does
    rows = slots.select("station", "slot", (F.col("slot") * 600).alias("timestamp"))
    return _inserted(spark, rows, ["station", "slot"], F.col("timestamp")).select("station", "slot")


def _inserted(spark, rows, key, arrival):
    target = scratch_path(spark, "insert")
    flows.run(rows, "insert", batch=sinks.insert_sink(target, key, arrival))
    return sinks.inserted(spark, target, rows.schema)


@query("stream_insert", f"""
WITH {b.OBS} SELECT station, timestamp // 3600 * 3600 AS timestamp, event_id, {s6('brightness', 'brightness')} FROM obs
QUALIFY row_number() OVER (PARTITION BY station, timestamp // 3600 ORDER BY event_id % {PARTS}, event_id) = 1""")
def stream_insert(spark, root):
    hour = (F.floor(F.col("timestamp") / 3600) * 3600).alias("timestamp")
    rows = _shuffled(spark, root).select("station", hour, "event_id", r6("brightness"))
    return _inserted(spark, rows, ["station", "timestamp"], F.col("event_id")).select("station", "timestamp", "event_id", "brightness")


def _folded(spark, root, split, name, columns, operator):
    """What holds after a stateful operator's stream."""
    rows = _obs(spark, root, split).select(*columns)
    return state.current(flows.run(operator(rows, keep=KEEP if split else 0), name))


_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp, event_id) AS i FROM obs)"


_EXPOSURE = """s AS (SELECT station, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 1e0 AS ex, 1e2 AS ga FROM o WHERE o.i = 1
 UNION ALL
 SELECT station, i, event_id,
  CASE WHEN br = 0 OR abs(er) < 2e-3 THEN ex WHEN ex = 20 AND (er > 0 OR ga <> 0) THEN ex ELSE least(greatest(ex * least(greatest(1 + 3 * er, 5e-1), 2e0), 32e-6), 20e0) END,
  CASE WHEN br = 0 OR abs(er) < 2e-3 THEN ga WHEN ex = 20 AND er > 0 THEN least(ga + 30, 300e0) WHEN ex = 20 AND ga <> 0 THEN greatest(ga - 30, 0e0) ELSE ga END
 FROM (SELECT o.station, o.i, o.event_id, o.brightness AS br, (CASE o.night_mode WHEN 1 THEN 15e-2 ELSE 3e-1 END) - o.brightness AS er, s.ex, s.ga
       FROM s JOIN o ON o.station = s.station AND o.i = s.i + 1))
SELECT station, event_id, """ + f"{s6('ex', 'exposure')}, {s6('ga', 'gain')} FROM s WHERE i > 0"


def _exposure(rows, keep):
    return state.exposure_control(rows, LIMITS, START, TARGETS, keep=keep)


@query("stream_exposure", f"WITH RECURSIVE {b.OBS}, {_ORDERED}, {_EXPOSURE}")
def stream_exposure(spark, root, split=False):
    kept = _folded(spark, root, split, "exposure", ["station", "event_id", "timestamp", "brightness", "night_mode"],
                   _exposure)
    return kept.select("station", "event_id", r6("exposure"), r6("gain"))


#: Rows more than this behind the newest row of an earlier batch are late for good.
SHORT = 5 * 86400
_IN_TIME = f"""m AS (SELECT station, event_id % {PARTS} AS part, max(timestamp) AS newest FROM obs GROUP BY ALL),
b AS (SELECT station, part, max(newest) OVER (PARTITION BY station ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {SHORT} AS edge FROM m),
t AS (SELECT obs.*, coalesce(timestamp < edge, FALSE) AS late FROM obs JOIN b ON b.station = obs.station AND b.part = event_id % {PARTS})"""


def _short(spark, root):
    columns = ["station", "event_id", "timestamp", "brightness", "night_mode"]
    return flows.run(_exposure(_shuffled(spark, root).select(*columns), keep=SHORT), "exposure")


@query("stream_exposure_late", f"WITH {b.OBS}, {_IN_TIME} SELECT station, event_id, timestamp FROM t WHERE late")
def stream_exposure_late(spark, root):
    return state.late(_short(spark, root))


@query("stream_exposure_kept", f"""
WITH RECURSIVE {b.OBS}, {_IN_TIME}, {_ORDERED.replace('FROM obs', 'FROM t WHERE NOT late')}, {_EXPOSURE}""")
def stream_exposure_kept(spark, root):
    return state.current(_short(spark, root)).select("station", "event_id", r6("exposure"), r6("gain"))


CONTROLLER = Controller()


@query("stream_controller", f"""
WITH RECURSIVE {b.OBS}, {_ORDERED},
m AS (SELECT station, i, event_id, brightness AS br, avg(brightness) OVER (PARTITION BY station ORDER BY i ROWS 9 PRECEDING) AS mean FROM o),
s AS (SELECT station, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 1e0 AS sh, 2e0 AS ga, 0 AS la FROM o WHERE o.i = 1
 UNION ALL
 SELECT station, i, event_id, CASE WHEN sc > 1 AND sh < 30 THEN least(sh * d, 30e0) WHEN sc <= 1 AND ga <= 1 THEN greatest(sh * d, 1e-4) ELSE sh END,
  CASE WHEN sc > 1 AND sh >= 30 THEN least(ga * d, 16e0) WHEN sc <= 1 AND ga > 1 THEN greatest(ga * d, 1e0) ELSE ga END,
  CASE WHEN la = 0 AND br < 25e-2 THEN 1 WHEN la = 1 AND br > 25e-2 + 5e-2 THEN 0 ELSE la END
 FROM (SELECT m.station, m.i, m.event_id, m.br, s.sh, s.ga, s.la, (3e-1 + 3e-1 * exp(-4 * m.mean)) / m.br AS sc,
         1 + 5e-1 * ((3e-1 + 3e-1 * exp(-4 * m.mean)) / m.br - 1) AS d FROM s JOIN m ON m.station = s.station AND m.i = s.i + 1))
SELECT station, event_id, round(sh, 4) + 0e0 AS shutter, round(ga, 4) + 0e0 AS gain, la AS lamp FROM s WHERE i > 0""")
def stream_controller(spark, root, split=False):
    kept = _folded(spark, root, split, "controller", ["station", "event_id", "timestamp", "brightness"],
                   lambda rows, keep: state.damped_control(rows, CONTROLLER, (1.0, 2.0), keep=keep))
    return kept.select("station", "event_id", (F.round("shutter", 4) + 0.0).alias("shutter"),
                       (F.round("gain", 4) + 0.0).alias("gain"), "lamp")


@query("stream_night_end", f"""
WITH {b.OBS}, w AS (SELECT event_id, station, timestamp, night_mode, lag(night_mode) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS was FROM obs)
SELECT event_id, station, timestamp FROM w WHERE was = 1 AND night_mode = 0""")
def stream_night_end(spark, root, split=False):
    return _folded(spark, root, split, "night-end", ["station", "event_id", "timestamp", "night_mode"], state.night_ends)


@query("stream_throttle", f"""
WITH RECURSIVE {b.OBS}, {_ORDERED},
s AS (SELECT station, i, event_id, timestamp, timestamp AS acc, TRUE AS hit FROM o WHERE i = 1
 UNION ALL
 SELECT o.station, o.i, o.event_id, o.timestamp, CASE WHEN o.timestamp > s.acc + 21600 THEN o.timestamp ELSE s.acc END, o.timestamp > s.acc + 21600
 FROM s JOIN o ON o.station = s.station AND o.i = s.i + 1)
SELECT station, event_id, timestamp FROM s WHERE hit""")
def stream_throttle(spark, root, split=False):
    return _folded(spark, root, split, "throttle", ["station", "event_id", "timestamp"], lambda rows, keep: state.throttle(rows, 21600, keep=keep))


@query("stream_stack", f"""
WITH {b.FRAMES8} SELECT series, x, y, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM frames8 GROUP BY ALL""")
def stream_stack(spark, root):
    target = scratch_path(spark, "stack")
    totals = flows.running_stack(b.frames8_from(_stream(spark, root, "embeddings")))
    flows.run(totals, "stack", mode="update", batch=flows.versions(target))
    return flows.newest(spark, target, ["series", "x", "y", "c"], totals.schema)


@query("stream_latest", f"""
WITH {b.OBS} SELECT station, timestamp, event_id, {s6('brightness', 'brightness')} FROM obs
QUALIFY row_number() OVER (PARTITION BY station ORDER BY timestamp DESC, event_id DESC) = 1""")
def stream_latest(spark, root):
    target = scratch_path(spark, "latest")
    rows = _obs(spark, root).select("station", "timestamp", "event_id", r6("brightness"))
    flows.run(rows, "latest", batch=flows.latest_sink(spark, target, ["station"], ["timestamp", "event_id"], rows.schema))
    return flows.snapshot(spark, target, rows.schema)


@query("stream_stack_split", ORACLE["stream_stack"])
def stream_stack_split(spark, root):
    """Partial results of ten batches, of which a snapshot holds the first nine."""
    frames = b.frames8_from(_parts(spark, root, F.pmod("vec_id", F.lit(10)), "embeddings", 10))
    schema = flows.running_stack(frames).schema
    totals = sinks.Totals(scratch_path(spark, "totals"), ["series", "x", "y", "c"], {"n": "sum", "total": "sum", "low": "min", "high": "max"}, schema, every=3)
    flows.run(frames, "totals", batch=totals.sink(flows.running_stack))
    return totals.read(spark)


@query("stream_hourly", f"""
WITH {b.OBS}
SELECT CAST(timestamp // 3600 * 3600 AS BIGINT) AS hour, feed, count(*) AS n, {s6('avg(value)', 'mean_value')} FROM obs GROUP BY 1, 2""")
def stream_hourly(spark, root, split=False):
    rows = _obs(spark, root, split).select((F.floor(F.col("timestamp") / 3600) * 3600).alias("hour"), "feed", "value")
    counted = lambda rows: rows.groupBy("hour", "feed").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    totals = sinks.Totals(scratch_path(spark, "hourly"), ["hour", "feed"], {"n": "sum", "total": "sum"}, counted(rows).schema)
    flows.run(rows, "hourly", batch=totals.sink(counted))
    return totals.read(spark).select("hour", "feed", "n", r6(F.col("total") / F.col("n"), "mean_value"))


@query("stream_hourly_closed", f"""
WITH {b.OBS}
SELECT CAST(timestamp // 3600 * 3600 AS BIGINT) AS hour, feed, count(*) AS n, {s6('avg(value)', 'mean_value')} FROM obs GROUP BY 1, 2
HAVING min(timestamp) // 3600 * 3600 + 3600 <= (SELECT max(timestamp) FROM obs) - {LATE}""")
def stream_hourly_closed(spark, root):
    """Hours that the watermark has passed, and only those."""
    hours = flows.hourly(_timed(_arriving(spark, root)), "ts", f"{LATE} seconds", ["feed"], F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return flows.run(hours, "hours").withColumn("mean_value", r6("mean_value"))


PAUSE = 14400
_RUNS = f"""{b.OBS},
g AS (SELECT station, timestamp, CASE WHEN timestamp - lag(timestamp) OVER p < {PAUSE} THEN 0 ELSE 1 END AS new FROM obs WINDOW p AS (PARTITION BY station ORDER BY timestamp)),
r AS (SELECT station, timestamp, sum(new) OVER (PARTITION BY station ORDER BY timestamp) AS run FROM g),
a AS (SELECT station, min(timestamp) AS first, max(timestamp) + {PAUSE} AS until, count(*) AS captures FROM r GROUP BY station, run)
SELECT * FROM a"""


@query("stream_sessions", f"WITH {_RUNS}")
def stream_sessions(spark, root, split=False):
    told = _folded(spark, root, split, "runs", ["station", "event_id", "timestamp"], lambda rows, keep: state.runs(rows, PAUSE, keep=keep))
    return state.sessions(told, PAUSE)


@query("stream_sessions_closed", f"WITH {_RUNS} WHERE until <= (SELECT max(timestamp) FROM obs) - {LATE}")
def stream_sessions_closed(spark, root):
    """Runs of captures that the watermark has closed, and only those."""
    return flows.run(flows.sessions(_timed(_arriving(spark, root)), "ts", f"{PAUSE} seconds", f"{LATE} seconds", ["station"]), "sessions")


SILENCE, ALARM = 2 * 86400, 3
_WATCHED = f"""{b.OBS},
c AS (SELECT *, k % 4 = 0 AS failed FROM obs WHERE timestamp <= (SELECT max(timestamp) FROM obs) - {LATE}),
o AS (SELECT *, row_number() OVER w AS captures, count(*) FILTER (failed) OVER w AS failures, count(*) FILTER (NOT failed) OVER w AS fine,
             lead(timestamp) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS next FROM c WINDOW w AS (PARTITION BY station ORDER BY timestamp, event_id)),
q AS (SELECT *, coalesce(timestamp + {SILENCE} < next, TRUE) AND timestamp + {SILENCE} <= (SELECT max(timestamp) FROM obs) - {LATE} AS silent,
             CASE WHEN failed THEN row_number() OVER (PARTITION BY station, fine ORDER BY timestamp, event_id) - CASE WHEN fine > 0 THEN 1 ELSE 0 END ELSE 0 END AS in_a_row FROM o),
n AS (SELECT *, count(*) FILTER (silent) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS timeouts FROM q)"""


def _watched(spark, root, kind):
    rows = _timed(_arriving(spark, root)).withColumn("failed", F.col("k") % 4 == 0)
    return flows.run(timers.watch(rows, SILENCE, ALARM, f"{LATE} seconds"), "watch").where(F.col("kind") == kind)


@query("stream_timeouts", f"WITH {_WATCHED} SELECT station, timestamp, timestamp + {SILENCE} AS due, captures, failures, timeouts FROM n WHERE silent")
def stream_timeouts(spark, root):
    return _watched(spark, root, "timeout").select("station", "timestamp", "due", "captures", "failures", "timeouts")


@query("stream_failures", f"WITH {_WATCHED} SELECT station, timestamp, captures, failures, in_a_row FROM n WHERE failed AND in_a_row % {ALARM} = 0")
def stream_failures(spark, root):
    return _watched(spark, root, "failures").select("station", "timestamp", "captures", "failures", "in_a_row")


@query("stream_night_stack", f"""
WITH {b.OBS},
w AS (SELECT station, timestamp, night_mode, lag(night_mode) OVER l AS was, lag(timestamp) OVER l AS past, max(timestamp) OVER (PARTITION BY station) AS newest FROM obs
      WINDOW l AS (PARTITION BY station ORDER BY timestamp, event_id)),
ends AS (SELECT DISTINCT station, CAST(floor((past - 43200) / 86400) AS BIGINT) AS night FROM w WHERE was = 1 AND night_mode = 0 AND timestamp <= newest - {LATE}),
f AS (SELECT o.station, e.night, floor(brightness * 255) AS v FROM obs o JOIN ends e
      ON o.station = e.station AND CAST(floor((o.timestamp - 43200) / 86400) AS BIGINT) = e.night WHERE night_mode = 1)
SELECT station || '/' || night AS series, count(*) AS n_frames, CAST(floor(avg(v) + 5e-1) AS INT) AS v FROM f GROUP BY station, night""")
def stream_night_stack(spark, root):
    """End-of-night events, each of which starts the stack of its night."""
    target = scratch_path(spark, "nights")

    def frames():
        night = F.floor((F.col("timestamp") - timeline.NOON) / timeline.DAY).alias("night")
        rows = b.obs(spark, root).where("night_mode = 1").select("station", night, "timestamp", "brightness")
        return rows.select(F.concat_ws("/", "station", "night").alias("series"), "station", "night", F.col("timestamp").alias("seq"),
                           *[F.lit(0).alias(c) for c in "xyc"], F.floor(F.col("brightness") * 255).cast("int").alias("v"))

    events = state.ended_nights(_arriving(spark, root).select("station", "event_id", "timestamp", "night_mode"), delay=LATE)
    flows.run(events, "night-stack", batch=sinks.night_sink(target, frames))
    return sinks.stacks(spark, target).select("series", "n_frames", "v")


def _split(name, flow):
    """The same flow over shuffled files, one a micro-batch: same rows, same SQL."""
    query(f"{name}_split", ORACLE[name])(lambda spark, root: flow(spark, root, split=True))


for _name, _flow in (("stream_dedup", stream_dedup), ("stream_exposure", stream_exposure), ("stream_controller", stream_controller),
                     ("stream_night_end", stream_night_end), ("stream_throttle", stream_throttle), ("stream_hourly", stream_hourly),
                     ("stream_sessions", stream_sessions)):
    _split(_name, _flow)

"""Per-station operators whose step depends on the step before.

Each keeps, per station, the rows of the last ``keep`` seconds by day and the
state at the start of every one of these days.  Rows are stepped through in
order of time.  A row that comes behind what was stepped through goes to its
day; the station is stepped anew from that day's state to the first later day
whose state comes out as before.  What changes by it is given out again: the
output is a log, in which the row of the highest ``version`` holds (``current``)
and one that is not ``given`` takes an event back.  So what a stream gives does
not depend on how rows were split into micro-batches.

A row further behind than ``keep`` is given out as ``late`` and changes
nothing; late rows are a table of their own (``late``), and ``settle`` replays
the stations they concern.  Rows of the newest ``delay`` seconds wait.  State
is bounded by the rows of ``keep`` and ``delay`` seconds and one state a day.

A call to the state store costs more than a step, so stations are grouped into
``BUCKETS`` and a bucket's day is one entry of its state: a micro-batch reads
and writes an entry once for every day and bucket that it changes, however many
stations these have.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import namedtuple
from typing import Any, Callable, Iterable, Iterator, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noctule.functions.exposure import Controller, Limits, advance
from noctule.operators import timeline

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86400
#: Groups of stations: so many tasks at most, each of which holds a bucket's rows of a micro-batch and of the days they change.
BUCKETS = 1024

#: state tuple and row -> new state tuple and output values, or None
Step = Callable[[tuple, Any], tuple[tuple, tuple | None]]


FIRST = -1 << 63


def plain(value: Any) -> Any:
    """A state's value as Python has it, so that states can be compared."""
    return value.tolist() if hasattr(value, "tolist") else list(value) if isinstance(value, tuple) else value


class Fold(NamedTuple):
    """What a step starts from, and the columns it gives."""

    step: Step
    state: str
    initial: tuple
    gives: str

    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.gives.split(", ")] if self.gives else []


class Day(NamedTuple):
    """State before a day's first row, and its rows in order of time and event_id."""

    before: tuple
    rows: list[tuple]


class CorrectedFold(StatefulProcessor):
    """Folds a station's rows in order of ``timestamp``, then ``event_id``, and corrects what late rows change.

    ``event_id`` tells a station's rows apart.  A step is plain Python on one
    row: each needs the one before, so a station's chain is sequential.
    """

    def __init__(self, fold: Fold, rows: T.StructType, delay: int, keep: int):
        self.fold, self.delay, self.keep = fold, delay, keep
        fields = [f for f in rows.fields if f.name not in ("station", "timestamp", "event_id")]
        self.names = ["timestamp", "event_id", *(f.name for f in fields)]
        self.types = ["bigint", "bigint", *(f.dataType.simpleString() for f in fields)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = namedtuple("Row", self.names)
        arrays = ", ".join(f"r{i} array<{t}>" for i, t in enumerate(self.types))
        self.days = handle.getMapState("days", "day bigint", f"{self.fold.state}, {arrays}")
        self.mark = handle.getValueState("mark", "newest bigint, last_time bigint, last_id bigint, version bigint")

    def load(self, day: int) -> Day:
        value = tuple(self.days.getValue((day,)))
        width = len(value) - len(self.types)
        return Day(tuple(map(plain, value[:width])), list(zip(*(map(plain, c) for c in value[width:]), strict=True)))

    def store(self, day: int, held: Day) -> None:
        columns = [list(c) for c in zip(*held.rows, strict=True)] or [[] for _ in self.types]
        self.days.updateValue((day,), (*held.before, *columns))

    def run(self, state: tuple, rows: list[tuple]) -> tuple[tuple, dict[tuple, tuple]]:
        """The state behind the rows, and what was given for each."""
        out = {}
        for values in rows:
            state, given = self.fold.step(state, self.row(*values))
            if given is not None:
                out[values[:2]] = given
        return state, out

    def horizon(self, last: tuple | None) -> tuple | None:
        """Rows before this can change nothing any more."""
        return last and (last[0] - self.keep, FIRST if self.keep else last[1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values = (v for part in rows for v in zip(*(part[n].tolist() for n in self.names), strict=True))
        yield pd.DataFrame(self.correct(key[0], values), columns=self.output())

    def output(self) -> list[str]:
        return ["station", "event_id", "timestamp", *self.fold.columns(), "version", "given", "late"]

    def correct(self, station: Any, rows: Iterable[tuple]) -> list[tuple]:
        """What a station's new rows (in the order of ``names``) add to the log."""
        newest, *last, version = self.mark.get() if self.mark.exists() else (None, None, None, 0)
        last = tuple(last) if last[0] is not None else None
        settled, version = self.horizon(last), version + 1
        nothing = [None] * len(self.fold.columns())
        arrived: dict[int, list[tuple]] = {}
        out = []
        for values in rows:
            newest = values[0] if newest is None else max(newest, values[0])
            if settled is not None and values[:2] < settled:
                out.append((station, values[1], values[0], *nothing, version, False, True))
            else:
                arrived.setdefault(values[0] // DAY, []).append(values)
        held = sorted(k[0] for k in self.days.keys())
        changed, last = self.apply(held, arrived, last, newest - self.delay)
        out += [(station, event, time, *(nothing if given is None else given), version, given is not None, False) for (time, event), given in changed.items()]
        self.trim(sorted({*held, *arrived}), self.horizon(last))
        self.mark.update((newest, *(last or (None, None)), version))
        return out

    def apply(self, held: list[int], arrived: dict[int, list[tuple]], last: tuple | None, edge: int) -> tuple[dict, tuple | None]:
        """Puts new rows into their days and steps through rows up to ``edge``.

        Returns what comes out differently (None takes an event back), and the
        last row stepped through.
        """
        first = min([*arrived, *([last[0] // DAY] if last else held[:1])])
        changed: dict[tuple, tuple | None] = {}
        was_state = state = None
        before = last
        for day in sorted({*arrived, *(d for d in held if d >= first)}):
            old = self.load(day) if day in held else None
            if was_state is None:  # nothing before this day has changed
                later = next((d for d in held if d >= day), None)
                was_state = state = old.before if old else self.load(later).before if later is not None else self.end(held)
            was_state = old.before if old else was_state
            stepped = bool(old) and (not old.rows or before is not None and old.rows[-1][:2] <= before)
            if stepped and day not in arrived and state == was_state:
                was_state = state = None  # and nothing up to the next day that has new rows will
                continue
            rows = sorted([*(old.rows if old else []), *arrived.get(day, [])], key=lambda r: r[:2])
            now = [r for r in rows if r[0] <= edge or before is not None and r[:2] <= before]
            self.store(day, Day(state, rows))
            was_state, gave = self.run(was_state, [r for r in old.rows if before is not None and r[:2] <= before] if old else [])
            state, gives = self.run(state, now)
            changed |= {k: gives.get(k) for k in (gave | gives) if gave.get(k) != gives.get(k)}
            last = max([r[:2] for r in now[-1:]] + ([last] if last else []), default=None)
        return changed, last

    def end(self, held: list[int]) -> tuple:
        """State behind the last day there is."""
        if not held:
            return self.fold.initial
        newest = self.load(held[-1])
        return self.run(newest.before, newest.rows)[0]

    def trim(self, held: list[int], settled: tuple | None) -> None:
        """Drops rows that no row to come can be before; the state behind them stays."""
        for day in held:
            if settled is None or day > settled[0] // DAY:
                break
            now = self.load(day)
            gone = bisect_right([r[:2] for r in now.rows], settled)
            if gone == len(now.rows) and day != held[-1]:
                self.days.removeKey((day,))
            elif gone:
                self.store(day, Day(self.run(now.before, now.rows[:gone])[0], now.rows[gone:]))

    def close(self) -> None:
        pass


def values_of(column: pd.Series, whole: bool) -> list:
    """A column's values; missing ones turn whole numbers into floats, which is undone for the others."""
    values = column.tolist()
    return [int(v) if isinstance(v, float) and v == v else v for v in values] if whole and column.dtype.kind in "fO" else values


def read_packed(value: tuple | None, empty: Any) -> Any:
    return pickle.loads(value[0]) if value is not None else empty


class Mark:
    """A station's mark, as a value state has it."""

    def __init__(self, value: tuple | None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value


class BucketFold(CorrectedFold):
    """``CorrectedFold`` for a bucket of stations, one after the other.

    An entry of the state is a day with the rows of all stations of the bucket,
    which is read when the first of them needs it and written at the end.  The
    marks of the bucket's stations, with the days that each has, are one value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = namedtuple("Row", self.names)
        self.whole = [t in ("bigint", "int", "smallint", "tinyint") for t in self.types]
        self.packed = handle.getMapState("days", "day bigint", "packed binary")
        self.marks = handle.getValueState("marks", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[Any, list[tuple]] = {}
        for part in rows:
            columns = [values_of(part[n], w) for n, w in zip(self.names, self.whole, strict=True)]
            for station, values in zip(values_of(part["station"], True), zip(*columns, strict=True), strict=True):
                arrived.setdefault(None if station != station else station, []).append(values)
        marks = read_packed(self.marks.get(), {})
        #: days read so far, by station; those there are in the state; those to be written
        self.shelf: dict[int, dict[Any, tuple]] = {}
        self.there = {day for _, held in marks.values() for day in held}
        self.dirty: set[int] = set()
        out = []
        for station, values in arrived.items():
            mark, held = marks.get(station, (None, []))
            self.station, self.mark, self.days = station, Mark(mark), StationDays(self, held)
            out += self.correct(station, values)
            marks[station] = self.mark.value, list(self.days.held)
        for day in self.dirty:
            if self.shelf[day]:
                self.packed.updateValue((day,), (pickle.dumps(self.shelf[day], pickle.HIGHEST_PROTOCOL),))
            elif day in self.there:
                self.packed.removeKey((day,))
        self.marks.update((pickle.dumps(marks, pickle.HIGHEST_PROTOCOL),))
        del self.shelf
        yield pd.DataFrame(out, columns=self.output(), dtype=object)

    def on(self, day: int) -> dict[Any, tuple]:
        """A day of the bucket."""
        if day not in self.shelf:
            self.shelf[day] = read_packed(self.packed.getValue((day,)) if day in self.there else None, {})
        return self.shelf[day]

    def load(self, day: int) -> Day:
        return Day(*self.on(day)[self.station])

    def store(self, day: int, held: Day) -> None:
        self.on(day)[self.station] = tuple(held)
        self.days.held.add(day)
        self.dirty.add(day)


class StationDays:
    """The days that one station of a bucket has."""

    def __init__(self, bucket: BucketFold, held: list[int]):
        self.bucket, self.held = bucket, set(held)

    def keys(self) -> Iterator[tuple]:
        return ((day,) for day in self.held)

    def removeKey(self, key: tuple) -> None:
        day, = key
        del self.bucket.on(day)[self.bucket.station]
        self.held.discard(day)
        self.bucket.dirty.add(day)


LOG = "version bigint, given boolean, late boolean"


def _schema(fold: Fold, *more: str) -> str:
    return ", ".join(["station bigint, event_id bigint, timestamp bigint", *([fold.gives] if fold.gives else []), *more])


def bucketed(rows: DataFrame) -> GroupedData:
    return rows.withColumn("_bucket", F.pmod(F.hash("station"), F.lit(BUCKETS))).groupBy("_bucket")


def _run(rows: DataFrame, fold: Fold, delay: int, keep: int) -> DataFrame:
    """A stream gives a log of what holds; a table is replayed to what holds at the end."""
    if not rows.isStreaming:
        return replay(rows, fold)
    return bucketed(rows).transformWithStateInPandas(
        statefulProcessor=BucketFold(fold, rows.schema, delay, keep), outputStructType=_schema(fold, LOG), outputMode="Append", timeMode="None")


def current(log: DataFrame) -> DataFrame:
    """What holds after a stream's log: the newest version of every event that was not taken back."""
    values = [c for c in log.columns if c not in ("station", "event_id", "version", "late")]
    newest = log.where("NOT late").groupBy("station", "event_id").agg(F.max_by(F.struct(*values), "version").alias("_v"))
    return newest.where("_v.given").select("station", "event_id", *[f"_v.{c}" for c in values if c != "given"])


def late(log: DataFrame) -> DataFrame:
    """Rows that came too late to change anything."""
    return log.where("late").select("station", "event_id", "timestamp")


def settle(log: DataFrame, history: DataFrame, operator: Callable[[DataFrame], DataFrame], delay: int = 0) -> DataFrame:
    """Repair after rows came later than ``keep``: ``current`` with the stations of late rows replayed from ``history``.

    With a ``delay`` the rows still held are taken from a replay too, which
    then needs every station.
    """
    stations = late(log).select("station").distinct()
    mended = operator(history.join(stations, "station", "left_semi"))
    whole = current(log).join(stations, "station", "left_anti").unionByName(mended)
    if delay:
        newest = history.groupBy("station").agg((F.max("timestamp") - delay).alias("_from"))
        held = operator(history.join(stations, "station", "left_anti")).join(newest, "station").where("timestamp > _from").drop("_from")
        whole = whole.unionByName(held)
    return whole


def replay(rows: DataFrame, fold: Fold) -> DataFrame:
    """Batch twin of the stateful operators, for history.

    Rows stream through sorted partitions in Arrow batches; a task holds one
    batch and one state, however long a station's chain is.  The chain itself
    is sequential: every step needs the one before."""
    step, initial, names = fold.step, fold.initial, ["station", "event_id", "timestamp", *fold.columns()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        station, state = None, initial
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.station != station:
                    station, state = row.station, initial
                state, values = step(state, row)
                if values is not None:
                    out.append((station, row.event_id, row.timestamp, *values))
            yield pd.DataFrame(out, columns=names)

    ordered = rows.repartition("station").sortWithinPartitions("station", "timestamp", "event_id")
    return ordered.mapInPandas(run, _schema(fold))


def exposure_control(rows: DataFrame, limits: Limits, start: tuple[float, float],
                     targets: tuple[float, float], delay: int = 0, keep: int = 0) -> DataFrame:
    """Exposure and gain after each observation; the output of a step is the
    input of the next.  ``targets`` are the day and night brightness.  Rows
    carry ``brightness`` and ``night_mode``."""

    def step(state, row):
        state = advance(row.brightness, state[0], state[1], targets[int(row.night_mode)], limits)
        return state, state

    return _run(rows, Fold(step, "exposure double, gain double", start, "exposure double, gain double"), delay, keep)


def damped_control(rows: DataFrame, controller: Controller, start: tuple[float, float], delay: int = 0, keep: int = 0) -> DataFrame:
    """Shutter, gain and lamp of the damped controller.  Medians outside
    0..1 leave everything as it is."""

    def step(state, row):
        recent, shutter, gain, lamp = list(state[0]), state[1], state[2], state[3]
        if 0.0 < row.brightness <= 1.0:
            recent, shutter, gain, lamp = controller.advance(float(row.brightness), recent, shutter, gain, lamp)
        return (recent, shutter, gain, lamp), (shutter, gain, lamp)

    fold = Fold(step, "recent array<double>, shutter double, gain double, lamp int", ([], *start, 0), "shutter double, gain double, lamp int")
    return _run(rows, fold, delay, keep)


def night_ends(rows: DataFrame, delay: int = 0, keep: int = 0) -> DataFrame:
    """An event for each observation by day that follows one by night."""
    if not rows.isStreaming:
        ends = timeline.state_changes(rows, ["station"], "timestamp", "night_mode", ["event_id"], before=1, after=0)
        return ends.select("station", "event_id", "timestamp")

    def step(state, row):
        night = int(row.night_mode)
        return (night,), () if state[0] == 1 and night == 0 else None

    return _run(rows, Fold(step, "night int", (0,), ""), delay, keep)


def ended_nights(rows: DataFrame, delay: int = 0, keep: int = 0, turn: int = timeline.NOON) -> DataFrame:
    """``night_ends`` with the number of the night that has ended, as ``timeline.night_series`` counts them."""

    def step(state, row):
        at = int(row.timestamp) if row.night_mode else None
        return (at,), ((state[0] - turn) // DAY,) if at is None and state[0] is not None else None

    return _run(rows, Fold(step, "at bigint", (None,), "night bigint"), delay, keep)


def throttle(rows: DataFrame, interval: int, delay: int = 0, keep: int = 0) -> DataFrame:
    """Observations more than ``interval`` seconds after the last one let through."""

    def step(state, row):
        if state[0] is None or row.timestamp > state[0] + interval:
            return (int(row.timestamp),), ()
        return state, None

    return _run(rows, Fold(step, "accepted bigint", (None,), ""), delay, keep)


def runs(rows: DataFrame, gap: int, delay: int = 0, keep: int = 0) -> DataFrame:
    """For each observation the start of its run and its number in it; a pause of ``gap`` seconds ends a run."""

    def step(state, row):
        first, last, n = state
        first, n = (int(row.timestamp), 1) if last is None or row.timestamp - last >= gap else (first, n + 1)
        return (first, int(row.timestamp), n), (first, n)

    return _run(rows, Fold(step, "first bigint, last bigint, n bigint", (None, None, 0), "first bigint, n bigint"), delay, keep)


def sessions(told: DataFrame, gap: int) -> DataFrame:
    """Runs of captures from the rows of ``runs``: what lies between two runs is an outage."""
    return told.groupBy("station", "first").agg((F.max("timestamp") + gap).alias("until"), F.max("n").alias("captures"))

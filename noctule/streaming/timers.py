"""Operators on event-time timers: silence itself gives a row.

Rows wait until the watermark has passed them and are then taken in order of
time, so rows may come in any order within the watermark's delay.  A timer
stands at the oldest waiting row or at the end of the silence that a station is
allowed, whichever is first; it goes off without any new row of the station.
State is the rows within the delay and a few numbers.
"""

from __future__ import annotations

import pickle
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noctule.streaming.state import bucketed, read_packed, values_of


class Station:
    """Rows that wait, counters, and the second at which the station has something to tell."""

    def __init__(self, waiting=(), last=None, told=False, captures=0, failures=0, in_a_row=0, timeouts=0, wake=None):
        self.waiting, self.last, self.told, self.wake = list(waiting), last, told, wake
        self.captures, self.failures, self.in_a_row, self.timeouts = captures, failures, in_a_row, timeouts


class Watch(StatefulProcessor):
    """Waits for the watermark, then tells of silences over ``limit`` seconds and of failures.

    Counters run over the whole life of a station: captures, failures, failures
    in a row, timeouts.  The stations of a bucket are one value of the state and
    share one timer, as a call to the state store costs more than a row.
    """

    COLUMNS = ["station", "kind", "timestamp", "due", "captures", "failures", "in_a_row", "timeouts"]

    def __init__(self, limit: int, alarm: int):
        self.limit, self.alarm = limit, alarm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stations = handle.getValueState("stations", "timer bigint, packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self.load()
        for part in rows:
            columns = [values_of(part[n], w) for n, w in (("station", True), ("timestamp", True), ("event_id", True), ("failed", False))]
            for station, *row in zip(*columns, strict=True):
                one = held.setdefault(None if station != station else station, Station())
                one.waiting.append(tuple(row))
                one.wake = row[0] if one.wake is None else min(one.wake, row[0])
        self.store(timer, held)
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        _, held = self.load()
        out = [row for station, one in held.items() if one.wake is not None and one.wake <= now for row in self.passed(station, one, now)]
        self.store(None, held)
        yield pd.DataFrame(out, columns=self.COLUMNS, dtype=object)

    def passed(self, station: int, one: Station, now: int) -> list[tuple]:
        """Takes a station's rows up to the watermark, and tells of what it has passed."""
        out = []

        def silence(until: int | None) -> None:
            due = None if one.last is None else one.last + self.limit
            if not one.told and due is not None and due <= now and (until is None or until > due):
                one.told, one.timeouts = True, one.timeouts + 1
                out.append((station, "timeout", one.last, due, one.captures, one.failures, one.in_a_row, one.timeouts))

        waiting = sorted(one.waiting)
        for time, _, failed in (r for r in waiting if r[0] <= now):
            silence(time)
            one.last, one.told, one.captures = time, False, one.captures + 1
            one.failures, one.in_a_row = (one.failures + 1, one.in_a_row + 1) if failed else (one.failures, 0)
            if failed and one.in_a_row % self.alarm == 0:
                out.append((station, "failures", one.last, one.last, one.captures, one.failures, one.in_a_row, one.timeouts))
        silence(None)
        one.waiting = [r for r in waiting if r[0] > now]
        one.wake = min([r[0] for r in one.waiting[:1]] + ([one.last + self.limit] if one.last is not None and not one.told else []), default=None)
        return out

    def load(self) -> tuple[int | None, dict]:
        """The second at which the bucket's timer goes off, and its stations."""
        timer, *packed = self.stations.get() or (None, None)
        return timer, {k: Station(**v) for k, v in read_packed(packed if packed[0] is not None else None, {}).items()}

    def store(self, before: int | None, held: dict) -> None:
        """Keeps the stations, and sets the bucket's one timer to the first second at which one of them has something to tell."""
        at = min((one.wake for one in held.values() if one.wake is not None), default=None)
        if at is not None and at != before:
            if before is not None:
                self.handle.deleteTimer(before * 1000 - 1)
            self.handle.registerTimer(at * 1000 - 1)
        self.stations.update((at, pickle.dumps({k: vars(one) for k, one in held.items()}, pickle.HIGHEST_PROTOCOL)))

    def close(self) -> None:
        pass


def watch(rows: DataFrame, limit: int, alarm: int, delay: str, time: str = "ts") -> DataFrame:
    """Silences and runs of failures of a stream (station, event_id, timestamp, failed, and the event time ``time``).

    A ``timeout`` row tells of a capture that none followed for ``limit``
    seconds; a ``failures`` row of every ``alarm``-th failure in a row.  Both
    carry the station's counters up to then.
    """
    needed = rows.select("station", "event_id", "timestamp", F.coalesce("failed", F.lit(True)).alias("failed"), time).withWatermark(time, delay)
    return bucketed(needed).transformWithStateInPandas(
        statefulProcessor=Watch(limit, alarm), outputMode="Append", timeMode="EventTime",
        outputStructType="station bigint, kind string, timestamp bigint, due bigint, captures bigint, failures bigint, in_a_row bigint, timeouts bigint")

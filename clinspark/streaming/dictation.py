"""Dictation entries out of start and stop events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ENTRIES = (
    "session_id string, nr long, start_ts timestamp, end_ts timestamp, duration_s double"
)


BUCKET_MS = 60_000


class EntryPairing(StatefulProcessor):
    """Events wait in state until the watermark has passed them and are paired in event-time order.

    Waiting events lie in a map by minute, so an event is written when it comes and read when it is due,
    however many others wait. Next to them a session keeps an open start, the number of entries so far,
    its last event time, the moment its earliest waiting event is due and its one timer: that moment or,
    if nothing waits, the end of its idle time, ``idle_ms`` after the last event, when it is forgotten.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute long", "micros array<long>, kinds array<string>")
        self.state = handle.getValueState("entry", "opened long, nr long, last_ms long, due_ms long, timer_ms long")

    def _held(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (None, 0, 0, None, None)

    def _keep(self, opened: int | None, number: int, last: int, due: int | None, timer: int | None) -> None:
        wanted = last + self.idle_ms if due is None else due
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.state.update((opened, number, last, due, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, number, last, due, timer = self._held()
        buckets: dict[int, list[tuple[int, str]]] = {}
        for frame in rows:
            for event in frame.itertuples():
                micros = _micros(event.ts.to_pydatetime())
                buckets.setdefault(_millis(micros) // BUCKET_MS, []).append((micros, event.kind))
        for minute, events in buckets.items():
            last = max(last, _millis(max(events)[0]))
            first = _millis(min(events)[0]) + 1  # timers fire once the watermark is past them
            due = first if due is None else min(due, first)
            self._put(minute, [*self._events(minute), *events])
        self._keep(opened, number, last, due, timer)
        yield _entries([])

    def _events(self, minute: int) -> list[tuple[int, str]]:
        if not self.waiting.containsKey((minute,)):
            return []
        micros, kinds = self.waiting.getValue((minute,))
        return list(zip(micros, kinds))

    def _put(self, minute: int, events: list[tuple[int, str]]) -> None:
        self.waiting.updateValue((minute,), ([micros for micros, _ in events], [kind for _, kind in events]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All events that the watermark has passed, not only the one the timer was for."""
        moment = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        opened, number, last, _, _ = self._held()
        minutes = sorted(int(minute[0]) for minute in self.waiting.keys())
        passed = [minute for minute in minutes if minute * BUCKET_MS < moment]
        events = sorted(event for minute in passed for event in self._events(minute))
        later = [event for event in events if _millis(event[0]) >= moment]  # of the last minute alone
        out = []
        for micros, kind in events[: len(events) - len(later)]:
            if kind == "start" and opened is None:
                opened = micros
            elif kind == "stop" and opened is not None:
                number += 1
                out.append((key[0], number, _moment(opened), _moment(micros), round((micros - opened) / 1_000_000, 1)))
                opened = None
        for minute in passed:
            self.waiting.removeKey((minute,))
        if later:
            self._put(passed[-1], later)
        ahead = later or (self._events(minutes[len(passed)]) if len(passed) < len(minutes) else [])
        if not ahead and moment >= last + self.idle_ms:
            self.waiting.clear()
            self.state.clear()
        else:
            self._keep(opened, number, last, _millis(min(ahead)[0]) + 1 if ahead else None, None)
        yield _entries(out)

    def close(self) -> None:
        pass


def _micros(ts: dt.datetime) -> int:
    """Microseconds since 1970; a moment without a zone is in UTC, as the columns of pandas hold it."""
    zoned = ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)
    return round((zoned - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def _moment(micros: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def _entries(rows: list[tuple]) -> pd.DataFrame:
    columns = ["session_id", "nr", "start_ts", "end_ts", "duration_s"]
    return pd.DataFrame(rows, columns=columns).astype({"start_ts": "datetime64[us]", "end_ts": "datetime64[us]"})


def dictation_stream(
    events: DataFrame, lateness: str = "10 minutes", idle_ms: int = 12 * 60 * 60 * 1000
) -> DataFrame:
    """Numbered entries of a stream of (session_id, ts, kind) with kind start or stop.

    Events are paired in the order of their times, whatever batch they come in: an event waits until
    the watermark (``lateness`` behind the latest event) has passed it. A second start before a stop is
    ignored, as is a stop without a start. Events later than ``lateness`` are dropped; Spark counts
    them in the query's progress as ``numRowsDroppedByWatermark``. A session without events for
    ``idle_ms`` is forgotten and would be numbered from 1 again.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy("session_id")
        .transformWithStateInPandas(
            EntryPairing(idle_ms), StructType.fromDDL(ENTRIES), "append", "EventTime"
        )
    )

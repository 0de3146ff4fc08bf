"""Items that are watched while they are written: handed on once, when whole and at rest; restarted once, when a successor fails to start.

Both keep a state per item that survives restarts of the stream from its checkpoint, and timers, so
that an item goes on although nothing more is heard of it. Time is the event time of the sightings
with a watermark, which repeats exactly, or the clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_timers(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set(_PROVIDER, _ROCKS)


def _ms(x: pd.Timestamp) -> int:
    return int(x.timestamp() * 1000)


class _Timed(StatefulProcessor):
    """One value per item and at most one timer, at ``due`` milliseconds."""

    state = ""

    def __init__(self, by_event_time: bool):
        self.by_event_time = by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def set_timer(self, due: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if due is not None:
            self.handle.registerTimer(due)

    def in_order(self, rows: Iterator[Row], now: int) -> list[tuple[int, Row]]:
        """Rows with their times: event times in order, else the clock's."""
        return sorted(((_ms(r.seen_at), r) for r in rows), key=lambda x: x[0]) if self.by_event_time else [(now, r) for r in rows]

    def close(self) -> None:
        pass


class StableItems(_Timed):
    """Hands an item on when its size has stood still for a time and every required file was seen."""

    state = "size long, since long, files array<string>, done boolean"

    def __init__(self, seconds: int, required: tuple[str, ...] = (), by_event_time: bool = True):
        super().__init__(by_event_time)
        self.wait, self.required = seconds * 1000, frozenset(required)

    def _rested(self, held: tuple, now: int) -> bool:
        size, since, files, done = held
        return size is not None and not done and self.required <= set(files) and now - since >= self.wait

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else (None, 0, [], False)
        for now, row in self.in_order(rows, timerValues.getCurrentProcessingTimeInMs()):
            if held[3]:
                break
            size, since, files, _ = held
            if self._rested(held, now):
                held = (size, since, files, True)
                yield self._out(key, size, since)
                break
            files = [*files, *sorted(set(row.files or []) - set(files))]
            held = (row.size, now if row.size != size else since, files, False)
            if self._rested(held, now):  # the last file came after the size had come to rest
                held = (*held[:3], True)
                yield self._out(key, *held[:2])
        self.held.update(held)
        self.set_timer(None if held[3] or held[0] is None else held[1] + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = tuple(self.held.get())
        if self._rested(held, expiredTimerInfo.getExpiryTimeInMs()):
            self.held.update((*held[:3], True))
            yield self._out(key, *held[:2])

    def _out(self, key, size: int, since: int) -> Row:
        return Row(item=key[0], size=size, since=pd.Timestamp(since, unit="ms").to_pydatetime())


class GraceRestart(_Timed):
    """Asks for one restart of an item whose run has ended while its successor isn't active after a grace time.

    States of a sighting: running, ended, active. Running again takes back an end; active settles the item.
    """

    state = "ended long, restarted boolean, settled boolean"

    def __init__(self, seconds: int, by_event_time: bool = True):
        super().__init__(by_event_time)
        self.grace = seconds * 1000

    def _due(self, held: tuple, now: int) -> bool:
        ended, restarted, settled = held
        return ended is not None and not restarted and not settled and now - ended >= self.grace

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else (None, False, False)
        for now, row in self.in_order(rows, timerValues.getCurrentProcessingTimeInMs()):
            if self._due(held, now):
                yield self._out(key, held[0])
                held = (held[0], True, False)
            ended, restarted, settled = held
            if row.state == "running":
                ended = None
            elif row.state == "ended":
                ended = now if ended is None else ended
            held = (ended, restarted, settled or row.state == "active")
        self.held.update(held)
        self.set_timer(None if held[0] is None or held[1] or held[2] else held[0] + self.grace)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = tuple(self.held.get())
        if self._due(held, expiredTimerInfo.getExpiryTimeInMs()):
            self.held.update((held[0], True, held[2]))
            yield self._out(key, held[0])

    def _out(self, key, ended: int) -> Row:
        return Row(item=key[0], ended=pd.Timestamp(ended, unit="ms").to_pydatetime())


def _watched(sightings: DataFrame, processor: _Timed, out: str, late: str) -> DataFrame:
    keep_timers(sightings.sparkSession)
    rows = sightings.withWatermark("seen_at", late) if processor.by_event_time else sightings
    return rows.groupBy("item").transformWithState(processor, out, "append", "EventTime" if processor.by_event_time else "ProcessingTime")


def stable_items(sightings: DataFrame, seconds: int, required: tuple[str, ...] = (), by_event_time: bool = True, late: str = "0 seconds") -> DataFrame:
    """item, size, since of each item at rest, once, from a stream of (item, size, files, seen_at)."""
    kind = sightings.schema["item"].dataType.simpleString()
    return _watched(sightings, StableItems(seconds, required, by_event_time), f"item {kind}, size long, since timestamp", late)


def grace_restarts(sightings: DataFrame, seconds: int, by_event_time: bool = True, late: str = "0 seconds") -> DataFrame:
    """item, ended of each item that is to be restarted, once, from a stream of (item, state, seen_at)."""
    kind = sightings.schema["item"].dataType.simpleString()
    return _watched(sightings, GraceRestart(seconds, by_event_time), f"item {kind}, ended timestamp", late)

"""Live node durations and session status: per-key state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltworks.operators.runlog import INITIAL_STATUS, STATUS_BY_EVENT

_SPANS = "session string, node string, seq long, duration_ms long, revision int"
_OPEN = "micros long"
_RECENT = "seq long, micros long, is_start boolean, duration_ms long, revision int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """Starts and ends of one session and node, in the order of their sequence, whatever order they arrive in.

    Events the watermark has not passed are kept, since an earlier one may still come; the start left open before them
    is one number, kept until its end arrives, or for ``expiry_ms`` of event time where that is set. An end is told at
    once, and told again with a higher revision when an event that came late changes its duration.
    """

    def __init__(self, expiry_ms: int | None) -> None:
        self._expiry = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", _OPEN)
        self._recent = handle.getListState("recent", _RECENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = list(self._recent.get())
        for frame in rows:
            events += [(int(s), int(m), bool(b), None, 0) for s, m, b in zip(frame["seq"], frame["micros"], frame["is_start"])]
        yield from self._advance(key, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, list(self._recent.get()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key, events: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        started = self._open.get()[0] if self._open.exists() else None
        events.sort(key=lambda e: (e[0], e[1]))
        settled = 0
        while settled < len(events) and events[settled][1] // 1000 <= watermark:
            settled += 1
        told, kept, still_open = [], [], started
        for i, (seq, micros, is_start, duration, revision) in enumerate(events):
            if is_start:
                started = micros
            else:
                found = None if started is None else (micros - started) // 1000
                started = None
                if not revision or found != duration:
                    duration, revision = found, revision + 1
                    told.append((key[0], key[1], seq, duration, revision))
            if i < settled:
                still_open = started
            else:
                kept.append((seq, micros, is_start, duration, revision))
        self._keep(kept, still_open, watermark)
        if told:
            frame = pd.DataFrame(told, columns=["session", "node", "seq", "duration_ms", "revision"])
            yield frame.astype({"duration_ms": "Int64", "revision": "int32"})

    def _keep(self, kept: list[tuple], still_open: int | None, watermark: int) -> None:
        expires = None if still_open is None or self._expiry is None else still_open // 1000 + self._expiry
        if expires is not None and expires <= watermark:
            still_open = expires = None
        if still_open is None:
            self._open.clear()
        else:
            self._open.update((still_open,))
        if kept:
            self._recent.put(kept)
        else:
            self._recent.clear()
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        wake = max(e[1] for e in kept) // 1000 + 1 if kept else expires
        if wake is not None:
            self._handle.registerTimer(max(wake, watermark + 1))


def live_durations(
    df: DataFrame, session: str, node: str, seq: str, ts: str, kind: str, start: str, end: str, lateness: str = "1 hour", expiry_hours: float | None = None
) -> DataFrame:
    """End events with the time since the latest unmatched start of their node, across micro-batches, however long ago it was.

    Events may arrive out of order by up to the lateness; an end whose duration changes thereby comes again with a higher
    ``revision`` (``settled_durations`` keeps the last). Later ones do not take part. An open start takes a few bytes of state
    until its end comes, or until ``expiry_hours`` of event time have passed. State lives in RocksDB, which this switches on.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    moment = F.col(ts).cast("timestamp")
    events = df.where(F.col(kind).isin(start, end)).select(
        F.col(session).cast("string").alias("session"),
        F.col(node).cast("string").alias("node"),
        F.col(seq).cast("long").alias("seq"),
        moment.alias("ts"),
        F.unix_micros(moment).alias("micros"),
        (F.col(kind) == start).alias("is_start"),
    )
    expiry = None if expiry_hours is None else round(expiry_hours * 3_600_000)
    watched = events.withWatermark("ts", lateness)
    return watched.groupBy("session", "node").transformWithStateInPandas(Pairing(expiry), _SPANS, "Append", "EventTime")


def settled_durations(told: DataFrame) -> DataFrame:
    """The last revision of every end."""
    last = told.groupBy("session", "node", "seq").agg(F.max_by("duration_ms", "revision").alias("duration_ms"))
    return last.select("session", "node", "seq", "duration_ms")


def live_status(df: DataFrame, session: str, seq: str, kind: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Latest status per session; on a stream run it in update mode. One small aggregate row of state per session."""
    status = F.lit(None).cast("string")
    for event, name in (mapping or STATUS_BY_EVENT).items():
        status = F.when(F.col(kind) == event, name).otherwise(status)
    folded = df.groupBy(session).agg(F.max(F.when(status.isNotNull(), F.struct(F.col(seq).alias("seq"), status.alias("status")))).alias("s"))
    return folded.select(session, F.coalesce("s.status", F.lit(INITIAL_STATUS)).alias("status"))

"""Timers of monitors and a cache with a lifetime, as keyed streams: state, registered timers and expiry are Spark's.

A monitor's state is its timer, the status that commands gave it and the number of the last command; a command registers or deletes
an event-time timer and the watermark fires it. A cache entry is a value that state forgets after its lifetime. Both restart from their
checkpoint. Memory of a task is one key's rows of one micro-batch in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD = "monitor_id long, seq long, event string, status string, alarm_at long"
CACHED = "origin long, seq long, from_cache boolean, entry long"


def stateful(spark: SparkSession) -> None:
    """Timers and lifetimes need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def value(x) -> int | None:
    return None if pd.isna(x) else int(x)


class MonitorTimers(StatefulProcessor):
    """Commands (monitor_id, seq, command, at, next_at, next_run_at; seconds) to timers, fired ones included.

    schedule, checked and deferred set the timer to next_at (none if null), resume to the stored next_run_at, else at once; pause and
    policy_stopped clear it; pause and resume give the status. Commands count in the order of seq; one that is not newer than the last changes nothing,
    so a replayed batch has no effect. One row is told per monitor and batch, and one when a timer fires, which ends the timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("timer", "seq long, status string, alarm_at long")

    def setting(self, alarm: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if alarm is not None:
            self.handle.registerTimer(alarm * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, status, alarm = self.state.get() if self.state.exists() else (-1, None, None)
        changed = False
        for row in pd.concat(rows).sort_values("seq").itertuples():
            if row.seq <= seq:
                continue
            seq, changed = int(row.seq), True
            if row.command in ("pause", "resume"):
                status = "paused" if row.command == "pause" else "active"
            if row.command == "resume":
                stored = value(row.next_run_at)
                alarm = int(row.at) if stored is None else stored
            else:
                alarm = value(row.next_at) if row.command in ("schedule", "checked", "deferred") else None
        if changed:
            self.setting(alarm)
            self.state.update((seq, status, alarm))
            yield pd.DataFrame([(key[0], seq, "set", status, alarm)], columns=["monitor_id", "seq", "event", "status", "alarm_at"]).astype({"alarm_at": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, status, alarm = self.state.get()
        if alarm is not None and alarm * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((seq, status, None))
            yield pd.DataFrame([(key[0], seq, "fired", status, alarm)], columns=["monitor_id", "seq", "event", "status", "alarm_at"]).astype({"alarm_at": "Int64"})

    def close(self) -> None:
        pass


def monitor_timers(commands: DataFrame) -> DataFrame:
    """monitor_id, seq, event (set, fired), status, alarm_at of a stream of commands with a watermark."""
    stateful(commands.sparkSession)
    return commands.groupBy("monitor_id").transformWithStateInPandas(MonitorTimers(), TOLD, "Append", "EventTime")


class LivingCache(StatefulProcessor):
    """Lookups (origin, seq) against entries that state forgets after ``lifetime_ms``; a miss makes a new entry."""

    def __init__(self, lifetime_ms: int) -> None:
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "seq long", ttlDurationMs=self.lifetime_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = self.entry.get()[0] if self.entry.exists() else None
        for seq in sorted(int(x) for batch in rows for x in batch["seq"]):
            out.append((key[0], seq, held is not None, seq if held is None else held))
            if held is None:
                held = seq
                self.entry.update((seq,))
        yield pd.DataFrame(out, columns=["origin", "seq", "from_cache", "entry"])

    def close(self) -> None:
        pass


def living_cache(lookups: DataFrame, lifetime_ms: int = 3_600_000) -> DataFrame:
    """origin, seq, from_cache, entry of a stream of lookups; an entry lives ``lifetime_ms`` of processing time from when it was made."""
    stateful(lookups.sparkSession)
    return lookups.groupBy("origin").transformWithStateInPandas(LivingCache(lifetime_ms), CACHED, "Append", "ProcessingTime")

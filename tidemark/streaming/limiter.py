"""The per-origin limiter: spacing, leases, backoff, breaker and half-open probe over time-ordered attempts.

The same step runs as a stream (state per origin) and over a stored table (sorted partitions read once).
Its clock is the event time of the rows, so that a replay decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values, in milliseconds where they are times.
SPACING, LEASES, LEASE_TTL, THRESHOLD, OPEN_MS, BASE_MS, MOST_MS = 10_000, 2, 60_000, 5, 300_000, 10_000, 300_000
INPUT = ["attempt_id", "origin_id", "at_ms", "hold_ms", "failed", "wait_ms"]
OUTPUT = "attempt_id long, origin_id long, granted boolean, retry_after_ms long, streak long"
STATE = "last long, next long, streak long, open_until long, probe_until long, lease_a long, lease_b long, failed_a boolean, failed_b boolean, start_a long, start_b long, wait_a long, wait_b long"
NEVER = -1


@dataclass
class Limiter:
    """State of one origin. A lease ends ``hold_ms`` after it was granted, or by its time to live; its outcome counts then.

    A failure's wait doubles with the streak; one that names a longer wait itself (a 429 with Retry-After) gets that.
    """

    last: int = NEVER
    next: int = 0
    streak: int = 0
    open_until: int = NEVER
    probe_until: int = NEVER
    lease_a: int = NEVER
    lease_b: int = NEVER
    failed_a: bool = False
    failed_b: bool = False
    start_a: int = NEVER
    start_b: int = NEVER
    wait_a: int = 0
    wait_b: int = 0

    def settle(self, now: int) -> None:
        """Leases that ended by ``now``, in order of their ends."""
        for end, slot in sorted((getattr(self, f"lease_{s}"), s) for s in "ab"):
            if end == NEVER or end > now:
                continue
            start, failed = getattr(self, f"start_{slot}"), getattr(self, f"failed_{slot}")
            setattr(self, f"lease_{slot}", NEVER)
            if end - start >= LEASE_TTL:
                continue  # expired: no outcome came
            if not failed:
                self.streak, self.open_until, self.next = 0, NEVER, 0
            else:
                self.streak += 1
                self.next = end + max(getattr(self, f"wait_{slot}"), min(MOST_MS, BASE_MS * 2 ** min(self.streak - 1, 30)))
                if self.streak >= THRESHOLD:
                    self.open_until = end + OPEN_MS
        if self.probe_until != NEVER and self.probe_until <= now:
            self.probe_until = NEVER

    def ask(self, now: int, hold: int, failed: bool, wait: int = 0) -> tuple[bool, int]:
        """Whether an attempt may go, and how long to wait if not."""
        self.settle(now)
        probing = self.open_until != NEVER
        if probing and now < self.open_until:
            return False, self.open_until - now
        if probing and self.probe_until != NEVER:
            return False, SPACING
        free = [s for s in "ab" if getattr(self, f"lease_{s}") == NEVER]
        if not free:
            return False, SPACING
        earliest = max(self.last + SPACING if self.last != NEVER else 0, self.next)
        if not probing and now < earliest:
            return False, earliest - now
        end = now + min(hold, LEASE_TTL)
        setattr(self, f"lease_{free[0]}", end)
        setattr(self, f"start_{free[0]}", now)
        setattr(self, f"failed_{free[0]}", failed)
        setattr(self, f"wait_{free[0]}", wait)
        self.last = now
        if probing:
            self.open_until, self.probe_until = NEVER, end
        return True, 0


def decide(limiter: Limiter, rows: pd.DataFrame) -> pd.DataFrame:
    """Decisions on one origin's rows in order."""
    out = []
    for i, o, at, hold, failed, asked in rows[INPUT].itertuples(index=False):
        granted, wait = limiter.ask(int(at), int(hold), bool(failed), int(asked))
        out.append((i, o, granted, wait, limiter.streak))
    return pd.DataFrame(out, columns=["attempt_id", "origin_id", "granted", "retry_after_ms", "streak"])


def limited(attempts: DataFrame) -> DataFrame:
    """Decisions over a stored table: ``attempts`` with the columns INPUT.

    Partitions hold whole origins sorted by time and are read batch by batch; only the state of the origin
    at hand is kept, so an origin with many attempts needs no memory for them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, Limiter()
        for batch in batches:
            for origin, rows in batch.groupby("origin_id", sort=False):
                if origin != current:
                    current, limiter = origin, Limiter()
                yield decide(limiter, rows)

    dealt = attempts.select(*INPUT).repartition("origin_id").sortWithinPartitions("origin_id", "at_ms", "attempt_id")
    return dealt.mapInPandas(run, OUTPUT)


def limited_stream(attempts: DataFrame) -> DataFrame:
    """The same over a stream; state per origin outlives batches and is kept, as a streak has no end in time.

    A micro-batch holds an origin's attempts in memory while it is sorted; the trigger's size bounds them.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = Limiter(*state.get) if state.exists else Limiter()
        rows = pd.concat(list(frames)).sort_values(["at_ms", "attempt_id"])
        yield decide(limiter, rows)
        state.update(tuple(asdict(limiter).values()))

    return attempts.select(*INPUT).groupBy("origin_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def attempts_of(events: DataFrame) -> DataFrame:
    """Attempts from rows (attempt_id, origin_id, seen_at, ok, status_code): each holds its lease for up to 20 s; a 429 asks for a wait."""
    wait = F.when(F.col("status_code") == 429, 1000 * (F.col("attempt_id") % 900)).otherwise(0).alias("wait_ms")
    return events.select("attempt_id", "origin_id", F.unix_millis("seen_at").alias("at_ms"), (1000 + F.col("attempt_id") % 20_000).alias("hold_ms"), (~F.col("ok") | (F.col("status_code") == 429)).alias("failed"), wait)

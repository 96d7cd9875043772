"""State after a mutation: updates of stored rows, replacement of whole groups, guarded deletes, held watermarks.

Parquet has no update, so every operator returns the relation as it stands afterwards. Updates are combined to one row per
key before they are shuffled; a key that is updated very often costs each task one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import latest, upsert, without

BREAKER_FAILURES, BREAKER_S = 5, 300


def updated(stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``stored`` with the last change of each key where it is not null; keys that are not stored are ignored."""
    last = latest(changes, keys, order)
    given = [c for c in stored.columns if c in last.columns and c not in keys]
    new = last.select(*keys, *[F.col(c).alias(f"_{c}") for c in given])
    joined = stored.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in stored.columns])


def upsert_keeping(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]) -> DataFrame:
    """An upsert in which the columns ``keep`` of rows that were stored before stay, as identifiers and creation times do."""
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    both = upsert(stored, batch, keys, order).join(old, list(keys), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in stored.columns])


def replaced(stored: DataFrame, batch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``stored`` with every group that ``batch`` holds replaced as a whole."""
    return without(stored, batch, groups).unionByName(batch.select(*stored.columns))


def guarded_delete(df: DataFrame, wanted: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``outcome``: kept, deleted, or refused where rows of ``children`` stand on it."""
    flag = lambda x, name: x.select(*keys).distinct().withColumn(name, F.lit(True))
    met = df.join(flag(wanted, "_w"), list(keys), "left").join(flag(children, "_c"), list(keys), "left")
    outcome = F.when(F.col("_w").isNull(), "kept").when(F.col("_c").isNotNull(), "refused").otherwise("deleted")
    return met.withColumn("outcome", outcome).drop("_w", "_c")


def cascade(relations: dict[str, DataFrame], gone: DataFrame, root: str, key: str, parents: dict[str, tuple[str, str]], own: dict[str, str]) -> dict[str, DataFrame]:
    """Survivors of every relation after the rows ``gone`` (by ``key``) of ``root`` went with all that hangs on them.

    ``parents``: relation -> (parent relation, column that both have); parents stand before what hangs on them. ``own``:
    the column by which a relation's rows are named. A relation's victims are found before any row is taken away.
    """
    victims = {root: relations[root].join(gone.select(key).distinct(), key, "left_semi")}
    for name, (parent, column) in parents.items():
        victims[name] = relations[name].join(victims[parent].select(column).distinct(), column, "left_semi")
    return {name: without(df, victims[name], [own[name]]) if name in victims else df for name, df in relations.items()}


def held_watermark(stored: DataFrame, work: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Watermarks raised only where all work was done (``done`` of ``work``), so that truncated work is met again."""
    seen = work.groupBy(*keys).agg(F.max(mark).alias("_m"), F.bool_and("done").alias("_d"))
    high = F.when(F.coalesce("_d", F.lit(False)), F.greatest(F.col(mark), F.col("_m"))).otherwise(F.col(mark))
    return stored.join(seen, list(keys), "left").select(*[high.alias(c) if c == mark else F.col(c) for c in stored.columns])


def recorded(deliveries: DataFrame, sends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deliveries (status, attempt_count) after sends (keys, result): the result's status, and one attempt more where it failed."""
    status = F.when(F.col("_r") == "retry", "failed").otherwise(F.coalesce("_r", "status"))
    got = sends.groupBy(*keys).agg(F.max("result").alias("_r"))
    return deliveries.join(got, list(keys), "left").withColumns({"status": status, "attempt_count": F.col("attempt_count") + F.coalesce(F.col("_r") != "delivered", F.lit(False)).cast("long")}).drop("_r")


def breaker_until(streak: Column, at: Column) -> Column:
    """Until when an origin is left alone after ``streak`` failures in a row, the last at ``at``; null if it is not."""
    return F.when(streak >= BREAKER_FAILURES, F.timestamp_seconds(F.unix_timestamp(at) + BREAKER_S))


def timers(monitors: DataFrame, commands: DataFrame) -> DataFrame:
    """monitor_id, status, alarm_at: each monitor's timer after its commands (monitor_id, seq, command, at, next_at).

    ``monitors``: monitor_id, status, next_run_at. A timer is set by schedule and checked (to ``next_at``, none if null), by resume (to the stored next run,
    else at once) and by deferred (to ``next_at``, in the same slot); pause and policy_stopped clear it. The last command counts, and of
    pause and resume the last one for the status. A monitor without commands waits for its stored next run unless it is paused.
    """
    state = F.max_by("command", F.when(F.col("command").isin("pause", "resume"), F.col("seq")))
    last = commands.groupBy("monitor_id").agg(F.max_by(F.struct("command", "at", "next_at"), F.col("seq")).alias("c"), state.alias("s"))
    met = monitors.join(last, "monitor_id", "left")
    alarm = (
        F.when(F.col("c").isNull(), F.when(F.col("status") != "paused", F.col("next_run_at")))
        .when(F.col("c.command") == "resume", F.coalesce("next_run_at", "c.at"))
        .when(F.col("c.command").isin("schedule", "checked", "deferred"), F.col("c.next_at"))
    )
    return met.select("monitor_id", F.when(F.col("s") == "pause", "paused").when(F.col("s") == "resume", "active").otherwise(F.col("status")).alias("status"), alarm.alias("alarm_at"))

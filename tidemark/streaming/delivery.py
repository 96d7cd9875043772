"""Deliveries: outcomes of sends, the state machine over attempts, and an idempotent stream into change and delivery tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.outcomes import permanent
from tidemark.operators.keyed import insert_if_new
from tidemark.streaming.ledger import exists

MOST_ATTEMPTS = 5


def result(status: Column, error: Column) -> Column:
    """delivered, retry or dead for one send."""
    return F.when(error.isNotNull() | status.isNull(), "retry").when(status.isin(200, 204), "delivered").when(permanent(status), "dead").otherwise("retry")


def settled(attempts: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """delivery_id, status, attempts: what each delivery comes to after its attempts (delivery_id, attempt_no from 1, result).

    The first attempt that ends it decides; without one it is dead after ``most`` attempts and failed (to be
    retried) before. Attempts after the end do not count. One aggregate, combined before the shuffle.
    """
    ends = F.min(F.when(F.col("result") != "retry", F.struct("attempt_no", "result")))
    made = F.max("attempt_no")
    out = attempts.filter(F.col("attempt_no") <= most).groupBy("delivery_id").agg(ends.alias("e"), made.alias("made"))
    status = F.when(F.col("e").isNotNull(), F.col("e.result")).when(F.col("made") >= most, "dead").otherwise("failed")
    return out.select("delivery_id", status.alias("status"), F.coalesce("e.attempt_no", "made").alias("attempts"))


def step(deliveries: DataFrame, messages: DataFrame, responses: DataFrame, now: str, most: int = MOST_ATTEMPTS, stale_s: int = 300) -> DataFrame:
    """``deliveries`` after one batch of messages, with ``reply`` (ack, retry; null without a message) and ``delay_s``.

    ``deliveries``: delivery_id, status, attempt_count, claimed_at, archived. ``messages``: delivery_id, repeats count once. ``responses``:
    delivery_id, status_code (null: no answer), retry_after_s. A message claims a delivery that is pending or failed, or whose
    claim is older than ``stale_s``; others are acknowledged and change nothing. A claimed one to an archived destination,
    or one with ``most`` attempts, is dead; else it is sent and its response settles it: delivered, dead after a
    permanent failure, or failed and to be retried, after the wait that a 429 asks for.
    """
    asked = messages.select("delivery_id").distinct().withColumn("_m", F.lit(True))
    answer = responses.groupBy("delivery_id").agg(F.max(F.struct("status_code", "retry_after_s")).alias("_a"))
    clock = F.lit(now).cast("timestamp")
    claim = F.col("_m") & (F.col("status").isin("pending", "failed") | ((F.col("status") == "sending") & (F.col("claimed_at") < F.timestamp_seconds(F.unix_timestamp(clock) - stale_s))))
    refused = F.col("archived") | (F.col("attempt_count") >= most)
    came = F.when(F.coalesce(claim, F.lit(False)), F.when(refused, "dead").otherwise(result(F.col("_a.status_code"), F.lit(None).cast("string"))))
    met = deliveries.join(asked, "delivery_id", "left").join(answer, "delivery_id", "left").withColumn("_r", came)
    retry = F.col("_r") == "retry"
    return met.select(
        "delivery_id",
        F.when(retry, "failed").otherwise(F.coalesce("_r", "status")).alias("status"),
        (F.col("attempt_count") + F.coalesce(F.col("_r") != "delivered", F.lit(False)).cast("long")).alias("attempt_count"),
        F.when(F.col("_r").isNotNull(), clock).otherwise(F.col("claimed_at")).alias("claimed_at"),
        "archived",
        F.when(F.col("_m").isNotNull(), F.when(retry, "retry").otherwise("ack")).alias("reply"),
        F.when(retry & (F.col("_a.status_code") == 429), F.col("_a.retry_after_s")).alias("delay_s"),
    )


def append_new(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """One micro-batch into the table at ``path``: keys already there are left out, so a replayed batch adds nothing."""
    stored = batch.sparkSession.read.schema(batch.schema).parquet(path).select(*keys) if exists(batch.sparkSession, path) else batch.limit(0)
    insert_if_new(batch, stored, keys, order).write.mode("append").parquet(path)


def write_stream(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """Starts the stream of changes into the table at ``path``; processes what is there and stops."""
    return (
        changes.writeStream.foreachBatch(lambda df, _: append_new(df, path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

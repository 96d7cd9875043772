"""Timers and lifetimes as streams: equal to the batch fold over the same log, across restarts, and forgotten in time."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import transitions
from tidemark.streaming import timers

LOG = "monitor_id long, seq long, command string, at long, next_at long, next_run_at long, ts timestamp"


def run(stream, out, state, **trigger):
    q = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(out)
    q.awaitTermination(240)
    assert q.exception() is None


def test_timers_as_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    stored = {m: rng.choice([None, 5000 + m]) for m in range(6)}
    rows, told = [], []
    for seq in range(90):
        m = rng.randrange(5)
        rows.append((m, seq, rng.choice(["schedule", "checked", "deferred", "pause", "resume", "policy_stopped"]), 100 + seq, rng.choice([None, 10_000 + seq]), stored[m], None))
    source = str(tmp_path / "in")
    for k in range(3):  # three micro-batches, the last two after a restart, some rows told again
        part = rows[30 * k : 30 * k + 30] + rows[30 * k - 5 : 30 * k] * (k > 0)
        spark.createDataFrame(part, LOG).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source).withWatermark("ts", "0 seconds")
        run(timers.monitor_timers(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    told = spark.read.parquet(str(tmp_path / "out"))
    assert told.filter("event = 'fired' and alarm_at > 190").isEmpty()  # only resumed monitors that were due at once
    last = told.filter("event = 'set'").groupBy("monitor_id").agg(F.max_by(F.struct("status", "alarm_at"), "seq").alias("x"))
    got = {r.monitor_id: (r.x.status, r.x.alarm_at) for r in last.collect()}
    monitors = spark.createDataFrame([(m, None, n) for m, n in stored.items()], "monitor_id long, status string, next_run_at long")
    want = {r.monitor_id: (r.status, r.alarm_at) for r in transitions.timers(monitors, spark.createDataFrame(rows, LOG).drop("next_run_at", "ts")).collect()}
    assert got == {m: w for m, w in want.items() if m in {r[0] for r in rows}}


def test_timers_fire_once_when_their_time_is_over(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in ([(1, 1, "schedule", 100, 200, None, None), (2, 2, "schedule", 100, 900, None, None), (3, 3, "schedule", 100, 150, None, None), (3, 4, "pause", 101, None, None, None)], [(9, 5, "pause", 500, None, None, None)], [(9, 6, "pause", 501, None, None, None)], [(9, 7, "pause", 502, None, None, None)]):
        spark.createDataFrame(part, LOG).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(source)
        run(timers.monitor_timers(spark.readStream.schema(LOG).parquet(source).withWatermark("ts", "0 seconds")), out, state)
    fired = spark.read.parquet(out).filter("event = 'fired'").select("monitor_id", "alarm_at").collect()
    assert [tuple(r) for r in fired] == [(1, 200)]


def test_entries_are_forgotten_after_their_life(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for wait, part in ((0, [(1, 1), (1, 2), (2, 3)]), (0, [(1, 4)]), (25, [(1, 5), (1, 6)])):
        time.sleep(wait)
        spark.createDataFrame(part, "origin long, seq long").coalesce(1).write.mode("append").parquet(source)
        run(timers.living_cache(spark.readStream.schema("origin long, seq long").parquet(source), 20_000), out, state, once=True)  # with processing time there is always another batch
    got = {r.seq: (r.from_cache, r.entry) for r in spark.read.parquet(out).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (False, 3), 4: (True, 1), 5: (False, 5), 6: (True, 5)}

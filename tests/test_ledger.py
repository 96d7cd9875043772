"""A batch's tables move together: broken off anywhere and replayed, they are as if nothing had happened; what is not touched is not read."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ledger

ROWS = [(i, i % 7, i % 2, "new", f"k{i % 11}", f"2024-01-01 00:{i:02d}:00") for i in range(60)]


def source(spark, path, k):
    df = spark.createDataFrame(ROWS[20 * k : 20 * k + 20], ledger.CHANGE.replace("timestamp", "string")).withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)


def matched(new):
    return new.select("change_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("destination_id"))


def state(book):
    return [sorted(map(tuple, book.read(n).collect())) for n in ("changes", "deliveries")] + [sorted(map(tuple, book.read("watermarks").groupBy("monitor_id").agg(F.max("mark")).collect()))]


def streamed(spark, tmp, stop=None):
    book = ledger.Ledger(spark, f"{tmp}/tables", ledger.TABLES, buckets=8)
    for k in range(3):
        source(spark, f"{tmp}/in", k)
        for attempt in range(2):
            def after(step, fail=k == 1 and attempt == 0):
                if fail and step == stop:
                    raise RuntimeError("broken off")

            stream = spark.readStream.schema(ledger.CHANGE).parquet(f"{tmp}/in")
            try:
                ledger.notify(stream, book, matched, "main", f"{tmp}/state", after).awaitTermination()
            except Exception:  # the replay begins where the checkpoint says
                assert stop and book.committed() == {"main": 0}
    return book


def test_any_break_leaves_equal_tables(spark, tmp_path):
    whole = state(streamed(spark, tmp_path / "whole"))
    assert len(whole[0]) == len({(r[1], r[4]) for r in ROWS}) and len(whole[1]) == 2 * len(whole[0])
    for stop in ("changes", "deliveries", "watermarks"):
        assert state(streamed(spark, tmp_path / stop, stop)) == whole


def test_a_second_stream_adds_nothing_and_reads_touched_buckets(spark, tmp_path):
    book = streamed(spark, tmp_path)
    before = state(book)
    again = spark.readStream.schema(ledger.CHANGE).parquet(f"{tmp_path}/in")
    ledger.notify(again, book, matched, "second", f"{tmp_path}/other").awaitTermination()
    assert state(book) == before and set(book.committed()) == {"main", "second"}
    plan = book.read("changes", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("name", list(ledger.TABLES))
def test_an_empty_ledger(spark, tmp_path, name):
    book = ledger.Ledger(spark, str(tmp_path), ledger.TABLES)
    assert book.committed() == {} and book.read(name).isEmpty()

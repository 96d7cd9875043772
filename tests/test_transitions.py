"""State transitions over small relations, with nulls, ties, repeated and missing keys."""

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import transitions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_updated_takes_the_last_change_and_ignores_unknown_keys(spark):
    stored = spark.createDataFrame([(1, "pending", None), (2, "pending", "a"), (3, "pending", "b")], "k int, status string, at string")
    changes = spark.createDataFrame([(1, 1, "running", "x"), (1, 2, "done", None), (2, 1, None, None), (9, 1, "done", "z")], "k int, n int, status string, at string")
    assert rows(transitions.updated(stored, changes, ["k"], ["n"])) == [(1, "done", None), (2, "pending", "a"), (3, "pending", "b")]
    assert rows(transitions.updated(stored, changes.limit(0), ["k"], ["n"])) == rows(stored)


def test_upsert_keeps_identity(spark):
    stored = spark.createDataFrame([(1, 10, "enforce")], "site int, id int, mode string")
    batch = spark.createDataFrame([(1, 20, "ignore"), (2, 21, "enforce"), (2, 22, "ignore")], "site int, id int, mode string")
    assert rows(transitions.upsert_keeping(stored, batch, ["site"], ["id"], ["id"])) == [(1, 10, "ignore"), (2, 22, "ignore")]


def test_replaced_swaps_whole_groups(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, x string")
    batch = spark.createDataFrame([("d", 1), ("d", 1), ("e", 3)], "x string, g int")
    once = transitions.replaced(stored, batch, ["g"])
    assert rows(once) == [(1, "d"), (1, "d"), (2, "c"), (3, "e")]
    assert rows(transitions.replaced(once, batch, ["g"])) == rows(once)


def test_guarded_delete_refuses_what_has_children(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    wanted, children = df.filter("k > 1"), spark.createDataFrame([(2,), (2,), (1,), (None,)], "k int")
    assert rows(transitions.guarded_delete(df, wanted, children, ["k"])) == [(1, "kept"), (2, "refused"), (3, "deleted"), (None, "kept")]


def test_watermark_waits_for_truncated_work_and_never_falls(spark):
    stored = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "k int, mark int")
    work = spark.createDataFrame([(1, 9, True), (1, 7, True), (2, 9, True), (2, 8, False), (3, 4, True), (7, 9, True)], "k int, mark int, done boolean")
    assert rows(transitions.held_watermark(stored, work, ["k"], "mark")) == [(1, 9), (2, 5), (3, 5), (4, 5)]


def test_recorded_counts_attempts(spark):
    d = spark.createDataFrame([(1, "sending", 0), (2, "sending", 4), (3, "pending", 1), (4, "sending", 2)], "k int, status string, attempt_count long")
    sends = spark.createDataFrame([(1, "delivered"), (2, "dead"), (4, "retry")], "k int, result string")
    assert rows(transitions.recorded(d, sends, ["k"])) == [(1, "delivered", 0), (2, "dead", 5), (3, "pending", 1), (4, "failed", 3)]


def test_breaker_opens_at_five(spark):
    df = spark.createDataFrame([(4,), (5,)], "n long").select("n", F.unix_timestamp(transitions.breaker_until(F.col("n"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("u"))
    start = spark.sql("SELECT unix_timestamp('2024-01-01 00:00:00')").first()[0]
    assert rows(df) == [(4, None), (5, start + 300)]


def test_fields_summary(spark):
    df = spark.sql("SELECT array(named_struct('name', 'a', 'value', '1'), named_struct('name', 'b', 'value', CAST(NULL AS string))) AS f")
    assert df.select(text.fields_summary(F.col("f"))).first()[0] == "a: 1\nb: "
    assert df.select(text.fields_summary(F.slice("f", 1, 0))).first()[0] is None

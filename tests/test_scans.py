"""Running values over segments against a walk row by row, a hot key in many segments, and joins with what came before."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans


def events(rng, n):
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(50)]), i, rng.random() < 0.4, rng.choice([None, 1, 2, -3])) for i in range(n)]


@pytest.mark.parametrize("segments", [1, 3, 16])
def test_running_values(spark, segments):
    data = events(random.Random(segments), 600)
    df = spark.createDataFrame(data, "k string, t int, i int, good boolean, v int").repartition(5)
    state, want = {}, {}
    for k, t, i, good, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n, total, top, last, streak = state.get(k, (0, 0, None, None, 0))
        top = v if top is None else top if v is None else max(top, v)
        state[k] = n + 1, total + (v or 0), top, last if v is None else v, 0 if good else streak + 1
        want[i] = n, total + (v or 0), top, state[k][3], state[k][4]
    found = scans.running(df, "k", ["t", "i"], {"total": F.col("v")}, {"top": F.col("v")}, {"last": F.col("v")}, segments)
    assert {r.i: (r.total, r.top, r["last"]) for r in found.collect()} == {i: w[1:4] for i, w in want.items()}
    assert {r.i: r.n for r in scans.numbered(df, "k", ["t", "i"], "n", segments).collect()} == {i: w[0] for i, w in want.items()}
    got = scans.streaks(df, "k", ["t", "i"], F.col("good"), segments)
    assert got.columns == [*df.columns, "streak"] and {r.i: r.streak for r in got.collect()} == {i: w[4] for i, w in want.items()}


def test_a_hot_key_is_never_read_by_one_task(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.col("id") % 1000 == 0).alias("good"))
    rows = scans.segmented(df, "k", ["t"], 16)
    sizes = [r["count"] for r in rows.groupBy("_segment").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 30_000
    assert scans.streaks(df, "k", ["t"], F.col("good"), 16).agg(F.max("streak"), F.sum("streak")).first()[:] == (999, 200 * 999 * 1000 // 2)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("segments", [1, 9])
def test_as_of(spark, exact, segments):
    rng = random.Random(segments)
    left = [(rng.choice(["hot", "hot", "a", "z", None]), rng.choice([None, *range(40)]), i) for i in range(300)]
    left += left[:5]
    right = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(40)]), rng.choice([None, "x", "y"])) for _ in range(80)]
    got = scans.as_of(spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, seen int, v string"), "k", "at", "seen", exact=exact, segments=segments)
    want = []
    for k, at, i in left:
        before = [(s, v is not None, v or "") for rk, s, v in right if None not in (k, at, s) and rk == k and (s <= at if exact else s < at)]
        want.append((k, at, i, max(before)[0] if before else None, (max(before)[2] or None) if before else None))
    assert sorted(((r.k, r.at, r.i, r.found and r.found.seen, r.found and r.found.v) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t int, good boolean")
    assert scans.streaks(df, "k", ["t"], F.col("good")).isEmpty() and scans.as_of(df, df.select("k", "t", F.lit(1).alias("v")), "k", "t", "t").isEmpty()

"""Pages by ranges against a plain sort, hot values, nulls, and what a page reads."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pagination


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_pages_equal_a_sort(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice([None, 5, 5, 5, *range(20)]), i) for i in range(700)]
    held = pagination.in_ranges(spark.createDataFrame(data, "t int, i int").repartition(5), [F.col("t").desc(), "i"], ranges)
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert held.total == 700
    for limit, offset in ((50, 0), (50, 333), (1, 699), (120, 640), (500, 100), (10, 700), (10, 5000)):
        assert [tuple(r) for r in held.page(limit, offset).collect()] == want[offset : offset + limit]
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            held.page(limit, offset)


def test_a_deep_page_reads_one_range(spark):
    df = spark.range(200_000).select((F.col("id") % 3 == 0).alias("hot"), F.xxhash64("id").alias("h"))
    held = pagination.in_ranges(df, ["hot", "h"], 20)
    assert max(b - a for a, b in zip(held.starts, held.starts[1:])) < 40_000
    inside = held.starts[13] + 100
    page = held.page(50, inside)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan
    assert [r.h for r in page.collect()] == [r.h for r in df.orderBy("hot", "h").offset(inside).limit(50).collect()]


def test_empty(spark):
    held = pagination.in_ranges(spark.createDataFrame([], "t int, _x string"), ["t"])
    assert held.total == 0 and held.page().isEmpty() and held.page().columns == ["t", "_x"]

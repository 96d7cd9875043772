"""Every registered query against its SQL on the smallest tables, in both engines."""

import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def canon(v):
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = sorted(tuple(canon(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert rows
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows == sorted(tuple(canon(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())

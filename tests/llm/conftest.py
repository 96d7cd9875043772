import os
from decimal import Decimal

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """A table of the smallest test data."""
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def documents(spark, rows, extra=()):
    """A documents table of (doc_id, text[, source[, lang]]) rows."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


def canon(v):
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else f"{v:.9g}" if isinstance(v, float | Decimal) else str(v)


@pytest.fixture(scope="session")
def canonical():
    """Rows as comparable tuples, columns by name."""
    return lambda names, rows: sorted(tuple(canon(r[i]) for i in sorted(range(len(names)), key=lambda k: names[k])) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con

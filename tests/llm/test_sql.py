"""Every corpus query with SQL against that SQL on the smallest tables."""

import pytest

from tests.llm.conftest import SF
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, canonical, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(names, want.fetchall())

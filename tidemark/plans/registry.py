"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import check, composites, content, feeds, notify, policies, relational, served, stages, states

GROUPS = (content, relational, policies, feeds, notify, check, states, composites, stages, served)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for g in GROUPS for name, (f, _) in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}

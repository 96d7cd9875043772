"""Keyed tables without constraints: first row wins, insert if new, upsert, watermarks, cascades.

Groups are combined before they are shuffled (an aggregate over a struct, never a window over whole
groups), so one key with a third of all rows costs each task one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``. Rows whose keys are null form a group of their own."""
    rank = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def insert_if_new(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The batch's rows whose key is not stored, one per key: append these. Running it again adds nothing."""
    return first_wins(batch, keys, order).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def with_existing(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str], id_col: str) -> DataFrame:
    """One row per key of the batch: ``inserted``, and ``id_col`` of the stored row where there is one."""
    one = first_wins(batch, keys, order)
    old = first_wins(stored.select(*keys, F.col(id_col).alias("_old")), keys, ["_old"])
    joined = one.join(old, list(keys), "left")
    return joined.withColumns({"inserted": F.col("_old").isNull(), id_col: F.coalesce("_old", id_col)}).drop("_old")


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``stored`` with the batch's values where they are not null; new keys are added. One row per key of ``batch`` counts, the last."""
    new = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in keys]), F.struct(*order)).alias("_n"))
    joined = stored.withColumn("_s", F.lit(True)).join(new, list(keys), "full")
    return joined.select(*[F.col(c) if c in keys else F.coalesce(F.col(f"_n.{c}"), F.col(c)).alias(c) for c in stored.columns])


def advance_watermark(stored: DataFrame, seen: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """``stored`` with ``mark`` raised to the largest seen; it never falls, nulls change nothing."""
    high = seen.groupBy(*keys).agg(F.max(mark).alias("_m"))
    return stored.join(high, list(keys), "left").select(*[F.greatest(F.col(mark), F.col("_m")).alias(c) if c == mark else F.col(c) for c in stored.columns])


def without(df: DataFrame, victims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Survivors of a delete."""
    return df.join(victims.select(*keys).distinct(), list(keys), "left_anti")


def put_if_absent(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed rows (key, body) not stored yet, one per key."""
    return blobs.groupBy("key").agg(F.any_value("body").alias("body")).join(stored.select("key"), "key", "left_anti")


def read_blobs(rows: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``body``: the blob (key, body) that ``key`` names, empty where there is none."""
    found = blobs.select(F.col("key").alias("_k"), F.col("body").alias("_b"))
    return rows.join(found, F.col(key) == F.col("_k"), "left").withColumn("body", F.coalesce("_b", F.lit(""))).drop("_k", "_b")

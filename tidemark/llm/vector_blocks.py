"""A stated query set against all rows, in blocks: rows are dealt to blocks of bounded bytes, queries stream past them.

A block is one row and is sent once to each of the tasks that search it; behind it come the queries, row by row, so a task holds
one block and one Arrow batch of queries. What is exchanged is every row once, and every query once per block; blocks are as
large as a task can hold, which keeps that number small. Where there are fewer blocks than cores, each block is held in several
copies ("slots") and every query meets one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Scaled components saturate here, so that products of vectors of up to 2^11 dimensions are exact in 64 bits.
MOST = 1 << 26
BLOCK_BYTES = 8 << 20
MOST_TASKS = 20_000


def usable(v: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component, held within +-2^26."""
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(MOST)), F.lit(-MOST))
    return F.transform(v, lambda x: F.when(F.abs(x.cast("double")) >= MOST / scale, F.when(x > 0, MOST).otherwise(-MOST)).otherwise(held(x)).cast("int"))


def numbered(df: DataFrame, id_col: str, vec_col: str, scale: int, **more: Column) -> DataFrame:
    """rid, id, v and ``more`` of the usable rows that have an id, written once so that row numbers stand."""
    rows = df.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"), *[c.alias(k) for k, c in more.items()]))


def matrix(lists: pa.Array, dims: int = 0) -> np.ndarray:
    """Integer vectors, one row each, shorter ones padded with zeros."""
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(dims, int(size.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def shape(rows: DataFrame, block: int | None) -> tuple[int, int, int]:
    """Number of rows, longest vector, number of blocks."""
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return n, dims or 0, max(1, -(-n // (block or max(1024, BLOCK_BYTES // max(1, 4 * (dims or 0))))))


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """cb, rows: the rows dealt at random to ``blocks`` blocks, one record each."""
    return rows.groupBy(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("cb")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))


def meet(blocks: DataFrame, asked: DataFrame, n_blocks: int, opened: Callable, search: Callable, schema: str) -> DataFrame:
    """Every row of ``asked`` (rid, ..., cbs: an array of block numbers) with the blocks (cb, ...) it names.

    ``opened`` makes what ``search`` needs out of a block's record batch of one row; ``search`` gets that and a batch of queries, and yields batches of ``schema``.
    """
    slots = max(1, 3 * blocks.sparkSession.sparkContext.defaultParallelism // n_blocks)
    tasks = min(MOST_TASKS, n_blocks * slots)
    held, query = [c for c in blocks.columns if c != "cb"], [c for c in asked.columns if c != "cbs"]
    left = blocks.select("cb", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("kind"), F.struct(*held).alias("b"))
    right = asked.select(F.explode(F.col("cbs").cast("array<long>")).alias("cb"), F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("kind"), F.struct(*query).alias("q"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("task", F.pmod(F.col("cb") * slots + F.col("slot"), F.lit(tasks)).cast("int"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            starts = [*np.flatnonzero(kinds == 0).tolist(), len(kinds)]
            if state is not None and starts[0]:
                yield from search(state, pa.RecordBatch.from_struct_array(batch.column("q").slice(0, starts[0])))
            for at, end in zip(starts, starts[1:], strict=False):
                state = opened(pa.RecordBatch.from_struct_array(batch.column("b").slice(at, 1)))
                if end > at + 1:
                    yield from search(state, pa.RecordBatch.from_struct_array(batch.column("q").slice(at + 1, end - at - 1)))

    return both.repartitionById(tasks, F.col("task")).sortWithinPartitions("cb", "slot", "kind").select("kind", "b", "q").mapInArrow(walk, schema)

"""Exact top-k inner product search: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt at random to blocks of bounded size and queries stream past them, each row once past every block. A task sorts a candidate block along each dimension once, then walks
all lists of a query in step: vectors met for the first time are scored in full, and the walk ends
when the sum of the lists' current values, the best any unseen vector can reach, falls below the
kth score. The first block is searched for all queries ahead of the others, and each query takes the kth score
it found there along as its floor, so no later block is walked further than that score allows. The
blocks' answers, k rows each at most, are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.vector_blocks import dealt, matrix, meet, numbered, shape

FOUND = "rid long, query_id long, vec_id long, score long"


def threshold_search(query: np.ndarray, seen: np.ndarray, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int, step: int, floor: int | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of a block's rows that are not ``seen`` yet, without some below ``floor``; ``order`` sorts each dimension ascending."""
    n = len(ids)
    dims = np.flatnonzero(query)
    down = query[dims] > 0
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = 0
    while depth < n:
        to = min(n, depth + step)
        if not len(dims):
            new, to = np.flatnonzero(~seen), n
        else:
            hit = np.zeros(n, bool)
            hit[order[depth:to, dims[~down]]] = True
            hit[order[n - to : n - depth, dims[down]]] = True
            new = np.flatnonzero(hit & ~seen)
        seen[new] = True
        best_ids, best = np.r_[best_ids, ids[new]], np.r_[best, vectors[new] @ query]
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
        depth, step = to, step * 2
        least = [int(best[-1])] * (len(best) == k) + [floor] * (floor is not None)
        if depth < n and least:
            at = np.where(down, order[n - depth, dims], order[depth - 1, dims])
            if int((query[dims] * vectors[at, dims]).sum()) < max(least):  # an equal bound may still hide a smaller id
                break
    return list(zip(best.tolist(), best_ids.tolist(), strict=True))


def opened(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, vectors and, for each dimension, the order of its values."""
    rows = block.column("rows")[0].values
    vectors = matrix(rows.field("v"))
    return rows.field("rid").to_numpy(), rows.field("id").to_numpy(), vectors, np.argsort(vectors, axis=0, kind="stable")


def searched(state: tuple, queries: pa.RecordBatch, k: int, step: int) -> Iterator[pa.RecordBatch]:
    rids, ids, vectors, order = state
    asked = matrix(queries.column("v"), vectors.shape[1])
    if asked.shape[1] > vectors.shape[1]:
        vectors = np.pad(vectors, ((0, 0), (0, asked.shape[1] - vectors.shape[1])))
        order = np.argsort(vectors, axis=0, kind="stable")
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).sum(1).max(initial=0)) < 2.0**53:  # products and sums are whole numbers a double holds
        vectors, asked = vectors.astype(np.float64), asked.astype(np.float64)
    rows = zip(queries.column("rid").to_pylist(), queries.column("id").to_pylist(), queries.column("floor").to_pylist(), asked, strict=True)
    out = [(rid, q, i, int(s)) for rid, q, floor, v in rows for s, i in threshold_search(v, rids == rid, ids, vectors, order, k, step, floor)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], names=["rid", "query_id", "vec_id", "score"])


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block: int | None = None, step: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, each row for itself: of rows that repeat an id every one is a query, and a candidate of
    the others. Rows with a null id, a null vector or one with null or non-finite components take no part. With
    fewer than k candidates all are returned, an empty table gives an empty result. Vectors of unequal length are compared
    as if padded with zeros; scaled components are held within +-2^26. ``block``: rows of a block, by default what 8 MB hold.
    """
    rows = numbered(df, id_col, vec_col, scale)
    _, _, n_blocks = shape(rows, block)
    blocks = dealt(rows, n_blocks)
    queries = rows.filter(F.col("id") % every == 0)
    look = lambda some, asked: meet(some, asked, n_blocks, opened, lambda s, q: searched(s, q, k, step), FOUND)

    found = cut(look(blocks.filter("cb = 0"), queries.select("*", F.lit(None).cast("long").alias("floor"), F.array(F.lit(0)).alias("cbs"))))
    if n_blocks > 1:
        kth = F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k))  # a query has k rows at most
        floors = found.groupBy("rid").agg(kth.alias("floor"))
        asked = queries.join(floors, "rid", "left").select("rid", "id", "v", "floor", F.sequence(F.lit(1), F.lit(n_blocks - 1)).alias("cbs"))
        found = found.unionByName(look(blocks.filter("cb > 0"), asked))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH u AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

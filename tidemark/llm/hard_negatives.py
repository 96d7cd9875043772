"""Hard negatives by product quantisation with stored residual norms.

Rows are coded part by part with the nearest entries of codebooks fitted on a bounded sample; beside its code a row keeps the length of
each part's residual. For an anchor, a table of products with all entries gives a row's score by look-ups, and by
Cauchy-Schwarz the true score lies within the sum over parts of the anchor's part length times the residual's. These bounds are
rigorous, so rows they rule out need no look; the others are scored exactly, in integers. A first pass finds
each anchor's positives, a second one fills the window below each positive's score. The codebooks decide how much is ruled out,
never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, written
from tidemark.llm.vector_blocks import dealt, matrix, meet, numbered, shape

BLOCK = "cb long, rids array<long>, ids array<long>, labels array<long>, vectors array<int>, codes binary, residuals array<double>"
FOUND = "rid long, id long, other long, score long"
FIRST = 32
WITHIN = "rid long, id long, place int, positive_id long, positive_score long, other long, score long"


def fitted(sample: np.ndarray, parts: int, entries: int, rounds: int = 10) -> np.ndarray:
    """Codebooks (parts x entries x width) by plain Lloyd rounds; entries without rows stay where they are."""
    w = sample.shape[1] // parts
    books = np.zeros((parts, max(1, min(entries, len(sample))), w))
    for p in range(parts):
        rows = sample[:, p * w : (p + 1) * w].astype(np.float64)
        books[p] = rows[: books.shape[1]] if len(rows) else 0
        for _ in range(rounds):
            own = nearest(rows, books[p])
            n = np.bincount(own, minlength=len(books[p]))
            sums = np.zeros_like(books[p])
            np.add.at(sums, own, rows)
            books[p][n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)


def coded_blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks with codes and residual lengths, their rows ordered by label so that a label is a slice."""
    parts, _, w = books.shape
    for batch in batches:
        for cb, cell in zip(batch.column("cb").to_pylist(), batch.column("rows"), strict=True):
            rows = cell.values
            rows = rows.take(pa.array(np.argsort(rows.field("label").to_numpy(), kind="stable")))
            vectors = matrix(rows.field("v"), parts * w)
            codes, residuals = np.zeros((len(vectors), parts), np.uint8), np.zeros((len(vectors), parts))
            for p in range(parts):
                part = vectors[:, p * w : (p + 1) * w].astype(np.float64)
                codes[:, p] = own = nearest(part, books[p])
                residuals[:, p] = np.sqrt(((part - books[p][own]) ** 2).sum(axis=1)) * (1 + 1e-9)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
            cells = {"cb": pa.array([cb], pa.int64()), "rids": one(rows.field("rid"), pa.int64()), "ids": one(rows.field("id"), pa.int64()), "labels": one(rows.field("label"), pa.int64()), "vectors": one(vectors.ravel(), pa.int32())}
            cells |= {"codes": pa.array([codes.tobytes()], pa.binary()), "residuals": one(residuals.ravel(), pa.float64())}
            yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


class Block:
    """A block's rows, and bounds on their products with an anchor."""

    def __init__(self, cells: pa.RecordBatch, books: np.ndarray):
        cell = lambda name: cells.column(name)[0].values.to_numpy()
        self.books, (parts, _, w) = books, books.shape
        self.rids, self.ids, self.labels = cell("rids"), cell("ids"), cell("labels")
        self.vectors = cell("vectors").astype(np.int64).reshape(len(self.ids), parts * w)
        self.codes = np.ascontiguousarray(np.frombuffer(cells.column("codes")[0].as_py(), np.uint8).reshape(len(self.ids), parts).T)
        self.residuals = cell("residuals").reshape(len(self.ids), parts)
        self.lengths = np.sqrt((books**2).sum(axis=2)).max(axis=1)
        self.doubles, self.largest = self.vectors.astype(np.float64), float(np.abs(self.vectors).max(initial=0))

    def alike(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def bounds(self, query: np.ndarray, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that each of ``rows`` can have, in doubles."""
        cut_up = query.reshape(len(self.books), -1).astype(np.float64)
        table = np.einsum("pkw,pw->pk", self.books, cut_up)
        length = np.sqrt((cut_up**2).sum(axis=1))
        middle = sum(table[p][self.codes[p][rows]] for p in range(len(self.books)))
        width = self.residuals[rows] @ length + 1e-9 * (length @ self.lengths + 1)
        return middle - width, middle + width

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of the rows ``at``: in doubles where all sums are whole numbers a double holds."""
        if self.largest * float(np.abs(query).sum()) < 2.0**53:
            return (self.doubles[at] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[at] @ query


def positives(block: Block, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each anchor's label, but for its own row."""
    out = []
    asked = matrix(queries.column("v"), block.vectors.shape[1])
    for rid, own, label, query in zip(queries.column("rid").to_pylist(), queries.column("id").to_pylist(), queries.column("label").to_pylist(), asked, strict=True):
        a, b = block.alike(label)
        low, high = block.bounds(query, slice(a, b))
        other = block.rids[a:b] != rid
        sure = low[other]
        least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
        at = a + np.flatnonzero(other & (high >= least))
        score = block.scores(query, at)
        out += [(rid, own, int(block.ids[at[i]]), int(score[i])) for i in np.lexsort((block.ids[at], -score))[:k]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], names=["rid", "id", "other", "score"])


def negatives(block: Block, queries: pa.RecordBatch, k: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of other labels in the window below each positive's score."""
    out = []
    asked = matrix(queries.column("v"), block.vectors.shape[1])
    for rid, own, label, query, found in zip(queries.column("rid").to_pylist(), queries.column("id").to_pylist(), queries.column("label").to_pylist(), asked, queries.column("positives").to_pylist(), strict=True):
        a, b = block.alike(label)
        low, high = block.bounds(query, slice(None))
        low[a:b] = np.inf  # rows of the anchor's label are in no window
        exact, known = np.zeros(len(low), np.int64), np.zeros(len(low), bool)

        def inside(at: np.ndarray, bottom: int, top: int) -> np.ndarray:
            """The k best of ``at`` in the window; what was scored for an earlier window is not scored again."""
            new = at[~known[at]]
            exact[new], known[new] = block.scores(query, new), True
            at = at[(exact[at] >= bottom) & (exact[at] <= top)]
            return at[np.lexsort((block.ids[at], -exact[at]))[:k]]

        for place, positive, score in ((x["place"], x["id"], x["score"]) for x in found):
            bottom, top = -(-least * score // 100), most * score // 100
            if bottom > top:
                continue
            at = np.flatnonzero((high >= bottom) & (low <= top))
            if len(at) > FIRST:  # the likeliest rows first: the kth of them bounds the others
                middle = low[at] + high[at]
                likely = np.argpartition(np.where(middle <= 2 * top, -middle, np.inf), FIRST)[:FIRST]
                best = inside(at[likely], bottom, top)
                at = at[high[at] >= exact[best[-1]]] if len(best) == k else at
            out += [(rid, own, place, positive, score, int(block.ids[i]), int(exact[i])) for i in inside(at, bottom, top)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=["rid", "id", "place", "positive_id", "positive_score", "other", "score"])


def relabelled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """The contract's wrong labels: those of ids divisible by 7 move on by one of ten."""
    return df.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)))


def mine(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 50, scale: int = 256,
    n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95, parts: int = 8, entries: int = 64, sample: int = 4096, block: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; their positives the ``n_positives`` best other rows of the same label; for each
    positive the ``n_negatives`` best rows of other labels follow whose score is ``least`` to ``most`` percent of the positive's. Scores
    are inner products of floor(scale * x), held within +-2^26, ties go to the smaller id. Rows with a null id or label, a null vector
    or null or non-finite components take no part. Rows that repeat an id are rows of their own: each is an anchor, and a
    positive or negative of the others. Positives with a negative score have no window, those with 0 a window of 0 alone. Shorter vectors end
    in zeros; empty tables, and tables of one label, give no rows. ``sample``: rows, by hash, on which the codebooks are fitted.
    """
    label = F.col(label_col).cast("long")
    rows = numbered(df.filter(label.isNotNull()), id_col, vec_col, scale, label=label)
    _, dims, n_blocks = shape(rows, block)
    seen = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(sample).select("v").toArrow().column("v").combine_chunks()
    books = fitted(matrix(seen, -(-max(dims, 1) // parts) * parts), parts, entries)
    blocks = written(dealt(rows, n_blocks).mapInArrow(lambda it: coded_blocks(it, books), BLOCK), 16)[0]
    everywhere = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    anchors = rows.filter(F.col("id") % every == 0)

    near = meet(blocks, anchors.withColumn("cbs", everywhere), n_blocks, lambda b: Block(b, books), lambda b, q: positives(b, q, n_positives), FOUND)
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "other"))
    near = near.withColumn("place", place).filter(F.col("place") <= n_positives)
    wanted = near.groupBy("rid").agg(F.collect_list(F.struct("place", F.col("other").alias("id"), "score")).alias("positives"))  # n_positives each
    asked = cut(anchors.join(wanted, "rid")).withColumn("cbs", everywhere)
    found = meet(blocks, asked, n_blocks, lambda b: Block(b, books), lambda b, q: negatives(b, q, n_negatives, least, most), WITHIN)
    rank = F.row_number().over(Window.partitionBy("rid", "place").orderBy(F.col("score").desc(), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH u AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM u a JOIN u c ON a.vec_id % 50 = 0 AND a.rid <> c.rid),
p AS MATERIALIZED (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.rid, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (rid, anchor_id) WHERE place <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

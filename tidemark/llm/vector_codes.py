"""Vector code compression: product codebooks by exact Lloyd rounds with partition-local heaps.

Vectors are gathered as they are scanned into blocks of bounded size and written once; no round shuffles a vector. A block holds,
for every part position and codebook entry, a heap of its parts keyed by their slack: the distance to
the second nearest entry less the distance to their own. When entries move, an entry's cumulative drift (its own way and the
longest way of any other) grows by one number; a part whose key is above the drift cannot have changed its entry and stays in the
heap untouched. Parts whose key the drift has passed are popped, measured exactly, in integers, against all entries, and pushed
onto the heap of the entry they now belong to. Blocks report how sums and counts change, Spark adds these up
over all blocks, and what comes to the driver is as large as the codebooks, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dropped, written
from tidemark.llm.vector_blocks import usable

#: Scaled components beyond this saturate, so that squared distances of vectors of up to 2^12 dimensions are exact in 64 bits.
MOST = 1 << 24
STATE = "ids array<long>, labels array<int>, vectors array<int>, codes binary, sizes array<int>, members array<int>, keys array<double>, moved array<long>"


def scaled(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """Integer vectors, one row each, shorter ones padded with zeros."""
    lists = lists.cast(pa.list_(pa.float64()))
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(flat * scale), -MOST, MOST)
    return out


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of ``parts`` (n x w) from the entries of ``book`` (k x w), exact."""
    out = np.zeros((len(parts), len(book)), np.int64)
    for d in range(parts.shape[1]):
        out += (parts[:, d, None] - book[None, :, d]) ** 2
    return out


def slack(distances: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance to the second nearest entry less that to the own one, a little low for rounding; infinite for a single entry."""
    if distances.shape[1] < 2:
        return np.full(len(distances), np.inf)
    other = distances.astype(np.float64)
    nearest = np.sqrt(other[np.arange(len(own)), own])
    other[np.arange(len(own)), own] = np.inf
    second = np.sqrt(other.min(axis=1))
    return second - nearest - 1e-9 * (second + nearest + 1)


class Heaps:
    """A block's heaps, one for each part position and entry; only those that are changed leave their arrays."""

    def __init__(self, sizes: np.ndarray, members: np.ndarray, keys: np.ndarray):
        self.ends = np.cumsum(sizes)
        self.members, self.keys, self.open = members, keys, {}

    def top(self, h: int) -> float:
        at = self.ends[h - 1] if h else 0
        return float(self.keys[at]) if at < self.ends[h] else float("inf")

    def heap(self, h: int) -> list[tuple[float, int]]:
        if h not in self.open:
            at = self.ends[h - 1] if h else 0
            self.open[h] = list(zip(self.keys[at : self.ends[h]].tolist(), self.members[at : self.ends[h]].tolist(), strict=True))
        return self.open[h]

    def violated(self, h: int, drift: float) -> list[int]:
        """Parts popped because their key is not above ``drift``."""
        out = []
        if h in self.open or self.top(h) <= drift:
            heap = self.heap(h)
            while heap and heap[0][0] <= drift:
                out.append(heapq.heappop(heap)[1])
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, members, keys, at = [], [], [], 0
        for h, end in enumerate(self.ends):
            k, m = (self.keys[at:end], self.members[at:end]) if h not in self.open else (np.array([x for x, _ in self.open[h]]), np.array([i for _, i in self.open[h]], np.int32))
            sizes.append(len(k)), keys.append(k), members.append(m)
            at = end
        return np.array(sizes, np.int32), np.concatenate(members).astype(np.int32), np.concatenate(keys).astype(np.float64)


def block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray, codes: np.ndarray, heaps: tuple[np.ndarray, np.ndarray, np.ndarray], moved: np.ndarray) -> pa.RecordBatch:
    """One row that holds a block."""
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
    sizes, members, keys = heaps
    cells = {"ids": one(ids, pa.int64()), "labels": one(labels, pa.int32()), "vectors": one(vectors.ravel(), pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary())}
    cells |= {"sizes": one(sizes, pa.int32()), "members": one(members, pa.int32()), "keys": one(keys, pa.float64()), "moved": one(moved.ravel(), pa.int64())}
    return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


def first_blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray, rows: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, label, vector) rows after the first assignment, their heaps filled."""
    n_parts, k, w = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            vectors = scaled(piece.column(2), n_parts * w, scale)
            codes = np.zeros((len(vectors), n_parts), np.uint8)
            sizes, members, keys, moved = [], [], [], np.zeros((n_parts, k, w + 1), np.int64)
            for p in range(n_parts):
                parts = vectors[:, p * w : (p + 1) * w]
                found = squared(parts, books[p])
                codes[:, p] = own = found.argmin(axis=1)  # the first of equals
                key = slack(found, own)
                order = np.lexsort((key, own))  # each entry's parts by key: a sorted list is a heap
                sizes.append(np.bincount(own, minlength=k)), members.append(order), keys.append(key[order])
                np.add.at(moved[p, :, :w], own, parts)
                moved[p, :, w] = sizes[-1]
            yield block(piece.column(0), piece.column(1), vectors, codes, (np.concatenate(sizes), np.concatenate(members), np.concatenate(keys)), moved)


def opened(batch: pa.RecordBatch, i: int, n_parts: int, w: int):
    """Ids, labels, vectors and codes of one block."""
    cell = lambda name: batch.column(name)[i].values
    ids, labels = cell("ids"), cell("labels")
    return ids, labels, cell("vectors").to_numpy().astype(np.int64).reshape(len(ids), n_parts * w), np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(ids), n_parts).copy()


def next_blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks after entries moved to ``books``; ``drift`` (part x entry) is cumulative, in the units of the heaps' keys."""
    n_parts, k, w = books.shape
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, vectors, codes = opened(batch, i, n_parts, w)
            heaps = Heaps(*[batch.column(c)[i].values.to_numpy() for c in ("sizes", "members", "keys")])
            moved = np.zeros((n_parts, k, w + 1), np.int64)
            for p in range(n_parts):
                again = np.array(sorted(m for e in range(k) for m in heaps.violated(p * k + e, drift[p, e])), np.int64)
                if not len(again):
                    continue
                parts, old = vectors[again, p * w : (p + 1) * w], codes[again, p].copy()
                found = squared(parts, books[p])
                own = found.argmin(axis=1)
                codes[again, p] = own
                for member, entry, key in zip(again.tolist(), own.tolist(), (slack(found, own) + drift[p, own]).tolist(), strict=True):
                    heapq.heappush(heaps.heap(p * k + entry), (key, member))
                rows = np.c_[parts, np.ones(len(again), np.int64)]
                went = own != old
                np.add.at(moved[p], own[went], rows[went])
                np.subtract.at(moved[p], old[went], rows[went])
            yield block(ids, labels, vectors, codes, heaps.arrays(), moved)


def coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code, error of every row."""
    n_parts, _, w = books.shape
    digits = np.array([f"{e:02x}" for e in range(256)])
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, vectors, codes = opened(batch, i, n_parts, w)
            error = sum(((vectors[:, p * w : (p + 1) * w] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(n_parts))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(["".join(r) for r in digits[codes].tolist()], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, rows: int = 4096) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every usable row: two hex digits per part, and the squared distance to what they stand for.

    Rows whose vector is null or holds null or non-finite components are left out. Components become floor(scale * x), held within
    +-2^24; a vector is cut into ``parts`` equal parts, and shorter ones (or a length that ``parts`` does not divide) end in
    zeros. Codebooks start at the ``entries`` rows of smallest id, nulls last, rows of one id in the order of their vectors; with fewer rows
    they have fewer entries. Each round assigns every part to its nearest entry, the first of equals, and moves entries to the floor of their parts'
    mean; entries without parts stay. Repeated rows are coded each, empty tables give no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    good = df.filter(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).alias("v"))
    w = -(-(good.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    start = [r.v for r in good.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]  # a codebook's entries
    if not start:
        return good.select(F.col("id").alias("vec_id"), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    first = scaled(pa.array(start, pa.list_(pa.float64())), parts * w, scale)
    books = np.stack([first[:, p * w : (p + 1) * w] for p in range(parts)])
    k = books.shape[1]
    spark = df.sparkSession
    state, path = written(good.mapInArrow(lambda it, b=books: first_blocks(it, b, rows, scale), STATE), 16)
    totals = np.zeros((parts, k, w + 1), dtype=object)
    drift = np.zeros((parts, k))
    for _ in range(rounds):
        change = state.select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).filter("x <> 0").collect()  # as many as the codebooks have numbers
        for r in change:
            totals[np.unravel_index(r["at"], totals.shape)] += int(r["x"])
        old, books = books, books.copy()
        for p in range(parts):
            for e in range(k):
                if totals[p, e, w]:
                    books[p, e] = [int(x) // int(totals[p, e, w]) for x in totals[p, e, :w]]
            way = np.sqrt(((books[p] - old[p]) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
            for e in range(k):
                drift[p, e] += way[e] + max(np.delete(way, e), default=0.0)
        done = path
        state, path = written(state.mapInArrow(lambda it, b=books, d=drift.copy(): next_blocks(it, b, d), STATE), 16)
        dropped(spark, done)
    sha = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    return state.mapInArrow(lambda it, b=books: coded(it, b), "vec_id long, label int, code string, error long").withColumn("codebooks_sha256", F.lit(sha))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the errors of a label's rows added up; rows without a label count together (null beyond 64 bits).

    Sums are combined before they are shuffled and joined back, so that Spark can split a label that holds most rows.
    """
    known = cut(codes)
    sums = known.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    return known.join(sums, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, a common table per assignment and per move."""
    floored = "(s - (((s % n) + n) % n)) // n"
    sql = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM s WHERE rid <= {entries})"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT rid, p, k % 256 AS e, k // 256 AS d FROM (SELECT s.rid, s.p, min(256 * CAST(list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(x, c)]) AS BIGINT) + e) AS k FROM s JOIN b{r} b ON b.p = s.p GROUP BY s.rid, s.p))"""
        if r < rounds:
            sql += f""",
m{r} AS (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{r} JOIN s USING (rid, p)) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list(CAST({floored} AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY ALL) m ON m.p = b.p AND m.e = b.e)"""
    return sql + f""",
o AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (rid), h"""

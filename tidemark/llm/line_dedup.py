"""Line dedup: range-partitioned line hashes, streamed once, answered with per-document bitmaps.

Lines of at least ``min_chars`` code points become 128-bit hashes. Occurrences are ranged by (hash,
document descending) and sorted within partitions by (hash, document descending, position), so the first
occurrence met is the one that stays and a line held by a third of all documents is spread over
many partitions. One pass over each partition decides every hash that lies inside it; only
a partition's first and last hash can continue next door, and their counts (two rows a
partition at most) are summed afterwards. What comes back is not text but, for each
document, a sparse bitmap of dropped lines (64 lines a word, empty words left out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.common import SPACE, ascii_lower, cut, text_or_empty, unwrapped, wrapped

NO_ID = -(2**63)  # stands for a null doc_id: smaller than any other
COLS = ["h1", "h2", "did", "th", "pos"]
SCHEMA = "kind int, h1 long, h2 long, did long, th long, pos long, n long"
DROP, PENDING, SUMMARY = 0, 1, 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did and th name a row: its id and a hash of its text, so equal rows share a bitmap."""
    t = text_or_empty(F.col(text_col))
    return df.withColumns({"_did": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_th": F.xxhash64(t)})


def occurrences(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = keyed(df, id_col, text_col).select("_did", "_th", F.posexplode(lines_of(text_or_empty(F.col(text_col)))).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(SPACE))).filter(F.length("key") >= min_chars)
    key = ascii_lower(F.col("key"))
    return lines.select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), F.col("_did").alias("did"), F.col("_th").alias("th"), F.col("pos").cast("long")
    )


class Stream:
    """One partition's state: the run of equal hashes that is still open, and what has been decided."""

    def __init__(self, min_docs: int) -> None:
        self.min_docs = min_docs
        self.key: tuple[int, int] | None = None
        self.first = True
        self.n, self.keeper, self.last = 0, 0, 0
        self.held: list[np.ndarray] = []
        self.out: list[np.ndarray] = []

    def emit(self, kind: int, rows: np.ndarray, n: int = 0) -> None:
        if rows.shape[1]:
            self.out.append(np.vstack([np.full((1, rows.shape[1]), kind), rows, np.full((1, rows.shape[1]), n)]))

    def open_run(self, rows: np.ndarray) -> None:
        self.key, self.n, self.keeper, self.held = (int(rows[0, 0]), int(rows[1, 0])), 0, int(rows[2, 0]), []
        self.extend(rows)

    def extend(self, rows: np.ndarray) -> None:
        docs = rows[2]
        self.n += int((docs[1:] != docs[:-1]).sum()) + int(self.n == 0 or docs[0] != self.last)
        self.last = int(docs[-1])
        if self.first:
            self.emit(PENDING, rows)
        elif self.n < self.min_docs:
            self.held.append(rows)
        else:
            for x in [*self.held, rows]:
                self.emit(DROP, x[:, x[2] != self.keeper])
            self.held = []

    def close(self, ends: bool) -> None:
        if self.key is None:
            return
        if ends:
            for x in self.held:
                self.emit(PENDING, x)
        if ends or self.first:
            self.emit(SUMMARY, np.array([[*self.key, self.keeper, 0, 0]], dtype=np.int64).T, self.n)
        self.first, self.key = False, None

    def batch(self, rows: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
        if self.key == (int(rows[0, 0]), int(rows[1, 0])):
            end = int(starts[1]) if len(starts) > 1 else rows.shape[1]
            self.extend(rows[:, :end])
            starts = starts[1:]
        elif self.key is None and len(starts) > 1:  # the partition's first run
            self.open_run(rows[:, : starts[1]])
            starts = starts[1:]
        if not len(starts):
            return
        self.close(False)
        if len(starts) > 1:  # runs that begin and end in this batch
            inner = rows[:, starts[0] : starts[-1]]
            at = starts[:-1] - starts[0]
            run = np.zeros(inner.shape[1], np.int64)
            run[at[1:]] = 1
            run = np.cumsum(run)
            new_doc = np.r_[True, inner[2, 1:] != inner[2, :-1]]
            new_doc[at] = True
            docs = np.add.reduceat(new_doc.astype(np.int64), at)
            self.emit(DROP, inner[:, (docs[run] >= self.min_docs) & (inner[2] != inner[2, at][run])])
        self.open_run(rows[:, starts[-1] :])

    def take(self) -> pa.RecordBatch:
        got = np.hstack(self.out) if self.out else np.zeros((7, 0), np.int64)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int32)), *[pa.array(x) for x in got[1:]]], names=["kind", *COLS, "n"])


def stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    state = Stream(min_docs)
    for b in batches:
        if b.num_rows:
            state.batch(np.vstack([b.column(k).to_numpy() for k in range(5)]))
            yield state.take()
    state.close(True)
    yield state.take()


def drop_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """did, th, n_dropped, dropped: for each document that loses lines a sparse bitmap, words of 64 lines in order."""
    rows = cut(occurrences(df, id_col, text_col, min_chars))
    ranged = rows.repartitionByRange("h1", "h2", F.col("did").desc()).sortWithinPartitions("h1", "h2", F.col("did").desc(), "pos")
    seen = cut(ranged.mapInArrow(lambda it: stream(it, min_docs), SCHEMA))
    # two rows a partition at most; written, so that their size is known when the join with them is planned
    totals = cut(seen.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("did").alias("keeper")).filter(F.col("docs") >= min_docs))
    pending = (
        seen.filter(F.col("kind") == PENDING)
        .join(totals, ["h1", "h2"])
        .filter(F.col("did") != F.col("keeper"))
    )
    drops = seen.filter(F.col("kind") == DROP).select("did", "th", "pos").unionByName(pending.select("did", "th", "pos"))
    bits = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return (
        drops.groupBy("did", "th", F.floor(F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bit_or(bits).alias("bits"))
        .groupBy("did", "th")
        .agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    )


def with_bitmaps(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """``df`` plus _n_lines, _n_dropped and _kept, its text without the dropped lines."""
    maps = drop_bitmaps(df, id_col, text_col, min_chars, min_docs).select(
        F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("n_dropped").alias("_dropped_n"), F.col("dropped").alias("_dropped")
    )
    joined = keyed(df, id_col, text_col).join(maps, ["_did", "_th"], "left")
    t = text_or_empty(F.col(text_col))
    # the sparse words are put into a full array once, so each line finds its bit by position
    words = F.floor((F.size(lines_of(t)) + 63) / 64).cast("int")

    def bitmap(sparse: Column) -> Column:
        gaps = F.zip_with(sparse, F.slice(sparse, F.lit(2), F.size(sparse)), lambda x, y: F.concat(F.array(x["bits"]), zeros(F.coalesce(y["word"], words) - x["word"] - 1)))
        return F.concat(zeros(F.element_at(sparse, 1)["word"]), F.flatten(gaps))

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0)))

    kept = let(bitmap(F.col("_dropped")), lambda bits: F.filter(lines_of(t), lambda line, i: F.getbit(F.element_at(bits, F.floor(i / 64).cast("int") + 1), (i % 64).cast("int")) == 0))
    keep = F.array_join(kept, "\n")
    return joined.withColumns(
        {
            "_n_lines": F.size(lines_of(t)).cast("long"),
            "_n_dropped": F.coalesce("_dropped_n", F.lit(0)).cast("long"),
            "_kept": F.when(F.col("_dropped").isNull(), t).otherwise(keep),
        }
    )


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per input row.

    A null or empty text is one empty line. Rows with one doc_id are one document when documents are
    counted and all keep the line when that id is the largest; null ids count as one
    document below all others. A document whose lines all go keeps the empty text. An empty table
    gives an empty result; other columns of any name do not matter.
    """
    return with_bitmaps(df.select(id_col, text_col), id_col, text_col, min_chars, min_docs).select(
        F.col(id_col).alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256")
    )


def deduped_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``df`` with repeated lines taken out of its texts; its columns are kept, ``n_chars`` is renewed.

    Null texts become empty, an empty table gives an empty result; ids that are null or repeated are treated as in ``line_dedup``.
    """
    rows = wrapped(df, id=F.col(id_col), text=F.col(text_col))
    out = with_bitmaps(rows, "id", "text", min_chars, min_docs)
    return unwrapped(out, df, **{text_col: F.col("_kept"), "n_chars": F.length("_kept")})


ORACLE = r"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     b AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM a),
     c AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM b),
     h AS (SELECT k, max(doc_id) AS keeper FROM c WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     d AS (SELECT c.*, h.k IS NOT NULL AND c.doc_id <> h.keeper AS gone FROM c LEFT JOIN h ON c.k = h.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

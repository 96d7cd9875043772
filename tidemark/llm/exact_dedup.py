"""Exact duplicates by a tree merge of sorted digest runs.

Every row becomes a digest record of 60 bytes, written once; runs are the partitions of that table, so their number grows with it.
Equal digests are first combined inside each input partition and then by (run, digest), so a text that
fills a third of the corpus leaves its partition once. Then runs are merged in rounds of groups of ``fan`` (at most FAN): cells
are numbers of as many digits to the base ``fan`` as there are rounds, a run starts in the cell of its number, and in round r the
cells that differ in digit r alone exchange their records, each receiving those whose digest has its digit there. What stays
in its cell is the share the receiver already holds; every cell sorts the ``fan`` runs that met and merges equal digests
from left to right, keeping the smallest verified identifier by (longest original text, doc_id) and the number of rows
behind it. After the last round a cell holds one range of digests of the whole table, in order: one run over all
partitions. Cells are cut by the digest's leading bits, which are even, so no sampling is needed and a lost task is computed
again as it was. Only digest records move, never texts; a digest counts as equal if SHA-256, the 64-bit digest and the length agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_or_empty

WHITE = r"[\x20\x09-\x0D]"
KEY = ["check", "digest", "n_norm"]  # the short digest first: ranges are cut by it
FAN = 8  # runs that meet in a round at most


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE, "")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rid, digest, check, n_norm, n_chars: one record per row, 32-byte digest plus an independent check."""
    return (
        df.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("t"))
        .select("doc_id", "t", normalised(F.col("t")).alias("norm"))
        .select(
            "doc_id",
            F.monotonically_increasing_id().alias("rid"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.length("norm").cast("long").alias("n_norm"),
            F.length("t").cast("long").alias("n_chars"),
        )
    )


def merged(level: DataFrame) -> DataFrame:
    """Equal digests of a cell as one record; partitions that hold whole cells are sorted and merged as they stand."""
    return level.groupBy("cell", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def tree(runs: int, most: int) -> tuple[int, int]:
    """(fan, rounds): the fewest rounds of groups of ``most`` or fewer that make one of ``runs``, then the smallest such groups."""
    rounds = 1
    while most**rounds < runs:
        rounds += 1
    return next(fan for fan in range(2, most + 1) if fan**rounds >= runs), rounds


def digit(number: Column, fan: int, place: int) -> Column:
    return F.pmod(F.floor(number / F.lit(fan**place)), F.lit(fan))


def merge_runs(records: DataFrame, most: int) -> DataFrame:
    """Rounds in which ``most`` runs or fewer become one; every level keeps the smallest verified identifier."""
    home = F.spark_partition_id()
    runs = (records.select(home.alias("home")).agg(F.max("home")).first()[0] or 0) + 1
    fan, rounds = tree(runs, most)
    cells = fan**rounds
    best = F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    level = merged(records.select(*KEY, best.alias("best"), F.lit(1).cast("long").alias("n"), F.pmod(home, F.lit(cells)).cast("int").alias("cell")))
    goal = F.shiftright((F.shiftright("check", 33) + (1 << 30)) * F.lit(cells), 31)  # the leading 31 bits, in order, dealt evenly
    for place in reversed(range(rounds)):
        moved = F.col("cell") + (digit(goal, fan, place) - digit(F.col("cell"), fan, place)) * fan**place
        level = merged(level.withColumn("cell", moved.cast("int")).repartitionById(cells, F.col("cell")))
    return level.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("n").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so all empty and null texts form one group. Among equal texts the
    longest original stays, then the smallest doc_id (a null doc_id comes last), then the
    first of repeated rows: exactly one row of a group has ``kept``. An empty table gives an
    empty result; other columns of ``df`` are neither read nor returned.

    The last join may meet one digest with a third of all rows on its left side; each digest is
    unique on the right, so adaptive execution can split that partition.
    """
    records = cut(digests(df, id_col, text_col))
    winners = merge_runs(records, fan)
    return records.join(winners, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS rn FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       rn = 1 AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

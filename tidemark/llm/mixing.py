"""Mixing sources to target weights by cuts in a hash-random order.

Every row gets a random key (a hash of its id). Within a source, rows are ranged by that key into
equal-width buckets; sums are taken inside buckets, bucket totals are summed along the range, and
both together give each row's exact position in its source's random order. A source's budget is
cut at that position; budgets above one pass repeat whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut, text_or_empty, unwrapped, wrapped

KEYS = 65536  # distinct range positions: the first four hex digits of the key


def word_count(text: Column) -> Column:
    """Number of words, runs outside ASCII white space."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Narrow rows (doc_id, size, skey, key, slot, tkey); skey sorts sources by code point, null last."""
    t = text_or_empty(F.col(text_col))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return df.select(
        F.col(id_col).alias("doc_id"),
        word_count(t).alias("size"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")).alias("skey"),
        key.alias("key"),
        F.conv(F.substring(key, 1, 4), 16, 10).cast("long").alias("slot"),
        F.xxhash64(t).alias("tkey"),
        F.monotonically_increasing_id().alias("rid"),
    )


def targets(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """skey, source_size, target from (skey, source_size): shares by weight, capped, excess reshared.

    One row per source (not per document) passes through these two windows. Sources ordered by
    cap over weight: the first at which the common level no longer exceeds its own cap ends the
    resharing, everything before it is capped.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("w", F.element_at(cycle, ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    # levels rise up to the first source that stays below its cap and fall after it
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    return t.select("skey", "source_size", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
    rows_per_bucket: int = 128,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, rid-stable and equal on every rerun.

    A source's taken words sum to its target rounded down: whole epochs, then the words of the
    first rows in hash order, the row at the cut in part. Null texts have size 0 and are taken 0;
    null sources are a source of their own, the last; rows with equal ids are adjacent, in order of size and
    text hash, so results do not depend on the table's layout. An empty table gives an empty result; other columns are not read.

    Buckets grow in number with the table (about ``rows_per_bucket`` rows for an even source, at
    most 65,536 buckets a source), so a source with a third of all rows is summed by many tasks.
    """
    rows = cut(sizes(df, id_col, text_col, source_col, seed))
    n = rows.count()
    buckets = max(1, min(KEYS, n // rows_per_bucket))
    rows = rows.withColumn("bucket", F.floor(F.col("slot") * buckets / KEYS).cast("int"))
    per_bucket = cut(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size")))
    goal = targets(per_bucket.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))).join(goal, "skey").drop("bucket_size")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", "tkey", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("ahead")))
    return placed.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mixture as documents: a row for each epoch a document is in, the row at a cut shortened to its words.

    Returns the columns of ``df``. Copies of one row (equal id and size) are taken as one row's words each; null, empty and
    blank texts carry nothing and leave. Null ids and sources are kept, an empty table gives an empty result.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = (
        mix(df, **options)
        .filter("taken > 0")
        .groupBy("doc_id", "size")
        .agg(F.sum("taken").alias("_taken"), F.count("*").alias("_rows"))
        .select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_taken", "_rows")
    )
    rows = wrapped(df, id=F.col(id_col), text=text_or_empty(F.col(text_col)))
    sized = rows.withColumn("n", word_count(F.col("text")))
    joined = sized.join(taken, F.col("id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_size")))
    left = F.floor(F.col("_taken") / F.col("_rows"))
    epochs = F.sequence(F.lit(1), F.ceil(left / F.col("_size")).cast("int"))
    pieces = joined.filter(left > 0).withColumn("words", F.explode(F.transform(epochs, lambda i: F.least(F.col("_size"), left - (i - 1) * F.col("_size")))))
    runs = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))  # a word with the white space before it
    short = F.array_join(F.slice(runs, F.lit(1), F.col("words").cast("int")), "")
    out = pieces.withColumn("new", F.when(F.col("words") < F.col("_size"), short).otherwise(F.col("text")))
    return unwrapped(out, df, **{text_col: F.col("new"), "n_chars": F.length("new")})


ORACLE = r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  coalesce('0' || source, '1') AS skey, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
           FROM documents),
     s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
     w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
                  [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS w FROM s),
     l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                      - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                     / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
     g AS (SELECT skey, source_size,
                  least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER (), 'inf'::DOUBLE) * w) AS target FROM l),
     p AS (SELECT d.doc_id, d.size, g.source_size, g.target,
                  coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
                  CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs
           FROM d JOIN g USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - ahead)) AS BIGINT) AS taken
FROM p
"""

"""Running values along a key's order, and joins with what came before, for keys of any size.

A window over a key reads the whole key in one task. Here rows are ranged by (key, order), so a hot key lies in many segments; windows run
inside segments, one summary row per key and segment is scanned for what earlier segments bring along, and that is added. Only keys that
lie in several segments have something to bring: as each segment boundary cuts one key at most, these are fewer than two rows a segment,
whatever the number of rows, and they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import written


def segmented(df: DataFrame, key: str, order: Sequence[str], segments: int | None = None) -> DataFrame:
    """``df`` with _segment, the number of the range of (key, order) that a row lies in; written, so the numbers stand."""
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, key, *order).withColumn("_segment", F.spark_partition_id()))


def carried(totals: DataFrame, key: str, **before: Column) -> DataFrame:
    """key, _segment and ``before`` for segments of keys that lie in several; a column is computed over the window ``earlier``."""
    spread = totals.withColumn("_many", F.count("*").over(Window.partitionBy(key))).filter("_many > 1")
    return F.broadcast(spread.select(key, "_segment", *[c.alias(k) for k, c in before.items()]))


def earlier(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """Every row with what its segment is brought; rows of a null key are a key of their own."""
    carry = carry.withColumnsRenamed({key: "_key", "_segment": "_at"})
    return rows.join(carry, rows[key].eqNullSafe(carry["_key"]) & (rows["_segment"] == carry["_at"]), "left").drop("_key", "_at")


def running(
    df: DataFrame, key: str, order: Sequence[str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, segments: int | None = None
) -> DataFrame:
    """``df`` with running sums, maxima and last values that are not null, each up to and including its row.

    ``order`` orders a key's rows; rows that are equal in it are in no stated order among themselves. Null keys are one key. A sum over nothing is 0,
    a maximum or last value null. Names of the new columns replace columns of ``df``.
    """
    sums, maxima, lasts = sums or {}, maxima or {}, lasts or {}
    rows = segmented(df, key, order, segments)
    local = Window.partitionBy(key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    place = F.struct(*order)
    totals = rows.groupBy(key, "_segment").agg(
        *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()], *[F.max(c).alias(f"_m_{k}") for k, c in maxima.items()],
        *[F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), place)).alias(f"_l_{k}") for k, c in lasts.items()],
    )
    before = {f"_s_{k}": F.sum(f"_s_{k}").over(earlier(key)) for k in sums} | {f"_m_{k}": F.max(f"_m_{k}").over(earlier(key)) for k in maxima}
    before |= {f"_l_{k}": F.last(F.when(F.col(f"_l_{k}.v").isNotNull(), F.col(f"_l_{k}")), ignorenulls=True).over(earlier(key)) for k in lasts}
    inside = {f"_i_{k}": F.sum(c).over(local) for k, c in sums.items()} | {f"_j_{k}": F.max(c).over(local) for k, c in maxima.items()}
    inside |= {f"_k_{k}": F.last(c, ignorenulls=True).over(local) for k, c in lasts.items()}
    met = joined(rows.withColumns(inside), carried(totals, key, **before), key)
    out = {k: zero(F.col(f"_i_{k}")) + zero(F.col(f"_s_{k}")) for k in sums} | {k: F.greatest(f"_j_{k}", f"_m_{k}") for k in maxima} | {k: F.coalesce(f"_k_{k}", f"_l_{k}.v") for k in lasts}
    return met.select(*[c for c in df.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str, segments: int | None = None) -> DataFrame:
    """``df`` with ``name``: the number of a row among those of its key, from 0."""
    return running(df, key, order, sums={name: F.lit(1).cast("long")}, segments=segments).withColumn(name, F.col(name) - 1)


def streaks(df: DataFrame, key: str, order: Sequence[str], good: Column, segments: int | None = None) -> DataFrame:
    """``df`` with ``streak``: failures in a row up to and including each row; 0 at a success, null counts as a failure.

    A streak is a row's number less that of the last success. A segment tells how many rows it has and where its last success
    stands; summed and maximised over the segments before, these give a row's number and the last success anywhere before it.
    """
    rows = segmented(df.withColumn("_good", F.coalesce(good, F.lit(False))), key, order, segments)
    local = Window.partitionBy(key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count("*").over(local)).withColumn("_last", F.max(F.when(F.col("_good"), F.col("_n"))).over(local))
    totals = rows.groupBy(key, "_segment").agg(F.count("*").alias("_rows"), F.max(F.when(F.col("_good"), F.col("_n"))).alias("_end"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier(key)), F.lit(0)))
    met = joined(rows, carried(totals, key, _before=F.col("_before"), _seen=F.max(F.col("_before") + F.col("_end")).over(earlier(key))), key)
    before = F.coalesce("_before", F.lit(0))
    last = F.coalesce(before + F.col("_last"), F.col("_seen"), F.lit(0))
    return met.select(*df.columns, (before + F.col("_n") - last).cast("long").alias("streak"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, name: str = "found", exact: bool = True, segments: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``name``: the newest row of ``right`` of its key that is not after its own time, as a struct; null if there is none.

    Both sides are laid along one line of (key, time) and the last row of ``right`` before each point is a running value, so a key is met as often
    as it is asked for without a product of its rows. Of right rows of one time the largest counts (by their other columns); with
    ``exact`` off, rows of just that time do not count. Rows with a null time or key find nothing and are never found; repeated rows of ``left`` stay.
    """
    others = [c for c in right.columns if c not in (key, right_at)]
    kept = right.filter(F.col(key).isNotNull() & F.col(right_at).isNotNull()).groupBy(key, right_at).agg(F.max(F.struct(*others)).alias("_o"))
    value = F.struct(F.col(right_at).alias(right_at), *[F.col(f"_o.{c}").alias(c) for c in others])
    points = kept.select(key, F.col(right_at).alias("_time"), F.lit(0 if exact else 2).alias("_side"), value.alias("_right"))
    asked = left.select(key, F.col(at).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    line = running(points.unionByName(asked, allowMissingColumns=True), key, ["_time", "_side"], lasts={"_right": F.col("_right")}, segments=segments)
    known = F.when(F.col(f"_left.{key}").isNotNull() & F.col(f"_left.{at}").isNotNull(), F.col("_right"))
    return line.filter("_side = 1").select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], known.alias(name))

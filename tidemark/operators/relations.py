"""Pages, prefixes and matches: pagination, budgets per group, wildcard subscriptions, set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WILD = ("site_id", "monitor_id", "kind")


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    """Rows offset+1 to offset+limit in a total order; the sort is a top-k, not a full one."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], budget: int) -> DataFrame:
    """The first ``budget`` rows of each group; tasks drop rows beyond it before they are shuffled (window group limit)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") <= budget).drop("_n")


def wildcard_match(changes: DataFrame, subscriptions: DataFrame, on: Sequence[str] = WILD, parts: int = 64) -> DataFrame:
    """Every change with every subscription whose columns ``on`` are null or equal to the change's.

    Instead of a nested loop over all pairs, each change meets the subscriptions of each pattern of wildcards that
    occurs (at most 2^n, told by a first look) by an equi-join: a subscription has one pattern, so no pair comes twice. Subscriptions
    to everything would be a single key for all changes; they are held in ``parts`` copies, and each change meets one.
    """
    every = "*" * len(on)
    pattern = F.concat(*[F.when(F.col(c).isNull(), "*").otherwise("=") for c in on])
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}")
    subs = subscriptions.select(pattern.alias("_p"), *[key(c) for c in on], *[F.col(c) for c in subscriptions.columns if c not in on])
    patterns = sorted(r._p for r in subs.select("_p").distinct().collect())
    subs = subs.withColumn("_part", F.explode(F.when(F.col("_p") == every, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    wide = changes.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in patterns]).cast("array<string>")))
    wide = wide.withColumns({f"_{c}": F.when(F.substring("_p", k + 1, 1) == "=", F.col(c).cast("string")).otherwise("") for k, c in enumerate(on)})
    wide = wide.withColumn("_part", F.when(F.col("_p") == every, F.pmod(F.xxhash64(*changes.columns), F.lit(parts)).cast("int")).otherwise(0))
    return wide.join(subs, ["_p", "_part", *[f"_{c}" for c in on]]).drop("_p", "_part", *[f"_{c}" for c in on])


def broadest(subscriptions: DataFrame, owner: str, on: Sequence[str] = WILD) -> DataFrame:
    """owner and ``on``: an owner's subscriptions without repeats and without those that a broader one of the same owner covers."""
    one = subscriptions.select(owner, *on).distinct()
    wider = [p for p in product((False, True), repeat=len(on)) if any(p)]
    made = F.array(*[F.struct(*[F.when(F.lit(not widen), F.col(c)).alias(c) for widen, c in zip(p, on, strict=True)]) for p in wider])
    candidates = one.select(owner, *[F.col(c).alias(f"_{c}") for c in on], F.explode(made).alias("w"))
    real = candidates.filter(~reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"_{c}")) for c in on]))
    held = one.select(owner, *[F.col(c).alias(f"h_{c}") for c in on])
    covered = real.join(held, [real[owner] == held[owner], *[real[f"w.{c}"].eqNullSafe(held[f"h_{c}"]) for c in on]], "left_semi").select(owner, *[F.col(f"_{c}").alias(c) for c in on])
    return one.exceptAll(covered.distinct())


def set_difference(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side: rows only in ``new`` (added) or only in ``old`` (removed), in one pass over both."""
    both = new.select(*keys, F.lit(1).alias("_s")).unionByName(old.select(*keys, F.lit(2).alias("_s")))
    found = both.groupBy(*keys).agg(F.bit_or("_s").alias("_s")).filter("_s < 3")
    return found.select(*keys, F.when(F.col("_s") == 1, "added").otherwise("removed").alias("side"))


def occurrences(lists: DataFrame, keys: Sequence[str], allow: str, order: str) -> DataFrame:
    """keys, errors: what is wrong with each pair of an allow list and an order list; an empty array if nothing."""
    a, o = F.col(allow), F.col(order)
    count = lambda x: F.size(F.filter(o, lambda y: y == x))
    errors = F.concat(
        F.when(F.size(a) == 0, F.array(F.lit("allow list is empty"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(F.array_distinct(a)) != F.size(a), F.array(F.lit("allow list repeats an entry"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(o, lambda x: ~F.array_contains(a, x)), lambda x: F.concat(F.lit("not allowed: "), x)),
        F.transform(F.filter(F.array_distinct(a), lambda x: count(x) != 1), lambda x: F.concat(x, F.lit(" is ordered "), count(x).cast("string"), F.lit(" times"))),
    )
    return lists.select(*keys, errors.alias("errors"))

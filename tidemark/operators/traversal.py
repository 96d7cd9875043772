"""Sitemap indexes walked by level under one budget of fetches per site."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import network, urls
from tidemark.operators import scans
from tidemark.operators.tables import written

MOST_CHILDREN, MOST_FETCHES, MOST_DEPTH, MOST_ITEMS = 20, 50, 3, 2000
COUNTERS = ("children_truncated", "depth_truncated", "origin_blocked", "missing_lastmod_skipped", "feed_items_truncated", "fetch_budget_truncated", "fetches_used", "pattern_excluded")


def in_pattern(loc: Column, patterns: list[str]) -> Column:
    """Whether the file name of a URL matches one of the globs; without any, all do."""
    name = F.element_at(F.split(urls.path(loc), "/"), -1)
    return reduce(lambda a, b: a | b, [urls.glob_match(F.lit(p), name, prefix=False) for p in patterns], F.lit(not patterns))


Fetched = DataFrame | Callable[[DataFrame], DataFrame]


def traverse(
    roots: DataFrame, entries: Fetched, documents: Fetched, marks: DataFrame, cutoff: str, patterns: list[str] | None = None, depth: int = MOST_DEPTH, children: int = MOST_CHILDREN, fetches: int = MOST_FETCHES
) -> DataFrame:
    """Every child met on the walk: site_id, parent, loc, level, state, mark_moves.

    ``roots``: site_id, origin, url, baseline (a first check, which only records). ``entries``: parent, pos, loc, lastmod (what an index
    document holds). ``documents``: url, kind (sitemap, sitemap-index) of what a fetch would give; a failed fetch has no row. ``marks``: url, mark.
    ``entries`` and ``documents`` may be functions of a level's indexes (parent), which give the entries of those alone and the documents
    of their children, so that indexes which the walk does not open are never laid out.

    Of an index's entries the dated ones after ``cutoff`` whose file name fits are taken, the newest first, ``children`` at
    most. They are walked depth first: a child's place is the path of its ranks, and its number among all
    that pass their gates, in the order of paths, is the budget spent when its turn comes. A parent always comes before
    its children, so one count over the finished levels is the walk itself, and no fetch waits for another. Every level is
    written when it is met, and the walk when it is done, so work is linear in the depth and what reads the walk computes nothing again.
    """
    level = roots.select("site_id", "origin", "baseline", F.col("url").alias("parent"), F.array().cast("array<int>").alias("path"))
    found = []
    for n in range(depth):
        opened = level.select("parent").distinct()
        held, given = (x(opened) if callable(x) else x for x in (entries, documents))
        met = level.join(held, "parent").withColumn("level", F.lit(n))
        dated, fits = F.col("lastmod").isNotNull(), in_pattern(F.col("loc"), patterns or [])
        early = F.when(~dated, "missing_lastmod").when(F.col("lastmod") < cutoff, "old").when(~fits, "excluded")
        met = met.withColumn("state", early)
        order = Window.partitionBy("site_id", "path", "parent", F.col("state").isNull()).orderBy(F.col("lastmod").desc(), "pos", "loc")
        met = met.withColumn("rank", F.row_number().over(order)).withColumn("path", F.concat("path", F.array("rank"))).join(marks.withColumnRenamed("url", "loc"), "loc", "left")
        gate = (
            F.when(F.col("rank") > children, "truncated")
            .when(F.coalesce(urls.origin(F.col("loc")) != F.col("origin"), F.lit(True)), "other_origin")
            .when(F.col("baseline"), "recorded")
            .when(F.col("lastmod") <= F.col("mark"), "unchanged")
            .when(network.url_check(F.col("loc")).isNotNull(), "refused")
        )
        met = met.withColumn("state", F.coalesce("state", gate)).join(given.select(F.col("url").alias("loc"), "kind"), "loc", "left")
        met = written(met.select("site_id", "origin", "baseline", "parent", "loc", "level", "path", "lastmod", "kind", "state"))
        found.append(met.drop("origin", "baseline"))
        level = met.filter("state is null and kind = 'sitemap-index'").select("site_id", "origin", "baseline", F.col("loc").alias("parent"), "path")
    every = reduce(DataFrame.unionByName, found)
    every = scans.running(every, "site_id", ["path", "loc"], sums={"turn": F.col("state").isNull().cast("long")})
    every = written(every.withColumn("turn", F.when(F.col("state").isNull(), F.col("turn"))))
    reached = every.filter(F.col("turn") <= fetches).select("site_id", F.slice("path", 1, 99).alias("_p"))
    inside = every.filter("level = 0").unionByName(every.filter("level > 0").join(reached, (every["site_id"] == reached["site_id"]) & (F.expr("slice(path, 1, level)") == F.col("_p")), "left_semi"))
    state = (
        F.when(F.col("state").isNotNull(), F.col("state"))
        .when(F.col("turn") > fetches, "over_budget")
        .when(F.col("kind").isNull(), "failed")
        .when((F.col("kind") == "sitemap-index") & (F.col("level") + 1 >= depth), "too_deep")
        .otherwise("opened")
    )
    return written(inside.select("site_id", "parent", "loc", "level", "path", "lastmod", "kind", state.alias("state")))


def counters(walk: DataFrame, items: DataFrame, cutoff: str, most: int = MOST_ITEMS) -> DataFrame:
    """site_id and the eight counters of a walk; ``items``: parent (an opened sitemap), url, updated_at."""
    opened = walk.filter("state = 'opened' and kind = 'sitemap'").select("site_id", F.col("loc").alias("parent"))
    read = opened.join(items.filter("url is not null"), "parent").groupBy("site_id", "parent")
    kept = F.count_if(F.col("updated_at") >= cutoff)
    per_map = read.agg(F.count_if(F.col("updated_at").isNull()).alias("undated"), F.greatest(kept - most, F.lit(0)).alias("over")).groupBy("site_id").agg(F.sum("undated").alias("undated"), F.sum("over").alias("over"))
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    out = walk.groupBy("site_id").agg(
        n("truncated").alias("children_truncated"), n("too_deep").alias("depth_truncated"), n("other_origin").alias("origin_blocked"), n("missing_lastmod").alias("missing"),
        n("over_budget").alias("fetch_budget_truncated"), n("opened", "failed", "too_deep").alias("fetches_used"), n("excluded").alias("pattern_excluded"),
    )
    out = out.join(per_map, "site_id", "left").withColumns({"missing_lastmod_skipped": F.col("missing") + F.coalesce("undated", F.lit(0)), "feed_items_truncated": F.coalesce("over", F.lit(0))})
    return out.select("site_id", *COUNTERS)


def moved_marks(walk: DataFrame, truncated: DataFrame) -> DataFrame:
    """site_id, loc, lastmod: watermarks that move forward after a walk.

    Those of opened children, unless something below them was cut off: a sitemap whose items were (``truncated``: loc), or a child that
    was beyond the number of children, the depth or the budget; all its indexes keep their old marks, so that it is met again.
    """
    cut = walk.filter(F.col("state").isin("truncated", "too_deep", "over_budget")).select("site_id", "path")
    cut = cut.unionByName(walk.join(truncated.select("loc").distinct(), "loc", "left_semi").select("site_id", "path"))
    above = cut.select("site_id", F.explode(F.expr("transform(sequence(1, size(path)), n -> slice(path, 1, n))")).alias("path")).distinct()
    return walk.filter("state = 'opened'").join(above, ["site_id", "path"], "left_anti").select("site_id", "loc", "lastmod")

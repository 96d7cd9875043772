"""Whole checks: gates in order, content of what passed, changes to deliveries; robots cache, recipes, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import network, outcomes, urls
from tidemark.operators import policy, relations
from tidemark.operators.keyed import insert_if_new
from tidemark.plans import bindings as b
from tidemark.plans.content import page_changes


def run_checks(monitors: DataFrame, rules: DataFrame, fetched: DataFrame, captures: DataFrame, agent: str) -> DataFrame:
    """monitor_id, gate, level, dedupe_key: what came of each monitor's check.

    Gates close in the order of the cost they save: status, address, robots, fetch (``fetched``: monitor_id,
    failure or null). Only captures of monitors that pass all of them are compared; a monitor that is refused
    keeps its row, so that every check leaves a trace.
    """
    targets = monitors.select("monitor_id", F.col("site_id").alias("origin"), "url")
    verdicts = policy.robots_verdict(targets, rules, agent).select("monitor_id", "verdict")
    ssrf = network.url_check(F.col("url"))
    gate = (
        F.when(F.col("status").isin("archived", "blocked_by_robots", "paused"), "skipped")
        .when(ssrf.isNotNull(), "ssrf_blocked")
        .when(F.col("verdict") == "disallowed", "blocked_by_robots")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .otherwise("checked")
    )
    gated = monitors.join(verdicts, "monitor_id", "left").join(fetched, "monitor_id", "left").select("monitor_id", gate.alias("gate"))
    passed = gated.filter("gate = 'checked'").select("monitor_id")
    found = page_changes(captures, only=passed)
    return gated.join(found.select("monitor_id", "level", "dedupe_key"), "monitor_id", "left")


def fan_out(changes: DataFrame, subscriptions: DataFrame, stored: DataFrame) -> DataFrame:
    """change_id, destination_id: deliveries to create for changes, one per destination however many subscriptions match.

    A destination's subscriptions are brought to the broadest ones first, so pairs that are dropped as repeats are hardly made.
    """
    met = relations.wildcard_match(changes, relations.broadest(subscriptions, "destination_id")).select("change_id", "destination_id")
    return insert_if_new(met, stored, ["change_id", "destination_id"], [])


def cached_rules(targets: DataFrame, cache: DataFrame, now: str, ttl_s: int = 3600) -> DataFrame:
    """``targets`` (origin, ...) with from_cache: whether an entry (origin, fetched_at) is younger than ``ttl_s`` and not of the future."""
    fresh = cache.filter(policy.fresh_at(now, ttl_s)).groupBy("origin").agg(F.max("fetched_at").alias("fetched_at"))
    return targets.join(fresh, "origin", "left").withColumn("from_cache", F.col("fetched_at").isNotNull())


def recipe(kind: Column, config: Column) -> Column:
    """The recipe of a source by its type and the modes of its JSON configuration (null: none)."""
    mode = lambda name: F.coalesce(F.get_json_object(config, f"$.{name}"), F.lit(""))
    return (
        F.when(kind.isin("rss", "atom"), "feed")
        .when(kind == "page", F.when(mode("page_mode") == "extract", "page:extract").otherwise("page:content"))
        .when(kind.isin("sitemap", "sitemap-index"), F.when(mode("sitemap_mode") == "traverse", "sitemap:traverse").otherwise("sitemap:direct"))
    )


# The stages of each recipe, in order.
STAGES = {
    "page:extract": "fetch,extract,diff,notify", "page:content": "fetch,content-diff,notify", "sitemap:traverse": "traverse,diff,notify", "sitemap:direct": "fetch,sitemap-diff,notify", "feed": "fetch,extract,diff,notify",
}


def checks_run(spark, sf_dir):
    m = b.monitors(spark, sf_dir)
    rules = m.select(F.col("site_id").alias("origin")).distinct().select("origin", F.lit(1).alias("group_no"), F.array(F.lit("*")).alias("agents"), F.lit(1).alias("rule_no"), F.lit("disallow").alias("directive"), F.lit("/*page=2").alias("pattern"))
    k = F.col("monitor_id") % 11
    fetched = m.select("monitor_id", F.when(k == 0, "timeout").when(k == 1, "not_found").alias("failure"))
    return run_checks(m, rules, fetched, b.captures(spark, sf_dir), "tidebot").select("monitor_id", "gate", "level")


def fan_out_counts(spark, sf_dir):
    site = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_nationkey").cast("long").alias("site_id"))
    changes = b.changes(spark, sf_dir).select("change_id", "monitor_id", "kind").join(site, "monitor_id")
    stored = b.deliveries(spark, sf_dir).select("change_id", "destination_id")
    return fan_out(changes, b.subscriptions(spark, sf_dir), stored).groupBy("destination_id").agg(F.count("*").alias("n"), F.sum("change_id").alias("ids"))


def robots_cache(spark, sf_dir):
    a = b.attempts(spark, sf_dir)
    cache = a.select(F.col("origin_id").alias("origin"), F.col("seen_at").alias("fetched_at"))
    now = "2024-01-15 00:00:00"
    return cached_rules(a.select(F.col("origin_id").alias("origin")).distinct(), cache, now).select("origin", "from_cache")


def recipes(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("page", "rss", "atom", "sitemap", "sitemap-index")])
    kind, k = F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")), F.col("page_id") % 4
    config = F.when(k == 0, '{"page_mode":"extract","sitemap_mode":"traverse"}').when(k == 1, '{"page_mode":"content","sitemap_mode":"direct"}').when(k == 2, "{}")
    r = recipe(kind, config)
    stages = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return b.table(spark, sf_dir, "pages").select("page_id", r.alias("recipe"), stages[r].alias("stages"))


def config_reshaped(spark, sf_dir):
    """A JSON configuration read by its schema and written under other names, nulls left out."""
    c = F.from_json("props", "k long, missing string")
    return b.table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(c["k"].alias("itemSelector"), c["missing"].alias("titleSelector"))).alias("config"))


def response_signals(spark, sf_dir):
    """Whether a body is of an allowed type, and whether it looks like a challenge."""
    d = b.table(spark, sf_dir, "documents")
    ct = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "Text/HTML; charset=utf-8").when(F.col("doc_id") % 4 == 2, "application/pdf").otherwise("text/plain")
    headers = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("CF-Mitigated"))).otherwise(F.array(F.lit("server")))
    return d.select("doc_id", outcomes.allowed_type(ct, F.array(F.lit("text/html"), F.lit("text/plain"))).alias("type_ok"), outcomes.captcha(headers, F.col("text")).alias("challenge"))


def same_origin_links(spark, sf_dir):
    """Links that stay on their site; what is no URL does not."""
    links = b.page_links(spark, sf_dir)
    target = F.when(F.col("pos") % 3 == 0, F.concat("site_id", "href")).when(F.col("pos") % 3 == 1, F.concat(F.lit("https://elsewhere.example"), F.col("href"))).otherwise(F.col("href"))
    return links.select("page_id", "pos", (urls.origin(target) == F.col("site_id")).alias("inside"))


QUERIES = {
    "checks_run": (
        checks_run,
        f"""SELECT monitor_id, gate, CASE WHEN gate = 'checked' THEN CASE monitor_id % 5 WHEN 2 THEN 'normalized_hash' WHEN 3 THEN 'text_hash' END END AS level FROM (SELECT monitor_id,
 CASE WHEN status IN ('archived', 'blocked_by_robots', 'paused') THEN 'skipped' WHEN url LIKE '%/%page=2%' THEN 'blocked_by_robots' WHEN monitor_id % 11 = 0 THEN 'timeout' WHEN monitor_id % 11 = 1 THEN 'not_found' ELSE 'checked' END AS gate FROM {b.MONITORS})""",
    ),
    "fan_out_counts": (
        fan_out_counts,
        f"""WITH c AS (SELECT change_id, monitor_id, kind = 'new' AS fresh, c_nationkey AS site FROM {b.CHANGES} JOIN customer ON c_custkey = monitor_id), s AS (SELECT destination_id, site_id, monitor_id, kind IS NULL AS any_kind FROM {b.SUBSCRIPTIONS}),
m AS (SELECT destination_id, change_id FROM s JOIN c ON s.monitor_id = c.monitor_id AND coalesce(s.site_id, c.site) = c.site AND (any_kind OR fresh) UNION SELECT destination_id, change_id FROM s JOIN c ON s.monitor_id IS NULL AND s.site_id = c.site AND (any_kind OR fresh)
      UNION SELECT destination_id, change_id FROM (SELECT DISTINCT destination_id, any_kind FROM s WHERE monitor_id IS NULL AND site_id IS NULL) CROSS JOIN c WHERE any_kind OR fresh)
SELECT destination_id, count(*) AS n, CAST(sum(change_id) AS BIGINT) AS ids FROM m ANTI JOIN {b.DELIVERIES} d USING (change_id, destination_id) GROUP BY destination_id""",
    ),
    "robots_cache": (robots_cache, f"SELECT origin_id AS origin, bool_or(seen_at <= TIMESTAMP '2024-01-15' AND seen_at > TIMESTAMP '2024-01-14 23:00:00') AS from_cache FROM {b.ATTEMPTS} GROUP BY ALL"),
    "recipes": (
        recipes,
        """SELECT page_id, CASE WHEN page_id % 5 IN (1, 2) THEN 'feed' WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 'page:extract' ELSE 'page:content' END ELSE CASE WHEN page_id % 4 = 0 THEN 'sitemap:traverse' ELSE 'sitemap:direct' END END AS recipe,
 CASE WHEN page_id % 5 IN (1, 2) THEN 'fetch,extract,diff,notify' WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 'fetch,extract,diff,notify' ELSE 'fetch,content-diff,notify' END
      ELSE CASE WHEN page_id % 4 = 0 THEN 'traverse,diff,notify' ELSE 'fetch,sitemap-diff,notify' END END AS stages FROM pages""",
    ),
    "config_reshaped": (config_reshaped, """SELECT event_id, '{"itemSelector":' || json_extract_string(props, '$.k') || '}' AS config FROM events"""),
    "response_signals": (
        response_signals,
        "SELECT doc_id, doc_id % 4 IN (1, 3) AS type_ok, doc_id % 10 = 0 OR contains(lower(coalesce(text, '')), 'captcha') OR contains(lower(coalesce(text, '')), 'challenge') AS challenge FROM documents",
    ),
    "same_origin_links": (same_origin_links, f"SELECT page_id, pos, pos % 3 = 0 AS inside FROM {b.LINKS}"),
}

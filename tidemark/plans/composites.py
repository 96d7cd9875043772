"""Whole stages as one plan: page, item and feed checks, robots with a cache, the walk over sitemap indexes, a batch of deliveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import html, text
from tidemark.operators import keyed, policy, transitions, traversal
from tidemark.operators.differences import edited
from tidemark.operators.tables import written
from tidemark.plans import bindings as b
from tidemark.plans.check import fan_out
from tidemark.plans.content import _HASHED, _R, block_text_sql, snapshots
from tidemark.plans.feeds import _xml, detected
from tidemark.sources import feeds, pages, robots
from tidemark.streaming import delivery


def page_check(captures: DataFrame, previous: DataFrame, texts: DataFrame, stored: DataFrame, ignore: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """monitor_id, level, dedupe_key, inserted, added, removed of captures (monitor_id, url, body): normalize, compare, difference, insert.

    Raw hashes decide first; what differs is normalized once and written, so that no page is parsed again for what reads it.
    ``previous``: monitor_id and the hashes of its last snapshot. ``texts``: key, body of stored texts, read for changed captures
    alone; a lost one counts as empty. ``stored``: monitor_id, dedupe_key of changes. A monitor without a snapshot is at its
    baseline and has no level, like one that did not change; a change whose key is stored is not inserted.
    """
    hashes = ("raw_hash", "normalized_hash", "text_hash")
    old = previous.select("monitor_id", F.struct(*hashes).alias("old"))
    differing = captures.join(old, "monitor_id").filter(text.sha256(F.col("body")) != F.col("old.raw_hash"))
    met = written(snapshots(differing.select("monitor_id", "url", "body", "old"), ignore, include).drop("url", "body", "normalized_html")).withColumn("new", F.struct(*hashes))
    changed, level = text.compared(F.col("old"), F.col("new"))
    found = met.filter(changed).select("monitor_id", level.alias("level"), F.when(level == "text_hash", F.col("text_hash")).otherwise(F.col("normalized_hash")).alias("dedupe_key"), F.col("old.text_hash").alias("key"), "extracted_text")
    known = stored.select("monitor_id", "dedupe_key").distinct().withColumn("_k", F.lit(True))
    told = keyed.read_blobs(found, texts, "key").join(known, ["monitor_id", "dedupe_key"], "left").withColumn("inserted", F.col("_k").isNull())
    told = edited(told.select("monitor_id", "level", "dedupe_key", "inserted", "body", "extracted_text"), "body", "extracted_text")
    told = told.withColumnsRenamed({"added_count": "added", "removed_count": "removed"}).drop("patch")
    return captures.select("monitor_id").join(told, "monitor_id", "left")


def item_check(items: DataFrame, bodies: DataFrame, known: DataFrame) -> DataFrame:
    """monitor_id, body_hash, n_items, n_new, n_suppressed: a snapshot and the items of each fetched body (monitor_id, body).

    ``items``: monitor_id, pos, stable_key, url, updated_at. A body without items keeps its snapshot, so that its next fetch can be conditional.
    """
    seen = items.groupBy("monitor_id").agg(F.count("*").alias("n_items"))
    new = detected(items, known).groupBy("monitor_id").agg(F.count_if(~F.col("suppressed")).alias("n_new"), F.count_if("suppressed").alias("n_suppressed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return bodies.select("monitor_id", text.sha256(F.col("body")).alias("body_hash")).join(seen, "monitor_id", "left").join(new, "monitor_id", "left").select("monitor_id", "body_hash", zero("n_items"), zero("n_new"), zero("n_suppressed"))


# ---------------------------------------------------------------- registered queries


def page_check_run(spark, sf_dir):
    """Second captures against first ones, adverts ignored: some texts lost, some changes stored, deliveries counted."""
    c = b.captures(spark, sf_dir)
    first = written(snapshots(c.filter("round = 1").drop("round"), ignore=(".ad",)).drop("url", "body", "normalized_html"))
    texts = first.filter("monitor_id % 6 <> 0").select(F.col("text_hash").alias("key"), F.col("extracted_text").alias("body")).dropDuplicates(["key"])
    second = c.filter("round = 2").drop("round")
    stored = snapshots(second.filter("monitor_id % 4 = 1"), ignore=(".ad",)).select("monitor_id", F.col("text_hash").alias("dedupe_key"))
    done = written(page_check(second, first, texts, stored, ignore=(".ad",)))
    site = (F.col("monitor_id") % 25).cast("long").alias("site_id")
    changes = done.filter("inserted").select(F.col("monitor_id").alias("change_id"), "monitor_id", site, F.lit("updated").alias("kind"))
    sent = fan_out(changes, b.subscriptions(spark, sf_dir), spark.createDataFrame([], "change_id long, destination_id long")).groupBy(F.col("change_id").alias("monitor_id")).agg(F.count("*").alias("n_deliveries"))
    return done.join(sent, "monitor_id", "left").select("monitor_id", "level", "dedupe_key", "inserted", "added", "removed", F.coalesce("n_deliveries", F.lit(0)).alias("n_deliveries"))


def include_region(spark, sf_dir):
    """Captures of which only the article counts; without one there is nothing left."""
    c = b.captures(spark, sf_dir)
    return c.select("monitor_id", "round", F.inline(F.array(html.hashed(F.col("body"), F.col("url"), (), ("article",))))).select("monitor_id", "round", "normalized_hash", "text_hash")


def page_items_check(spark, sf_dir):
    """Menu entries as items of pages; every second one is known, every fourth page is at its baseline."""
    p = b.table(spark, sf_dir, "pages")
    found = pages.items(p, "page_id", "html", "url", "nav li").select(F.col("page_id").alias("monitor_id"), "pos", F.col("url").alias("stable_key"), "url", F.lit(None).cast("string").alias("updated_at"))
    known = found.filter("monitor_id % 4 <> 0 and pos % 2 = 0").select("monitor_id", "stable_key", F.lit("2024-01-01").alias("known_at"))
    return item_check(found, p.select(F.col("page_id").alias("monitor_id"), F.col("html").alias("body")), known)


def feed_check(spark, sf_dir):
    """RSS documents, every seventh cut off: what cannot be parsed leaves no snapshot and no items."""
    head = "<?xml version='1.0'?><rss version='2.0'><channel><title>t</title>"
    docs = _xml(spark, sf_dir, head, lambda h: F.concat(F.lit("<item><title>x</title><link>https://x.org"), h, F.lit("</link></item>")), "</channel></rss>")
    docs = docs.withColumn("xml", F.when(F.col("doc") % 7 == 0, F.substring("xml", 1, len(head) + 6)).otherwise(F.col("xml")))
    fine = docs.join(feeds.parse_errors(docs).filter("error is null").select("doc"), "doc", "left_semi")
    found = feeds.rss_items(fine).select(F.col("doc").alias("monitor_id"), "pos", "stable_key", "url", "updated_at")
    known = found.filter("monitor_id % 4 <> 0 and pos % 2 = 0").select("monitor_id", "stable_key", F.lit("2024-01-01").alias("known_at"))
    return item_check(found, fine.select(F.col("doc").alias("monitor_id"), F.col("xml").alias("body")), known)


ROBOTS_CACHED, ROBOTS_FETCHED = "User-agent: *\nDisallow: /c/1\n", "User-agent: tidebot\nDisallow: /c\nAllow: /c/2\n"


def robots_check(spark, sf_dir):
    """Targets of sites with a fresh, a stale or no cache entry, and fetches of every kind."""
    n = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    origin = F.concat(F.lit("https://n"), F.col("n").cast("string"), F.lit(".example"))
    k = F.col("n") % 5
    cache = n.filter("n % 3 <> 2").select(origin.alias("origin"), F.when(F.col("n") % 3 == 0, "2024-01-01 00:30:00").otherwise("2023-12-31 00:00:00").cast("timestamp").alias("fetched_at"), F.lit(ROBOTS_CACHED).alias("body"), (F.col("n") % 2 == 1).alias("unavailable"))
    fetches = n.filter("n % 5 <> 4").select(origin.alias("origin"), F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503).alias("status"), F.when(k == 0, ROBOTS_FETCHED).otherwise("x").alias("body"))
    c = b.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    targets = c.select("c_custkey", origin.alias("origin"), F.concat(origin, F.lit("/c/"), F.col("c_custkey").cast("string")).alias("url"))
    return policy.robots_check(targets, cache, fetches, "tidebot", "2024-01-01 01:00:00").drop("origin", "url")


PATTERNS, CUTOFF, DEPTH, CHILDREN, FETCHES, ITEMS = ["s*.xml", "c*.xml"], "2024-01-12", 2, 3, 4, 2


def _site_maps(spark, sf_dir):
    """Indexes of nations with suppliers as children, of even suppliers with customers as theirs.

    What indexes hold is laid out for the indexes asked for: all customers of all suppliers would be a product that the walk hardly opens.
    """
    origin = F.concat(F.lit("https://n"), F.col("n").cast("string"), F.lit(".example"))
    day = lambda k: F.concat(F.lit("2024-01-"), (10 + k % 10).cast("string"))
    roots = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n")).select(F.col("n").alias("site_id"), origin.alias("origin"), F.concat(origin, F.lit("/index.xml")).alias("url"), (F.col("n") % 10 == 9).alias("baseline"))
    k = F.col("k")
    s = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    own = F.concat(F.when(k % 13 == 0, "https://elsewhere.example").otherwise(origin), F.when(k % 7 == 0, "/t").otherwise("/s"), k.cast("string"), F.lit(".xml"))
    first = s.select("k", "n", F.concat(origin, F.lit("/index.xml")).alias("parent"), k.alias("pos"), own.alias("loc"), F.when(k % 11 != 0, day(k)).alias("lastmod"))
    c = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))

    def held(parents):
        top = first.join(parents, "parent", "left_semi")
        met = first.filter("k % 2 = 0").select("k", "n", F.col("loc").alias("parent"), (k % 7).alias("r")).join(parents, "parent", "left_semi").join(c.withColumn("r", F.col("c") % 7), ["n", "r"])
        below = met.select("c", "parent", F.col("c").alias("pos"), F.concat(origin, F.lit("/c"), F.col("c").cast("string"), F.lit("-"), k.cast("string"), F.lit(".xml")).alias("loc"), day(F.col("c")).alias("lastmod"))
        return top, below

    def entries(parents):
        return reduce(DataFrame.unionByName, [x.select("parent", "pos", "loc", "lastmod") for x in held(parents)])

    def documents(parents):
        top, below = held(parents)
        return top.filter("k % 5 <> 0").select(F.col("loc").alias("url"), F.when(k % 2 == 0, "sitemap-index").otherwise("sitemap").alias("kind")).unionByName(
            below.select(F.col("loc").alias("url"), F.when(F.col("c") % 3 == 0, "sitemap-index").otherwise("sitemap").alias("kind"))
        )

    marks = first.filter("k % 3 = 0").select(F.col("loc").alias("url"), F.lit("2024-01-15").alias("mark"))
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k"))
    items = first.select("k", F.col("loc").alias("parent")).join(o, "k").select("parent", F.concat(F.lit("/"), F.col("o").cast("string")).alias("url"), F.when(F.col("o") % 4 != 0, day(F.col("o"))).alias("updated_at"))
    return roots, entries, documents, marks, items


def _walk(spark, sf_dir):
    roots, entries, documents, marks, items = _site_maps(spark, sf_dir)
    return traversal.traverse(roots, entries, documents, marks, CUTOFF, PATTERNS, DEPTH, CHILDREN, FETCHES), items


def traversal_walk(spark, sf_dir):
    return _walk(spark, sf_dir)[0].select("site_id", "parent", "loc", F.col("level").cast("long").alias("level"), "state")


def traversal_all_counters(spark, sf_dir):
    walk, items = _walk(spark, sf_dir)
    return traversal.counters(walk, items, CUTOFF, ITEMS)


def traversal_marks(spark, sf_dir):
    walk, items = _walk(spark, sf_dir)
    over = items.filter(F.col("updated_at") >= CUTOFF).groupBy(F.col("parent").alias("loc")).count().filter(F.col("count") > ITEMS)
    return traversal.moved_marks(walk, over)


def delivery_batch(spark, sf_dir):
    """Deliveries by line: claimed, refused at archived destinations or after five attempts, sent and settled."""
    d, k = b.deliveries(spark, sf_dir), F.col("change_id") * 8 + F.col("line")
    now = "1996-01-01 00:00:00"
    state = d.select(k.alias("delivery_id"), "status", (F.col("change_id") % 7).alias("attempt_count"), "claimed_at", (F.col("destination_id") % 4 == 0).alias("archived"))
    messages = state.filter("delivery_id % 3 <> 0").select("delivery_id").unionByName(state.filter("delivery_id % 5 = 0").select("delivery_id"))
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 429, 404, 503)]), (F.col("delivery_id") % 5 + 1).cast("int"))
    responses = state.filter("delivery_id % 11 <> 0").select("delivery_id", code.cast("long").alias("status_code"), (F.col("delivery_id") % 60).alias("retry_after_s"))
    out = delivery.step(state, messages, responses, now)
    return out.select("delivery_id", "status", "attempt_count", F.date_format("claimed_at", "yyyy-MM-dd").alias("claimed_on"), "reply", "delay_s")


def blob_read(spark, sf_dir):
    """Texts read back by their key; lost ones are empty."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", text.sha256(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("t"))
    blobs = d.groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("t").alias("body")).filter("first % 3 <> 0").select("key", "body")
    return keyed.read_blobs(d.select("doc_id", "key"), blobs, "key").select("doc_id", F.length("body").cast("long").alias("n_chars"))


def sitemap_index_items(spark, sf_dir):
    """Children of sitemap indexes; repeated ones and those without a place go, dates are optional."""
    date = F.when(F.col("pos") % 3 != 0, F.concat(F.lit("<lastmod>"), F.col("updated_at"), F.lit("</lastmod>"))).otherwise("")
    loc = F.when(F.col("pos") % 4 == 3, "<loc> </loc>").otherwise(F.concat(F.lit("<loc>/m"), (F.col("pos") % 8).cast("string"), F.lit(".xml</loc>")))
    docs = _xml(spark, sf_dir, "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>", lambda h: F.concat(F.lit("<sitemap>"), loc, date, F.lit("</sitemap>")), "</sitemapindex>")
    return feeds.sitemap_items(docs, index=True).select(F.col("doc").alias("page_id"), "pos", "url", "updated_at")


XML = [
    ("<rss version='2.0'><channel></channel></rss>", None), ("<?xml version='1.0'?>\n<feed xmlns='a'><title>t</title></feed>", None), ("<urlset><url><loc>/a</loc></url></urlset>", None), ("<sitemapindex></sitemapindex>", None),
    ("<html><body></body></html>", "unexpected_root"), ("<urlset><url><loc>/a</loc></url>", "invalid_xml"), ("plain text", "invalid_xml"), ("", "invalid_xml"), ("<!-- only a comment -->", "invalid_xml"), ("<other/>", "unexpected_root"),
]


def parse_errors(spark, sf_dir):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(XML)], "case int, xml string")
    docs = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), (F.col("page_id") % len(XML)).cast("int").alias("case")).join(rows, "case")
    return feeds.parse_errors(docs).select(F.col("doc").alias("page_id"), "error")


FETCH_CAP = 500


def robots_fetches(spark, sf_dir):
    """What fetches of robots.txt mean: by their status, capped in bytes."""
    k = F.col("doc_id") % 5
    status = F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503).when(k == 3, 301)
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("origin"), status.alias("status"), F.coalesce("text", F.lit("")).alias("body"))
    return robots.from_fetches(d, FETCH_CAP).select("origin", F.octet_length("body").cast("long").alias("n_bytes"), text.sha256(F.col("body")).alias("body_hash"), "unavailable")


def policy_entries(spark, sf_dir):
    """Monitors with the entries of their site's policy in order, and an error where there is no policy.

    Entries are written out once a site, before the join, so a monitor costs a copy of the result.
    """
    m = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_nationkey").alias("site"))
    entry = F.struct(F.col("s_suppkey").alias("order_index"), F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string")).alias("fetcher"), F.when(F.col("s_suppkey") % 2 == 0, "timeout").alias("proceed_on"))
    lists = b.table(spark, sf_dir, "supplier").filter("s_nationkey % 6 <> 0").groupBy(F.col("s_nationkey").alias("site")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # a policy's entries: a few fetchers
    shown = F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["fetcher"], x["proceed_on"])), ",")
    return m.join(lists.select("site", shown.alias("entries")), "site", "left").select("monitor_id", "entries", F.when(F.col("entries").isNull(), "fetcher_policy_missing").alias("error"))


def monitor_cascade_all(spark, sf_dir):
    """Rows left in all nine relations after the monitors of one site went."""
    m = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_nationkey").alias("site_id"))
    c = b.changes(spark, sf_dir).select("change_id", "monitor_id")
    a = b.attempts(spark, sf_dir)
    jobs = a.select(F.col("attempt_id").alias("job_id"), F.col("origin_id").alias("monitor_id"))
    relation = {
        "monitors": m,
        "subscriptions": b.subscriptions(spark, sf_dir).select("subscription_id", "monitor_id"),
        "targets": b.page_links(spark, sf_dir).select((F.col("page_id") * 1000 + F.col("pos")).alias("target_id"), F.col("page_id").alias("monitor_id")),
        "snapshots": b.captures(spark, sf_dir).select((F.col("monitor_id") * 10 + F.col("round")).alias("snapshot_id"), "monitor_id"),
        "changes": c,
        "deliveries": b.deliveries(spark, sf_dir).select((F.col("change_id") * 8 + F.col("line")).alias("delivery_id"), "change_id"),
        "jobs": jobs,
        "attempts": jobs.select((F.col("job_id") * 2).alias("attempt_id"), "job_id"),
        "states": m.select("monitor_id", (F.col("monitor_id") + 1).alias("state_id")),
    }
    parents = {"subscriptions": ("monitors", "monitor_id"), "targets": ("monitors", "monitor_id"), "snapshots": ("monitors", "monitor_id"), "changes": ("monitors", "monitor_id"), "deliveries": ("changes", "change_id"), "jobs": ("monitors", "monitor_id"), "attempts": ("jobs", "job_id"), "states": ("monitors", "monitor_id")}
    own = {"monitors": "monitor_id", "subscriptions": "subscription_id", "targets": "target_id", "snapshots": "snapshot_id", "changes": "change_id", "deliveries": "delivery_id", "jobs": "job_id", "attempts": "attempt_id", "states": "state_id"}
    left = transitions.cascade(relation, m.filter("site_id = 3"), "monitors", "monitor_id", parents, own)
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in left.items()]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def archive_subscriptions(spark, sf_dir):
    """Subscriptions left after destinations were archived: those of archived ones go, deliveries stay."""
    gone = b.destinations(spark, sf_dir).filter("destination_id % 3 = 0").select("destination_id")
    return keyed.without(b.subscriptions(spark, sf_dir), gone, ["destination_id"]).select("subscription_id", "destination_id")


def monitor_timers(spark, sf_dir):
    """Timers after events as commands: clicks schedule, signups pause, errors defer, purchases stop, the rest resumes."""
    m = b.monitors(spark, sf_dir).select("monitor_id", "status", F.unix_timestamp("next_run_at").alias("next_run_at"))
    kind, at = F.col("event_type"), F.unix_timestamp("ts")
    command = F.when(kind == "click", "schedule").when(kind == "signup", "pause").when(kind == "error", "deferred").when(kind == "purchase", "policy_stopped").otherwise("resume")
    later = F.when((kind == "error") | (F.col("event_id") % 3 != 0), at + F.when(kind == "error", 60).otherwise(3600))
    commands = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("monitor_id"), F.col("event_id").alias("seq"), command.alias("command"), at.alias("at"), later.alias("next_at"))
    return transitions.timers(m, commands)


_AD = """regexp_replace(body, '<div class="ad">[^<]*</div>', '', 'g')"""
_TEXTS = _HASHED.replace(f"regexp_replace(body, '{_R}', '', 'g') AS kept", f"regexp_replace({_AD}, '{_R}', '', 'g') AS kept").replace("SELECT monitor_id, round,", f"SELECT monitor_id, round, {block_text_sql('clean')} AS extracted_text,")
_ARTICLE = _HASHED.replace(f"regexp_replace(body, '{_R}', '', 'g') AS kept", f"regexp_replace(regexp_extract(body, '(?s)<article>.*</article>'), '{_R}', '', 'g') AS kept")
_WALK = f"""n AS (SELECT n_nationkey AS site, 'https://n' || n_nationkey || '.example' AS origin, n_nationkey % 10 = 9 AS base FROM nation),
l0 AS (SELECT site, origin, base, s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 'https://elsewhere.example' ELSE origin END || CASE WHEN s_suppkey % 7 = 0 THEN '/t' ELSE '/s' END || s_suppkey || '.xml' AS loc,
  CASE WHEN s_suppkey % 11 <> 0 THEN '2024-01-' || (10 + s_suppkey % 10) END AS lastmod, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'sitemap-index' ELSE 'sitemap' END AS kind FROM supplier JOIN n ON site = s_nationkey),
e0 AS (SELECT *, CASE WHEN lastmod IS NULL THEN 'missing_lastmod' WHEN lastmod < '{CUTOFF}' THEN 'old' WHEN k % 7 = 0 THEN 'excluded' END AS early FROM l0),
r0 AS (SELECT *, row_number() OVER (PARTITION BY site, early IS NULL ORDER BY lastmod DESC, k) AS rk FROM e0),
g0 AS (SELECT *, coalesce(early, CASE WHEN rk > {CHILDREN} THEN 'truncated' WHEN k % 13 = 0 THEN 'other_origin' WHEN base THEN 'recorded' WHEN k % 3 = 0 AND lastmod <= '2024-01-15' THEN 'unchanged' END) AS st FROM r0),
l1 AS (SELECT site, base, g0.rk AS prk, g0.loc AS parent, c_custkey AS c, origin || '/c' || c_custkey || '-' || k || '.xml' AS loc, '2024-01-' || (10 + c_custkey % 10) AS lastmod, CASE WHEN c_custkey % 3 = 0 THEN 'sitemap-index' ELSE 'sitemap' END AS kind
  FROM g0 JOIN customer ON st IS NULL AND kind = 'sitemap-index' AND c_nationkey = site AND c_custkey % 7 = k % 7),
e1 AS (SELECT *, CASE WHEN lastmod < '{CUTOFF}' THEN 'old' END AS early FROM l1),
r1 AS (SELECT *, row_number() OVER (PARTITION BY parent, early IS NULL ORDER BY lastmod DESC, c) AS rk FROM e1),
g1 AS (SELECT *, coalesce(early, CASE WHEN rk > {CHILDREN} THEN 'truncated' WHEN base THEN 'recorded' END) AS st FROM r1),
u AS (SELECT site, 0 AS level, origin || '/index.xml' AS parent, loc, lastmod, kind, st, rk AS a, 0 AS z FROM g0 UNION ALL SELECT site, 1, parent, loc, lastmod, kind, st, prk, rk FROM g1),
t AS (SELECT *, CASE WHEN st IS NULL THEN row_number() OVER (PARTITION BY site, st IS NULL ORDER BY a, z) END AS turn FROM u),
w AS (SELECT site, level, parent, loc, lastmod, kind, a, z, coalesce(st, CASE WHEN turn > {FETCHES} THEN 'over_budget' WHEN kind IS NULL THEN 'failed' WHEN level = 1 AND kind = 'sitemap-index' THEN 'too_deep' ELSE 'opened' END) AS state
  FROM t WHERE level = 0 OR parent IN (SELECT loc FROM t WHERE level = 0 AND turn <= {FETCHES})),
i AS (SELECT loc AS parent, CASE WHEN o_orderkey % 4 <> 0 THEN '2024-01-' || (10 + o_orderkey % 10) END AS updated_at FROM l0 JOIN orders ON o_custkey = k),
m AS (SELECT parent, count(*) FILTER (WHERE updated_at IS NULL) AS undated, greatest(count(*) FILTER (WHERE updated_at >= '{CUTOFF}') - {ITEMS}, 0) AS over FROM i GROUP BY parent)"""
_XML = ", ".join(f"({i}, {f"'{e}'" if e else 'NULL::VARCHAR'})" for i, (_, e) in enumerate(XML))
QUERIES = {
    "page_check": (
        page_check_run,
        f"""WITH h AS ({_TEXTS}), p AS (SELECT n.monitor_id, n.extracted_text AS new_text, CASE WHEN o.monitor_id % 6 <> 0 OR EXISTS (SELECT 1 FROM h x WHERE x.round = 1 AND x.monitor_id % 6 <> 0 AND x.text_hash = o.text_hash) THEN o.extracted_text ELSE '' END AS old_text,
  CASE WHEN o.raw_hash <> n.raw_hash AND o.normalized_hash <> n.normalized_hash THEN CASE WHEN o.text_hash = n.text_hash THEN 'normalized_hash' ELSE 'text_hash' END END AS level, n.normalized_hash, n.text_hash
  FROM h n JOIN h o ON o.monitor_id = n.monitor_id AND o.round = 1 WHERE n.round = 2),
l AS (SELECT monitor_id, unnest(string_split(new_text, chr(10))) AS line, 1 AS n FROM p UNION ALL SELECT monitor_id, unnest(string_split(old_text, chr(10))), -1 FROM p),
d AS (SELECT monitor_id, sum(greatest(n, 0)) AS added, sum(greatest(-n, 0)) AS removed FROM (SELECT monitor_id, line, sum(n) AS n FROM l GROUP BY ALL) GROUP BY monitor_id),
r AS (SELECT p.monitor_id, level, CASE WHEN level = 'text_hash' THEN text_hash WHEN level IS NOT NULL THEN normalized_hash END AS dedupe_key, NOT (p.monitor_id % 4 = 1 AND level = 'text_hash') AS fresh, added, removed FROM p JOIN d USING (monitor_id)),
s AS (SELECT r.monitor_id, count(DISTINCT destination_id) AS n FROM r JOIN {b.SUBSCRIPTIONS} s ON kind IS NULL AND coalesce(s.monitor_id, r.monitor_id) = r.monitor_id AND coalesce(s.site_id, r.monitor_id % 25) = r.monitor_id % 25 WHERE level IS NOT NULL AND fresh GROUP BY ALL)
SELECT monitor_id, level, dedupe_key, CASE WHEN level IS NOT NULL THEN fresh END AS inserted, CASE WHEN level IS NOT NULL THEN added::BIGINT END AS added, CASE WHEN level IS NOT NULL THEN removed::BIGINT END AS removed, coalesce(n, 0) AS n_deliveries FROM r LEFT JOIN s USING (monitor_id)""",
    ),
    "include_region": (include_region, f"SELECT monitor_id, round, normalized_hash, text_hash FROM ({_ARTICLE})"),
    "page_items_check": (
        page_items_check,
        """WITH l AS (SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a href="([^"]*)"', 1) AS l FROM pages)),
i AS (SELECT page_id, href, min(pos) AS pos FROM l GROUP BY ALL), n AS (SELECT page_id, count(*) AS n_items, count(*) FILTER (WHERE page_id % 4 = 0 OR pos % 2 <> 0) AS fresh, bool_or(page_id % 4 <> 0 AND pos % 2 = 0) AS checked FROM i GROUP BY page_id)
SELECT page_id AS monitor_id, sha256(html) AS body_hash, coalesce(n_items, 0) AS n_items, CASE WHEN checked THEN fresh ELSE 0 END AS n_new, CASE WHEN checked THEN 0 ELSE coalesce(fresh, 0) END AS n_suppressed FROM pages LEFT JOIN n USING (page_id)""",
    ),
    "feed_check": (
        feed_check,
        f"""WITH i AS (SELECT page_id, href, min(pos) AS pos FROM {b.LINKS} WHERE page_id % 7 <> 0 GROUP BY ALL)
SELECT i.page_id AS monitor_id, any_value(sha256(xml)) AS body_hash, count(*) AS n_items, count(*) FILTER (WHERE i.page_id % 4 <> 0 AND pos % 2 <> 0) AS n_new, count(*) FILTER (WHERE i.page_id % 4 = 0) AS n_suppressed
FROM i JOIN (SELECT page_id, '<?xml version=''1.0''?><rss version=''2.0''><channel><title>t</title>' || string_agg('<item><title>x</title><link>https://x.org' || replace(href, '&', '&amp;') || '</link></item>', '' ORDER BY pos) || '</channel></rss>' AS xml FROM {b.LINKS} GROUP BY page_id) x ON x.page_id = i.page_id GROUP BY i.page_id""",
    ),
    "robots_check": (
        robots_check,
        """WITH t AS (SELECT c_custkey, c_nationkey AS n, CAST(c_custkey AS VARCHAR) AS s, c_nationkey % 3 = 0 AS cached FROM customer),
u AS (SELECT *, CASE WHEN cached THEN n % 2 = 1 ELSE n % 5 IN (2, 3, 4) END AS closed FROM t)
SELECT c_custkey, CASE WHEN closed THEN 'disallowed' WHEN cached THEN CASE WHEN s LIKE '1%' THEN 'disallowed' ELSE 'allowed' END WHEN n % 5 = 1 THEN 'allowed' WHEN s LIKE '2%' THEN 'allowed' ELSE 'disallowed' END AS verdict,
 CASE WHEN closed THEN 'unavailable' WHEN cached THEN '*' WHEN n % 5 = 1 THEN 'none' ELSE 'tidebot' END AS agent_group,
 CASE WHEN closed THEN NULL WHEN cached THEN CASE WHEN s LIKE '1%' THEN 'disallow: /c/1' END WHEN n % 5 = 1 THEN NULL WHEN s LIKE '2%' THEN 'allow: /c/2' ELSE 'disallow: /c' END AS matched_rule, cached AS from_cache, closed AS unavailable FROM u""",
    ),
    "traversal_walk": (traversal_walk, f"WITH {_WALK} SELECT site AS site_id, parent, loc, level::BIGINT AS level, state FROM w"),
    "traversal_all_counters": (
        traversal_all_counters,
        f"""WITH {_WALK}, c AS (SELECT w.site, coalesce(sum(undated), 0) AS undated, coalesce(sum(over), 0) AS over FROM w LEFT JOIN m ON m.parent = w.loc AND w.state = 'opened' AND w.kind = 'sitemap' GROUP BY ALL)
SELECT site AS site_id, count(*) FILTER (WHERE state = 'truncated') AS children_truncated, count(*) FILTER (WHERE state = 'too_deep') AS depth_truncated, count(*) FILTER (WHERE state = 'other_origin') AS origin_blocked,
 CAST(count(*) FILTER (WHERE state = 'missing_lastmod') + any_value(undated) AS BIGINT) AS missing_lastmod_skipped, CAST(any_value(over) AS BIGINT) AS feed_items_truncated, count(*) FILTER (WHERE state = 'over_budget') AS fetch_budget_truncated,
 count(*) FILTER (WHERE state IN ('opened', 'failed', 'too_deep')) AS fetches_used, count(*) FILTER (WHERE state = 'excluded') AS pattern_excluded FROM w JOIN c USING (site) GROUP BY site""",
    ),
    "traversal_marks": (
        traversal_marks,
        f"""WITH {_WALK}, x AS (SELECT site, a, z FROM w LEFT JOIN m ON m.parent = loc WHERE state IN ('truncated', 'too_deep', 'over_budget') OR m.over > 0)
SELECT site AS site_id, loc, lastmod FROM w WHERE state = 'opened' AND NOT EXISTS (SELECT 1 FROM x WHERE x.site = w.site AND x.a = w.a AND (w.z = 0 OR x.z = w.z))""",
    ),
    "delivery_batch": (
        delivery_batch,
        f"""WITH d AS (SELECT change_id * 8 + line AS k, status, change_id % 7 AS n, claimed_at, destination_id % 4 = 0 AS archived FROM {b.DELIVERIES}),
m AS (SELECT *, k % 3 <> 0 OR k % 5 = 0 AS asked, status = 'pending' OR (status = 'sending' AND claimed_at < TIMESTAMP '1995-12-31 23:55:00') AS free FROM d),
r AS (SELECT *, CASE WHEN asked AND free THEN CASE WHEN archived OR n >= 5 THEN 'dead' WHEN k % 11 = 0 THEN 'retry' ELSE ['delivered', 'delivered', 'retry', 'dead', 'retry'][k % 5 + 1] END END AS r FROM m)
SELECT k AS delivery_id, CASE WHEN r = 'retry' THEN 'failed' ELSE coalesce(r, status) END AS status, n + CASE WHEN r IS NOT NULL AND r <> 'delivered' THEN 1 ELSE 0 END AS attempt_count,
 CASE WHEN r IS NOT NULL THEN '1996-01-01' ELSE strftime(claimed_at, '%Y-%m-%d') END AS claimed_on, CASE WHEN asked THEN CASE WHEN r = 'retry' THEN 'retry' ELSE 'ack' END END AS reply,
 CASE WHEN r = 'retry' AND k % 11 <> 0 AND k % 5 = 2 THEN k % 60 END AS delay_s FROM r""",
    ),
    "blob_read": (
        blob_read,
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS f FROM documents) SELECT doc_id, CASE WHEN f % 3 <> 0 THEN length(t) ELSE 0 END::BIGINT AS n_chars FROM d",
    ),
    "sitemap_index_items": (
        sitemap_index_items,
        f"""WITH l AS (SELECT page_id, site_id, pos, updated_at FROM {b.LINKS} WHERE pos % 4 <> 3)
SELECT page_id, pos, site_id || '/m' || pos % 8 || '.xml' AS url, CASE WHEN pos % 3 <> 0 THEN updated_at || 'T00:00:00.000Z' END AS updated_at FROM l QUALIFY row_number() OVER (PARTITION BY page_id, pos % 8 ORDER BY pos) = 1""",
    ),
    "parse_errors": (parse_errors, f"SELECT page_id, e AS error FROM pages JOIN (VALUES {_XML}) t(c, e) ON page_id % {len(XML)} = c"),
    "robots_fetches": (
        robots_fetches,
        f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS origin, doc_id % 5 NOT IN (0, 1) AS unavailable, hex(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') ELSE '' END) AS h FROM documents),
n AS (SELECT *, least(length(h) // 2, {FETCH_CAP} - CASE WHEN substr(h, {2 * FETCH_CAP + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, {2 * FETCH_CAP - 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, {2 * FETCH_CAP - 3}, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END) AS n_bytes FROM d)
SELECT origin, n_bytes, sha256(unhex(left(h, 2 * n_bytes))) AS body_hash, unavailable FROM n""",
    ),
    "policy_entries": (
        policy_entries,
        """WITH p AS (SELECT s_nationkey, string_agg('f' || s_suppkey % 3 || CASE WHEN s_suppkey % 2 = 0 THEN ':timeout' ELSE '' END, ',' ORDER BY s_suppkey) AS entries FROM supplier WHERE s_nationkey % 6 <> 0 GROUP BY ALL)
SELECT c_custkey AS monitor_id, entries, CASE WHEN entries IS NULL THEN 'fetcher_policy_missing' END AS error FROM customer LEFT JOIN p ON s_nationkey = c_nationkey""",
    ),
    "monitor_cascade_all": (
        monitor_cascade_all,
        f"""WITH g AS (SELECT c_custkey AS m FROM customer WHERE c_nationkey = 3), o AS (SELECT change_id FROM {b.CHANGES} WHERE monitor_id IN (FROM g))
SELECT 'monitors' AS relation, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM g) UNION ALL SELECT 'subscriptions', count(*) FROM {b.SUBSCRIPTIONS} WHERE monitor_id IS NULL OR monitor_id NOT IN (FROM g)
UNION ALL SELECT 'targets', count(*) FROM {b.LINKS} WHERE page_id NOT IN (FROM g) UNION ALL SELECT 'snapshots', count(*) FROM {b.CAPTURES} WHERE monitor_id NOT IN (FROM g)
UNION ALL SELECT 'changes', count(*) FROM {b.CHANGES} WHERE monitor_id NOT IN (FROM g) UNION ALL SELECT 'deliveries', count(*) FROM {b.DELIVERIES} WHERE change_id NOT IN (FROM o)
UNION ALL SELECT 'jobs', count(*) FROM {b.ATTEMPTS} WHERE origin_id NOT IN (FROM g) UNION ALL SELECT 'attempts', count(*) FROM {b.ATTEMPTS} WHERE origin_id NOT IN (FROM g) UNION ALL SELECT 'states', count(*) FROM customer WHERE c_custkey NOT IN (FROM g)""",
    ),
    "archive_subscriptions": (archive_subscriptions, f"SELECT subscription_id, destination_id FROM {b.SUBSCRIPTIONS} WHERE destination_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)"),
    "monitor_timers": (
        monitor_timers,
        f"""WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_type = 'error' THEN floor(epoch(ts))::BIGINT + 60 WHEN event_id % 3 <> 0 THEN floor(epoch(ts))::BIGINT + 3600 END AS later,
  CASE WHEN event_type IN ('click', 'error', 'purchase') THEN NULL WHEN event_type = 'signup' THEN 'paused' ELSE 'active' END AS s FROM events),
l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(t) FILTER (WHERE event_id = m) AS t, max(later) FILTER (WHERE event_id = m) AS later, arg_max(s, event_id) FILTER (WHERE s IS NOT NULL) AS s FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM e) GROUP BY user_id)
SELECT monitor_id, coalesce(s, status) AS status, CASE WHEN kind IS NULL THEN CASE WHEN status <> 'paused' THEN epoch(next_run_at)::BIGINT END WHEN kind IN ('click', 'error') THEN later WHEN kind IN ('signup', 'purchase') THEN NULL ELSE coalesce(epoch(next_run_at)::BIGINT, t) END AS alarm_at
FROM {b.MONITORS} LEFT JOIN l ON user_id = monitor_id""",
    ),
}

"""Stages composed from operators: sitemaps as one document each, titles for new changes, cached rules, monitors with evaluations, timers as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import keyed, relations
from tidemark.operators.tables import shared_folder, written
from tidemark.plans import bindings as b
from tidemark.streaming import ledger, timers

RULES = "groups array<struct<userAgents:array<string>,rules:array<struct<directive:string,pattern:string>>>>, sitemaps array<string>"


def document(items: DataFrame) -> DataFrame:
    """site_id, doc_hash, urls of items (site_id, loc, updated_at), which are distinct: sorted lines, hashed in parts.

    Lines are dealt to 256 parts by the first digits of their hash, so a site of any size is sorted and hashed by many
    tasks and brings 256 hashes to the last one.
    """
    lines = items.select("site_id", F.concat("loc", F.lit("\t"), F.coalesce("updated_at", F.lit("-")), F.lit("\n")).alias("line")).withColumn("part", F.substring(text.sha256(F.col("line")), 1, 2))
    parts = lines.groupBy("site_id", "part").agg(text.sha256(F.array_join(F.array_sort(F.collect_list("line")), "")).alias("h"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "")
    return parts.groupBy("site_id").agg(text.sha256(whole).alias("doc_hash"), F.sum("n").alias("urls"))


def sitemap_check(items: DataFrame, previous: DataFrame, stored: DataFrame) -> DataFrame:
    """site_id, doc_hash, urls, changed, added, removed, title, inserted of a check of whole sitemaps.

    ``items``: site_id, loc, updated_at, pos; of equal places the first counts. ``previous``: site_id, loc, updated_at of the last snapshot. ``stored``: site_id,
    dedupe_key of changes. The hash of the sorted document decides whether anything changed; only then are places compared both
    ways, with their dates, so that a new date is one place added and one removed. The change's key is the hash; one that is stored is
    not inserted. A site without a snapshot is at its baseline and has no change.
    """
    new = written(keyed.first_wins(items.select("site_id", "loc", "updated_at", "pos"), ["site_id", "loc"], ["pos"]).drop("pos"))
    before = document(previous).select("site_id", F.col("doc_hash").alias("old_hash"))
    docs = written(document(new).join(before, "site_id", "left").withColumn("changed", F.coalesce(F.col("doc_hash") != F.col("old_hash"), F.lit(False))))
    moved = docs.filter("changed").select("site_id")
    only = lambda x: x.select("site_id", "loc", F.coalesce("updated_at", F.lit("-")).alias("updated_at")).join(moved, "site_id", "left_semi")
    sides = relations.set_difference(only(previous), only(new), ["site_id", "loc", "updated_at"])
    counts = sides.groupBy("site_id").agg(F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed"))
    known = stored.select("site_id", F.col("dedupe_key").alias("doc_hash")).distinct().withColumn("_k", F.lit(True))
    met = docs.join(counts, "site_id", "left").join(known, ["site_id", "doc_hash"], "left")
    title = F.concat(F.lit("+"), F.col("added").cast("string"), F.lit("/-"), F.col("removed").cast("string"), F.lit(" URL"))
    return met.select("site_id", "doc_hash", "urls", "changed", F.when(F.col("changed"), F.col("added")).alias("added"), F.when(F.col("changed"), F.col("removed")).alias("removed"), F.when(F.col("changed"), title).alias("title"), (F.col("changed") & F.col("_k").isNull()).alias("inserted"))


def enriched(changes: DataFrame, titles: DataFrame, budget: int = 10) -> DataFrame:
    """``changes`` (monitor_id, change_id, inserted, kind, title, url) with titles found for what is newly inserted, new and has none.

    ``titles``: url, title (null where a fetch brought none). A monitor looks at ``budget`` of its candidates, in the order of change_id; the others,
    and those whose look brought nothing, stay without. ``looked`` tells who was looked up.
    """
    wanted = changes.filter(F.col("inserted") & (F.col("kind") == "new") & F.col("title").isNull() & F.col("url").isNotNull())
    chosen = relations.within_budget(wanted.select("monitor_id", "change_id", "url"), ["monitor_id"], ["change_id"], budget)
    found = chosen.join(titles.select("url", F.col("title").alias("_t")), "url", "left").select("change_id", "_t", F.lit(True).alias("_l"))
    met = changes.join(found, "change_id", "left")
    return met.withColumns({"title": F.coalesce("title", "_t"), "looked": F.coalesce("_l", F.lit(False))}).select(*changes.columns, "looked")


def cached_rules(cache: DataFrame) -> DataFrame:
    """origin, unavailable, groups, sitemaps of the newest entries (origin, fetched_at, rules, unavailable); what is no JSON is no rules.

    A damaged or missing text reads as fetched and empty, so that a check goes on and the next fetch mends it.
    """
    last = keyed.latest(cache, ["origin"], ["fetched_at", "rules"])
    read = F.from_json("rules", RULES)
    empty = F.from_json(F.lit('{"groups":[],"sitemaps":[]}'), RULES)
    return last.select("origin", "unavailable", F.coalesce(read["groups"], empty["groups"]).alias("groups"), F.coalesce(read["sitemaps"], empty["sitemaps"]).alias("sitemaps"))


def with_evaluation(monitors: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``monitors`` with the robots evaluation that their robots_evaluation_id names, as a struct; null without one, or where it is gone."""
    named = evaluations.select(F.col("evaluation_id").alias("robots_evaluation_id"), F.struct(*evaluations.columns).alias("robots_evaluation"))
    return monitors.join(named, "robots_evaluation_id", "left")


# ---------------------------------------------------------------- registered queries


def sitemap_direct(spark, sf_dir):
    """Links of sites as sitemaps: some left out before, some now, some with another date; every fifth site is at its baseline."""
    links = b.page_links(spark, sf_dir).select("site_id", F.concat("site_id", "href").alias("loc"), "updated_at", (F.col("page_id") * 1000 + F.col("pos")).alias("pos"), (F.col("page_id") + F.col("pos")).alias("k"))
    one = written(keyed.first_wins(links, ["site_id", "loc"], ["pos"]).withColumn("n", F.length("site_id") % 5))
    previous = one.filter("n <> 0 and (n = 1 or k % 7 <> 0)").select("site_id", "loc", F.when((F.col("n") != 1) & (F.col("k") % 3 == 0), "2023-01-01").otherwise(F.col("updated_at")).alias("updated_at"))
    now = one.filter("n = 1 or k % 5 <> 0").select("site_id", "loc", "updated_at", "pos")
    stored = document(now.filter(F.length("site_id") % 5 == 2).select("site_id", "loc", "updated_at")).select("site_id", F.col("doc_hash").alias("dedupe_key"))
    return sitemap_check(now, previous, stored)


def titles_enriched(spark, sf_dir):
    """Links as changes, some stored before, some updated, some with a title or without a URL; pages give the titles."""
    k = F.col("page_id") * 1000 + F.col("pos")
    c = b.page_links(spark, sf_dir).select(
        F.col("page_id").alias("monitor_id"), k.alias("change_id"), (k % 5 != 0).alias("inserted"), F.when(k % 7 == 0, "updated").otherwise("new").alias("kind"),
        F.when(k % 3 == 0, "known").alias("title"), F.when(k % 11 != 0, ((F.col("page_id") * 3 + F.col("pos")) % 60).cast("string")).alias("url"),
    )
    titles = b.table(spark, sf_dir, "pages").filter("page_id % 4 <> 0").select(F.col("page_id").cast("string").alias("url"), text.title_of(F.col("html")).alias("title"))
    return enriched(c, titles, 2).select("change_id", "title", "looked")


def robots_cache_read(spark, sf_dir):
    """Cached rules of pages' origins: whole, empty, damaged and missing ones."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    whole = F.concat(F.lit('{"groups":[{"userAgents":["*"],"rules":[{"directive":"disallow","pattern":"/a'), n, F.lit('"},{"directive":"allow","pattern":"/"}]},{"userAgents":["x"],"rules":[]}],"sitemaps":["s'), n, F.lit('"]}'))
    rules = F.when(k == 0, whole).when(k == 1, F.substring(whole, 1, 60)).when(k == 2, "not json").when(k == 3, '{"groups":[],"sitemaps":[]}')
    old = lambda at, r: b.table(spark, sf_dir, "pages").select(n.alias("origin"), F.lit(at).cast("timestamp").alias("fetched_at"), r.alias("rules"), (F.col("page_id") % 3 == 0).alias("unavailable"))
    read = cached_rules(old("2024-01-01", F.lit("damaged")).unionByName(old("2024-01-02", rules)))
    return read.select("origin", "unavailable", F.size("groups").cast("long").alias("n_groups"), F.array_join(F.transform(F.flatten(F.transform("groups", lambda g: g["rules"])), lambda r: r["pattern"]), ",").alias("patterns"), F.array_join("sitemaps", ",").alias("sitemaps"))


def monitor_evaluations(spark, sf_dir):
    """Monitors with their last evaluation: some have none, some name one that is gone."""
    m = b.monitors(spark, sf_dir).select("monitor_id", "status", F.when(F.col("monitor_id") % 3 != 0, F.col("monitor_id") * 7 % 400).alias("robots_evaluation_id"))
    e = b.attempts(spark, sf_dir).select(F.col("attempt_id").alias("evaluation_id"), F.when(F.col("ok"), "allowed").otherwise("disallowed").alias("verdict"), "status_code").filter("evaluation_id < 300")
    out = with_evaluation(m, e)
    return out.select("monitor_id", "status", F.col("robots_evaluation.evaluation_id").alias("evaluation_id"), F.col("robots_evaluation.verdict").alias("verdict"), F.col("robots_evaluation.status_code").alias("status_code"))


def timer_stream(spark, sf_dir):
    """Events as a stream of commands to monitors' timers; what each monitor's last command left."""
    kind, at = F.col("event_type"), F.unix_timestamp("ts")
    command = F.when(kind == "click", "schedule").when(kind == "signup", "pause").when(kind == "error", "deferred").when(kind == "purchase", "policy_stopped").otherwise("resume")
    later = F.when((kind == "error") | (F.col("event_id") % 3 != 0), at + F.when(kind == "error", 60).otherwise(3600))
    stored = b.monitors(spark, sf_dir).select("monitor_id", F.unix_timestamp("next_run_at").alias("next_run_at"))
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("monitor_id"), F.col("event_id").alias("seq"), command.alias("command"), at.alias("at"), later.alias("next_at"), F.col("ts").cast("timestamp").alias("ts")).join(stored, "monitor_id", "left")
    where = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}"
    rows.write.parquet(f"{where}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in").withWatermark("ts", "0 seconds")
    timers.monitor_timers(stream).writeStream.format("parquet").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    told = spark.read.parquet(f"{where}/out").filter("event = 'set'")
    return told.groupBy("monitor_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("status", "alarm_at"), "seq").alias("x")).select("monitor_id", "seq", "x.status", "x.alarm_at")


def notify_stream(spark, sf_dir):
    """Orders as a stream of changes into changes, deliveries and watermarks of one ledger; a second stream of the same adds nothing."""
    where = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}"
    changes = b.changes(spark, sf_dir).select("change_id", "monitor_id", (F.col("monitor_id") % 25).cast("long").alias("site_id"), "kind", "dedupe_key", "detected_at")
    changes.write.parquet(f"{where}/in")
    book = ledger.Ledger(spark, f"{where}/tables", ledger.TABLES, buckets=16)
    owners = relations.broadest(b.subscriptions(spark, sf_dir), "destination_id")
    match = lambda new: relations.wildcard_match(new, owners).select("change_id", "destination_id")
    for name in ("first", "second"):
        ledger.notify(spark.readStream.schema(changes.schema).parquet(f"{where}/in"), book, match, name, f"{where}/{name}").awaitTermination()
    told = book.read("changes").join(book.read("deliveries").groupBy("change_id").agg(F.count("*").alias("n")), "change_id", "left")
    told = told.groupBy("monitor_id").agg(F.count("*").alias("changes"), F.coalesce(F.sum("n"), F.lit(0)).alias("deliveries"))
    marks = book.read("watermarks").groupBy("monitor_id").agg(F.max("mark").alias("mark"))
    return told.join(marks, "monitor_id").select("monitor_id", "changes", "deliveries", F.date_format("mark", "yyyy-MM-dd").alias("mark"))


_DOC = "SELECT site_id, sha256(string_agg(h, '' ORDER BY part)) AS h, CAST(sum(n) AS BIGINT) AS urls FROM (SELECT site_id, substr(sha256(line), 1, 2) AS part, sha256(string_agg(line, '' ORDER BY line)) AS h, count(*) AS n FROM (SELECT site_id, loc || chr(9) || updated_at || chr(10) AS line FROM {}) GROUP BY ALL) GROUP BY site_id"
_TITLE = r"nullif(left(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 512), '')"
QUERIES = {
    "sitemap_direct": (
        sitemap_direct,
        f"""WITH o AS (SELECT site_id, site_id || href AS loc, updated_at, page_id + pos AS k, length(site_id) % 5 AS n FROM {b.LINKS} QUALIFY row_number() OVER (PARTITION BY site_id, href ORDER BY page_id * 1000 + pos) = 1),
a AS (SELECT site_id, loc, CASE WHEN n <> 1 AND k % 3 = 0 THEN '2023-01-01' ELSE updated_at END AS updated_at FROM o WHERE n <> 0 AND (n = 1 OR k % 7 <> 0)),
z AS (SELECT site_id, loc, updated_at FROM o WHERE n = 1 OR k % 5 <> 0), da AS ({_DOC.format("a")}), dz AS ({_DOC.format("z")}),
m AS (SELECT dz.*, coalesce(da.h <> dz.h, false) AS changed, length(site_id) % 5 = 2 AS stored FROM dz LEFT JOIN da USING (site_id)),
c AS (SELECT site_id, sum(p) AS added, sum(r) AS removed FROM (SELECT site_id, 1 AS p, 0 AS r FROM (FROM z EXCEPT FROM a) UNION ALL SELECT site_id, 0, 1 FROM (FROM a EXCEPT FROM z)) GROUP BY ALL)
SELECT m.site_id, h AS doc_hash, urls, changed, CASE WHEN changed THEN added::BIGINT END AS added, CASE WHEN changed THEN removed::BIGINT END AS removed, CASE WHEN changed THEN '+' || added || '/-' || removed || ' URL' END AS title, changed AND NOT stored AS inserted FROM m LEFT JOIN c USING (site_id)""",
    ),
    "titles_enriched": (
        titles_enriched,
        f"""WITH c AS (SELECT page_id, pos, page_id * 1000 + pos AS k FROM {b.LINKS}), d AS (SELECT *, k % 5 <> 0 AND k % 7 <> 0 AND k % 3 <> 0 AND k % 11 <> 0 AS w FROM c),
e AS (SELECT *, w AND row_number() OVER (PARTITION BY page_id, w ORDER BY k) <= 2 AS looked FROM d)
SELECT k AS change_id, CASE WHEN k % 3 = 0 THEN 'known' ELSE {_TITLE} END AS title, looked FROM e LEFT JOIN pages p ON looked AND p.page_id = (e.page_id * 3 + pos) % 60 AND p.page_id % 4 <> 0""",
    ),
    "robots_cache_read": (
        robots_cache_read,
        """SELECT page_id::VARCHAR AS origin, page_id % 3 = 0 AS unavailable, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS n_groups, CASE WHEN page_id % 5 = 0 THEN '/a' || page_id || ',/' ELSE '' END AS patterns, CASE WHEN page_id % 5 = 0 THEN 's' || page_id ELSE '' END AS sitemaps FROM pages""",
    ),
    "monitor_evaluations": (
        monitor_evaluations,
        f"""SELECT monitor_id, status, attempt_id AS evaluation_id, CASE WHEN ok THEN 'allowed' WHEN NOT ok THEN 'disallowed' END AS verdict, status_code FROM {b.MONITORS}
LEFT JOIN {b.ATTEMPTS} ON attempt_id < 300 AND monitor_id % 3 <> 0 AND attempt_id = monitor_id * 7 % 400""",
    ),
    "notify_stream": (
        notify_stream,
        f"""WITH c AS (SELECT *, monitor_id % 25 AS site FROM {b.CHANGES}), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY monitor_id, dedupe_key ORDER BY detected_at, change_id) = 1),
d AS (SELECT o.change_id, count(DISTINCT destination_id) AS n FROM o JOIN {b.SUBSCRIPTIONS} s ON coalesce(s.monitor_id, o.monitor_id) = o.monitor_id AND coalesce(s.site_id, site) = site AND coalesce(s.kind, o.kind) = o.kind GROUP BY ALL)
SELECT monitor_id, changes, deliveries, mark FROM (SELECT monitor_id, count(*) AS changes, CAST(coalesce(sum(n), 0) AS BIGINT) AS deliveries FROM o LEFT JOIN d USING (change_id) GROUP BY ALL)
JOIN (SELECT monitor_id, strftime(max(detected_at), '%Y-%m-%d') AS mark FROM c GROUP BY ALL) USING (monitor_id)""",
    ),
    "timer_stream": (
        timer_stream,
        f"""WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_type = 'error' THEN floor(epoch(ts))::BIGINT + 60 WHEN event_id % 3 <> 0 THEN floor(epoch(ts))::BIGINT + 3600 END AS later,
  CASE WHEN event_type IN ('click', 'error', 'purchase') THEN NULL WHEN event_type = 'signup' THEN 'paused' ELSE 'active' END AS s FROM events),
l AS (SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS kind, arg_max({{'t': t, 'l': later}}, event_id) AS x, arg_max(s, event_id) FILTER (WHERE s IS NOT NULL) AS s FROM e GROUP BY user_id)
SELECT user_id AS monitor_id, seq, s AS status, CASE WHEN kind IN ('click', 'error') THEN x.l WHEN kind IN ('signup', 'purchase') THEN NULL ELSE coalesce(epoch(next_run_at)::BIGINT, x.t) END AS alarm_at FROM l LEFT JOIN {b.MONITORS} ON user_id = monitor_id""",
    ),
}

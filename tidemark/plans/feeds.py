"""Feeds and sitemaps: items, new and updated ones, baselines, caps, gated traversal, URL-set documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, network, text, urls
from tidemark.operators import relations
from tidemark.operators.keyed import first_wins
from tidemark.plans import bindings as b
from tidemark.plans.stages import document
from tidemark.sources import charsets, feeds, pages


def detected(items: DataFrame, known: DataFrame, most: int = 2000) -> DataFrame:
    """New and updated items of checks: monitor_id, stable_key, kind, dedupe_key, suppressed.

    ``items``: monitor_id, pos, stable_key, url, updated_at. ``known``: monitor_id, stable_key, known_at. The first
    ``most`` items of a check in document order count; items without a URL or with a refused one are skipped.
    A monitor without any known target is at its baseline: its items are recorded but suppressed.
    """
    capped = relations.within_budget(items, ["monitor_id"], ["pos"], most)
    safe = capped.filter(F.col("url").isNotNull() & network.url_check(F.col("url")).isNull())
    one = first_wins(safe, ["monitor_id", "stable_key"], ["pos"])
    seen = known.select("monitor_id").distinct().withColumn("checked", F.lit(True))
    met = one.join(known, ["monitor_id", "stable_key"], "left").join(seen, "monitor_id", "left")
    old = F.col("known_at").isNotNull()
    changed = F.col("updated_at").isNotNull() & (F.col("updated_at") != F.col("known_at"))
    return met.filter(~old | changed).select(
        "monitor_id", "stable_key", F.when(old, "updated").otherwise("new").alias("kind"), F.when(old, F.concat_ws(":", "stable_key", "updated_at")).otherwise(F.col("stable_key")).alias("dedupe_key"), F.col("checked").isNull().alias("suppressed")
    )


def _xml(spark, sf_dir, head: str, each, foot: str):
    """One document per page, its links written as items in order."""
    links = b.page_links(spark, sf_dir)
    items = links.groupBy("page_id", "site_id").agg(F.array_sort(F.collect_list(F.struct("pos", each(F.replace(F.col("href"), F.lit("&"), F.lit("&amp;"))).alias("x")))).alias("l"))
    return items.select(F.col("page_id").alias("doc"), F.concat("site_id", F.lit("/")).alias("base_url"), F.concat(F.lit(head), F.array_join(F.col("l.x"), ""), F.lit(foot)).alias("xml"))


def rss_items(spark, sf_dir):
    docs = _xml(spark, sf_dir, "<?xml version='1.0'?><rss version='2.0'><channel><title>t</title>", lambda h: F.concat(F.lit("<item><title> x </title><link>https://x.org"), h, F.lit("</link><pubDate>Wed, 02 Oct 2002 08:00:0"), (F.col("pos") % 10).cast("string"), F.lit(" EST</pubDate></item>")), "</channel></rss>")
    return feeds.rss_items(docs).select(F.col("doc").alias("page_id"), "pos", "url", "title", "published_at")


def feed_bytes(spark, sf_dir):
    """Items of feeds that came as bytes: UTF-16 by its mark, Latin-1 by the declaration or by the header, UTF-8 by nothing."""
    k, xml = F.col("doc") % 5, F.col("xml")
    docs = _xml(spark, sf_dir, "<rss version='2.0'><channel><title>t</title>", lambda h: F.concat(F.lit("<item><title>h\u00e9 "), F.col("pos").cast("string"), F.lit("</title><link>https://x.org"), h, F.lit("</link></item>")), "</channel></rss>")
    narrow = xml.rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    put = lambda mark, charset: F.concat(F.lit(mark), F.encode(xml, charset))
    body = (
        F.when(k == 0, put(b"\xff\xfe", "UTF-16LE")).when(k == 1, put(b"\xfe\xff", "UTF-16BE"))
        .when((k == 2) & narrow, put(b'<?xml version="1.0" encoding="ISO-8859-1"?>', "ISO-8859-1")).when((k == 3) & narrow, put(b'<?xml version="1.0" encoding="utf-8"?>', "ISO-8859-1"))
        .otherwise(F.encode(xml, "UTF-8"))
    )
    header = F.when(k == 0, "application/xml; charset=utf-8").when((k == 3) & narrow, "text/xml; charset=windows-1252")
    sent = docs.select("doc", body.alias("body"), pages.charset_of(header).alias("header"))
    return feeds.rss_items(charsets.xml_text(sent, "body", F.col("header"))).select(F.col("doc").alias("page_id"), "pos", "url", "title")


def atom_items(spark, sf_dir):
    docs = _xml(spark, sf_dir, "<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title>", lambda h: F.concat(F.lit("<entry><title>x</title><id>id"), (F.col("pos") % 5).cast("string"), F.lit("</id><link rel='self' href='/self'/><link href='"), F.replace(h, F.lit("'"), F.lit("")), F.lit("'/><updated>2024-02-02T03:04:05+09:00</updated></entry>")), "</feed>")
    return feeds.atom_items(docs).select(F.col("doc").alias("page_id"), "pos", "stable_key", "updated_at", F.col("url").startswith("http").alias("absolute"))


def sitemap_items(spark, sf_dir):
    docs = _xml(spark, sf_dir, "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>", lambda h: F.concat(F.lit("<url><loc>  /p"), (F.col("pos") % 4).cast("string"), F.lit(" </loc><lastmod>"), F.col("updated_at"), F.lit("</lastmod></url>")), "</urlset>")
    return feeds.sitemap_items(docs).select(F.col("doc").alias("page_id"), "pos", "url", "updated_at")


def feed_kind(spark, sf_dir):
    k = F.col("page_id") % 5
    x = F.when(k == 0, "<?xml version='1.0'?>\n<!-- c --><rss/>").when(k == 1, "<feed xmlns='a'/>").when(k == 2, "<urlset/>").when(k == 3, "<x:sitemapindex xmlns:x='a'/>").otherwise(F.col("html"))
    return b.table(spark, sf_dir, "pages").select("page_id", feeds.feed_kind(x).alias("kind"))


def _items(spark, sf_dir):
    return b.page_links(spark, sf_dir).select(F.col("page_id").alias("monitor_id"), "pos", F.col("href").alias("stable_key"), F.concat("site_id", "href").alias("url"), "updated_at")


def feed_new_updated(spark, sf_dir):
    items = _items(spark, sf_dir)
    known = first_wins(items.filter("monitor_id % 4 <> 0 and pos % 2 = 0").select("monitor_id", "stable_key", F.when(F.col("pos") % 4 == 0, F.col("updated_at")).otherwise("2023-01-01").alias("known_at"), "pos"), ["monitor_id", "stable_key"], ["pos"]).drop("pos")
    return detected(items, known)


def items_capped(spark, sf_dir):
    return relations.within_budget(_items(spark, sf_dir), ["monitor_id"], ["pos"], 3).groupBy("monitor_id").agg(F.count("*").alias("kept"), F.max("pos").alias("last_pos"))


def rfc822_dates(spark, sf_dir):
    k = F.col("event_id")
    zone = F.element_at(F.array(*[F.lit(x) for x in ("EST", "GMT", "+0900", "-0130", "XYZ")]), (k % 5 + 1).cast("int"))
    day = F.lpad((k % 32).cast("string"), 2, "0")
    s = F.concat(F.lit("Wed, "), day, F.lit(" Jan 2002 "), F.lpad((k % 25).cast("string"), 2, "0"), F.lit(":10:20 "), zone)
    return b.table(spark, sf_dir, "events").select("event_id", dates.rfc822(s).alias("iso"))


def written_dates(spark, sf_dir):
    """Times of events written out in words, with slashes, and as no date at all."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    f = lambda pattern: F.date_format(t, pattern)
    text = F.when(k == 0, f("MMMM d, yyyy HH:mm:ss")).when(k == 1, f("EEEE, d MMM yyyy")).when(k == 2, f("yyyy/MM/dd HH:mm 'GMT+0900'")).when(k == 3, f("MM/dd/yyyy h:mma")).when(k == 4, f("MMM d yyyy HH:mm:ss 'EST'")).otherwise(f("'soon,' d MMM yyyy"))
    return b.table(spark, sf_dir, "events").select("event_id", dates.feed_date(text).alias("iso"))


def iso_dates(spark, sf_dir):
    k = F.col("event_id")
    s = F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, "not a date").when(k % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
    return b.table(spark, sf_dir, "events").select("event_id", dates.iso(s).alias("iso"))


def child_select(spark, sf_dir):
    """Children of each site's index: dated after the cutoff, file name by glob, then the 3 newest."""
    c = _children(spark, sf_dir).filter((F.col("lastmod") >= "2024-01-12") & urls.glob_match(F.lit("page-*.xml"), F.element_at(F.split("loc", "/"), -1), prefix=False))
    return relations.within_budget(c, ["site_id"], [F.col("lastmod").desc(), "page_id"], 3).select("site_id", "page_id", "lastmod")


def _children(spark, sf_dir):
    ext = F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".xml")
    return b.table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("site_id"), F.concat(urls.origin(F.col("url")), F.lit("/page-"), F.col("page_id").cast("string"), ext).alias("loc"), F.concat(F.lit("2024-01-"), (10 + F.col("page_id") % 10).cast("string")).alias("lastmod"))


def traversal(spark, sf_dir, budget: int = 5, children: int = 20, cutoff: str = "2024-01-13"):
    """Depth-first walk site -> child -> link: unchanged branches are not opened, fetches stop at the budget of each site.

    A branch is read if it is newer than the site's watermark; the order of fetches is that of children by
    date, so a running number per site is the budget spent. Joins per level, no driver loop over rows.
    """
    marks = b.table(spark, sf_dir, "pages").groupBy(urls.origin(F.col("url")).alias("site_id")).agg(F.concat(F.lit("2024-01-"), (10 + F.min("page_id") % 5).cast("string")).alias("mark"))
    opened = relations.within_budget(_children(spark, sf_dir).join(marks, "site_id").filter("lastmod > mark"), ["site_id"], [F.col("lastmod").desc(), "page_id"], min(budget, children))
    return opened.select("site_id", "page_id", "lastmod", "mark"), b.page_links(spark, sf_dir).filter(F.col("updated_at") >= cutoff)


def traversal_recursive(spark, sf_dir):
    opened, links = traversal(spark, sf_dir)
    return opened.join(links.select("page_id", "pos", "updated_at"), "page_id").select("site_id", "page_id", "pos", "updated_at")


def traversal_counters(spark, sf_dir):
    c = _children(spark, sf_dir)
    opened, links = traversal(spark, sf_dir)
    old = b.page_links(spark, sf_dir).join(opened.select("page_id"), "page_id", "left_semi").groupBy("site_id").agg(F.count_if(F.col("updated_at") < "2024-01-13").alias("too_old"), F.count_if(F.col("updated_at") >= "2024-01-13").alias("taken"))
    n = c.groupBy("site_id").agg(F.count("*").alias("children"))
    o = opened.groupBy("site_id").agg(F.count("*").alias("opened"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return n.join(o, "site_id", "left").join(old, "site_id", "left").select("site_id", "children", zero("opened"), zero("too_old"), zero("taken"))


def sitemap_document(spark, sf_dir):
    """The sorted distinct URLs of each site with their dates, as one hash: of the hashes of its lines' parts."""
    one = first_wins(b.page_links(spark, sf_dir).withColumn("loc", F.concat("site_id", "href")).select("site_id", "loc", "updated_at", "page_id", "pos"), ["site_id", "loc"], ["page_id", "pos"])
    return document(one)


def sitemap_set_diff(spark, sf_dir):
    links = b.page_links(spark, sf_dir).select("page_id", "pos", "href")
    k = F.col("page_id") + F.col("pos")
    return relations.set_difference(links.filter(k % 7 != 0).drop("pos"), links.filter(k % 5 != 0).drop("pos"), ["page_id", "href"])


def title_enrich_budget(spark, sf_dir):
    """Titles looked up for the first two items of each monitor; the rest stay without."""
    items = _items(spark, sf_dir)
    chosen = relations.within_budget(items, ["monitor_id"], ["pos"], 2).select("monitor_id", "pos", ((F.col("monitor_id") * 3 + F.col("pos")) % 50).alias("page_id"))
    titles = b.table(spark, sf_dir, "pages").select("page_id", text.title_of(F.col("html")).alias("title"))
    return items.select("monitor_id", "pos").join(chosen.join(titles, "page_id", "left").drop("page_id"), ["monitor_id", "pos"], "left")


_DET = f"""WITH l AS (SELECT page_id AS monitor_id, pos, href AS stable_key, updated_at FROM {b.LINKS}), i AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY monitor_id, stable_key ORDER BY pos) = 1),
k AS (SELECT monitor_id, stable_key, CASE WHEN pos % 4 = 0 THEN updated_at ELSE '2023-01-01' END AS known_at FROM l WHERE monitor_id % 4 <> 0 AND pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY monitor_id, stable_key ORDER BY pos) = 1)
SELECT monitor_id, stable_key, CASE WHEN known_at IS NULL THEN 'new' ELSE 'updated' END AS kind, CASE WHEN known_at IS NULL THEN stable_key ELSE stable_key || ':' || updated_at END AS dedupe_key,
  monitor_id NOT IN (SELECT monitor_id FROM k) AS suppressed FROM i LEFT JOIN k USING (monitor_id, stable_key) WHERE known_at IS NULL OR known_at <> updated_at"""
_ORIGIN = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
_CHILD = f"(SELECT page_id, {_ORIGIN} AS site_id, page_id % 3 <> 0 AS xml, '2024-01-' || (10 + page_id % 10) AS lastmod FROM pages)"
_OPENED = f"""o AS (SELECT c.site_id, page_id, lastmod FROM {_CHILD} c JOIN (SELECT {_ORIGIN} AS site_id, '2024-01-' || (10 + min(page_id) % 5) AS mark FROM pages GROUP BY 1) m ON m.site_id = c.site_id AND lastmod > mark
  QUALIFY row_number() OVER (PARTITION BY c.site_id ORDER BY lastmod DESC, page_id) <= 5)"""
QUERIES = {
    "rss_items": (rss_items, f"""SELECT page_id, pos, 'https://x.org' || href AS url, 'x' AS title, '2002-10-02T13:00:0' || pos % 10 || '.000Z' AS published_at FROM {b.LINKS} QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1"""),
    "feed_bytes": (feed_bytes, f"""SELECT page_id, pos, 'https://x.org' || href AS url, 'hé ' || pos AS title FROM {b.LINKS} QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1"""),
    "atom_items": (atom_items, f"SELECT page_id, pos, 'id' || pos % 5 AS stable_key, '2024-02-01T18:04:05.000Z' AS updated_at, true AS absolute FROM {b.LINKS} QUALIFY row_number() OVER (PARTITION BY page_id, pos % 5 ORDER BY pos) = 1"),
    "sitemap_items": (sitemap_items, f"SELECT page_id, pos, site_id || '/p' || pos % 4 AS url, updated_at || 'T00:00:00.000Z' AS updated_at FROM {b.LINKS} QUALIFY row_number() OVER (PARTITION BY page_id, pos % 4 ORDER BY pos) = 1"),
    "feed_kind": (feed_kind, "SELECT page_id, ['rss', 'atom', 'sitemap', 'sitemap-index', NULL][page_id % 5 + 1] AS kind FROM pages"),
    "feed_new_updated": (feed_new_updated, _DET),
    "items_capped": (items_capped, f"SELECT page_id AS monitor_id, least(count(*), 3) AS kept, least(max(pos), 2) AS last_pos FROM {b.LINKS} GROUP BY ALL"),
    "rfc822_dates": (
        rfc822_dates,
        """SELECT event_id, CASE WHEN event_id % 32 >= 1 AND event_id % 25 <= 23 AND event_id % 5 <> 4 THEN strftime(TIMESTAMP '2002-01-01 00:10:20' + to_days(CAST(event_id % 32 - 1 AS INTEGER)) + to_hours(event_id % 25)
  - to_minutes([-300, 0, 540, -90][event_id % 5 + 1]), '%Y-%m-%dT%H:%M:%S.000Z') END AS iso FROM events""",
    ),
    "written_dates": (
        written_dates,
        """SELECT event_id, strftime(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts) - INTERVAL 9 HOUR WHEN 3 THEN date_trunc('minute', ts)
  WHEN 4 THEN date_trunc('second', ts) + INTERVAL 5 HOUR END, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events""",
    ),
    "iso_dates": (
        iso_dates,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' WHEN 2 THEN strftime(ts, '%Y-%m-%dT00:00:00.000Z') ELSE strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso FROM events",
    ),
    "child_select": (child_select, f"SELECT site_id, page_id, lastmod FROM {_CHILD} WHERE xml AND lastmod >= '2024-01-12' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY lastmod DESC, page_id) <= 3"),
    "traversal_recursive": (traversal_recursive, f"WITH {_OPENED} SELECT o.site_id, o.page_id, l.pos, l.updated_at FROM o JOIN {b.LINKS} l ON l.page_id = o.page_id WHERE l.updated_at >= '2024-01-13'"),
    "traversal_counters": (
        traversal_counters,
        f"""WITH {_OPENED}, n AS (SELECT site_id, count(*) AS children FROM {_CHILD} GROUP BY ALL), p AS (SELECT site_id, count(*) AS opened FROM o GROUP BY ALL),
t AS (SELECT o.site_id, count(*) FILTER (WHERE l.updated_at < '2024-01-13') AS too_old, count(*) FILTER (WHERE l.updated_at >= '2024-01-13') AS taken FROM o JOIN {b.LINKS} l ON l.page_id = o.page_id GROUP BY ALL)
SELECT site_id, children, coalesce(opened, 0) AS opened, coalesce(too_old, 0) AS too_old, coalesce(taken, 0) AS taken FROM n LEFT JOIN p USING (site_id) LEFT JOIN t USING (site_id)""",
    ),
    "sitemap_document": (
        sitemap_document,
        f"""WITH o AS (SELECT site_id, site_id || href AS loc, updated_at FROM {b.LINKS} QUALIFY row_number() OVER (PARTITION BY site_id, href ORDER BY page_id, pos) = 1),
p AS (SELECT site_id, substr(sha256(line), 1, 2) AS part, sha256(string_agg(line, '' ORDER BY line)) AS h, count(*) AS n FROM (SELECT site_id, loc || chr(9) || updated_at || chr(10) AS line FROM o) GROUP BY ALL)
SELECT site_id, sha256(string_agg(h, '' ORDER BY part)) AS doc_hash, CAST(sum(n) AS BIGINT) AS urls FROM p GROUP BY site_id""",
    ),
    "sitemap_set_diff": (
        sitemap_set_diff,
        f"""WITH l AS {b.LINKS}, a AS (SELECT DISTINCT page_id, href FROM l WHERE (page_id + pos) % 7 <> 0), z AS (SELECT DISTINCT page_id, href FROM l WHERE (page_id + pos) % 5 <> 0)
SELECT *, 'added' AS side FROM (SELECT * FROM z EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM z)""",
    ),
    "title_enrich_budget": (
        title_enrich_budget,
        f"""WITH i AS (SELECT page_id AS monitor_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM {b.LINKS})
SELECT monitor_id, pos, nullif(left(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 512), '') AS title
FROM i LEFT JOIN pages p ON i.n <= 2 AND p.page_id = (i.monitor_id * 3 + i.pos) % 50""",
    ),
}

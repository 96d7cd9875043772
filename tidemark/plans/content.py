"""Page content: captures normalized, hashed, compared with the capture before, and turned into changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import html, text, urls
from tidemark.operators.differences import LINE, line_counts, text_changes
from tidemark.operators.keyed import put_if_absent
from tidemark.plans.bindings import CAPTURES, captures, table
from tidemark.sources import charsets, pages


def snapshots(rows: DataFrame, ignore: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """Captures with normalized_html, extracted_text and three hashes."""
    return rows.select(*rows.columns, F.inline(F.array(html.hashed(F.col("body"), F.col("url"), ignore, include))))


def page_changes(rows: DataFrame, ignore: tuple[str, ...] = (), include: tuple[str, ...] = (), only: DataFrame | None = None) -> DataFrame:
    """monitor_id, round, kind, level, dedupe_key, normalized_hash, text_hash of captures (monitor_id, url, round, body) that differ from the one before.

    Raw hashes decide first: captures are ordered and compared as rows of (monitor, round, hash), so no body is sorted and
    no HTML parsed for a capture that equals its predecessor byte for byte. Bodies are fetched for the captures of
    differing pairs alone, each is normalized once, and pairs meet again as hashes: a capture that was fetched as the older one of a pair has
    nothing but equal captures between itself and the one fetched before it, so it brings no change of its own. First captures are
    baselines and never changes. ``only`` (monitor_id) names the monitors that are compared at all.
    """
    order = Window.partitionBy("monitor_id").orderBy("round")
    raw = rows.select("monitor_id", "round", text.sha256(F.col("body")).alias("raw_hash"))
    lagged = raw.withColumns({"old_raw": F.lag("raw_hash").over(order), "old_round": F.lag("round").over(order)})
    pairs = lagged.filter("old_raw is not null and old_raw <> raw_hash")
    if only is not None:
        pairs = pairs.join(only.select("monitor_id"), "monitor_id", "left_semi")
    needed = pairs.select("monitor_id", F.explode(F.array("round", "old_round")).alias("round")).distinct()
    hashed = rows.join(needed, ["monitor_id", "round"]).select("monitor_id", "round", F.inline(F.array(html.hashed(F.col("body"), F.col("url"), ignore, include))))
    new = hashed.select("monitor_id", "round", F.struct("raw_hash", "normalized_hash", "text_hash").alias("new"))
    met = new.withColumn("old", F.lag("new").over(order)).filter("old is not null")
    changed, level = text.compared(F.col("old"), F.col("new"))
    key = F.when(level == "text_hash", F.col("new.text_hash")).otherwise(F.col("new.normalized_hash"))
    return met.filter(changed).select("monitor_id", "round", F.lit("updated").alias("kind"), level.alias("level"), key.alias("dedupe_key"), "new.normalized_hash", "new.text_hash")


def content_changes(spark, sf_dir):
    return page_changes(captures(spark, sf_dir))


def snapshot_hashes(spark, sf_dir):
    return snapshots(captures(spark, sf_dir)).select("monitor_id", "round", "raw_hash", "normalized_hash", "text_hash")


def page_text_blocks(spark, sf_dir):
    t = text.block_text(text.removed(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("extracted_text"))


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.title_of(F.col("html")).alias("title"))


def page_links_absolute(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages"), "page_id", "html", "url").select("page_id", "pos", "url")


def tracking_params_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.without_tracking(F.col("url")).alias("url"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.origin(u).alias("origin"), urls.host(u).alias("host"), urls.port(u).cast("long").alias("port"), urls.path(u).alias("path"), urls.query(u).alias("query"))


def previous_snapshot_lag(spark, sf_dir):
    order = Window.partitionBy("monitor_id").orderBy("round")
    raw = captures(spark, sf_dir).select("monitor_id", "round", text.sha256(F.col("body")).alias("raw_hash"))
    return raw.withColumn("previous_hash", F.lag("raw_hash").over(order))


def blob_put_if_absent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    blobs = docs.select(text.sha256(F.col("text")).alias("key"), F.col("text").alias("body"), "doc_id")
    new = put_if_absent(blobs.filter("doc_id % 3 <> 0").select("key", "body"), blobs.filter("doc_id % 3 = 0"))
    return new.select("key", F.length("body").cast("long").alias("n_chars"))


def raw_equal_captures(spark, sf_dir):
    """How many captures of each round were seen before, of any monitor."""
    c = captures(spark, sf_dir).select("round", text.sha256(F.col("body")).alias("key"))
    return c.groupBy("key").agg(F.min("round").alias("first_round"), F.count("*").alias("captures")).groupBy("first_round", "captures").agg(F.count("*").alias("bodies"))


def line_diff_counts(spark, sf_dir):
    return line_counts(_edited(spark, sf_dir), "doc_id", "old", "new")


def _edited(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: i % 3 != 2)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("old"), F.array_join(kept, "\n").alias("new"))


def line_diff_patch(spark, sf_dir):
    """Shortest edits with their patches."""
    return text_changes(_edited(spark, sf_dir), "doc_id", "old", "new")


def line_diff_minimal(spark, sf_dir):
    """Added and removed lines of shortest edits: every third line went, and what stood behind the first line repeats at the end."""
    lines = F.regexp_extract_all("text", F.lit(LINE), F.lit(0))
    df = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("old"), lines.alias("l"))
    new = F.concat(F.array_join(F.filter("l", lambda x, i: i % 3 != 2), ""), F.array_join(F.slice("l", F.lit(2), F.lit(2)), ""))
    return text_changes(df.select("doc_id", "old", new.alias("new")), "doc_id", "old", "new").select("doc_id", "added_count", "removed_count")


def charset_decode(spark, sf_dir):
    """Pages sent in Latin-1 or UTF-8, told by a header, decoded again."""
    p = table(spark, sf_dir, "pages").withColumn("latin", (F.col("page_id") % 2 == 0) & F.col("url").rlike(r"^[\x00-\x7F]*$"))
    sent = p.select("page_id", F.encode("url", "ISO-8859-1").alias("body"), F.when(F.col("latin"), "text/html; charset=iso-8859-1").alias("ct"))
    return charsets.html_text(sent, "body", pages.charset_of("ct")).select("page_id", "text")


def charset_sniffed(spark, sf_dir):
    """Whole pages as bytes: with byte order marks, declared as Latin-1, as Shift_JIS or not at all, and with a byte that means nothing."""
    k, html, utf8 = F.col("page_id") % 7, F.col("html"), F.encode("html", "UTF-8")
    put = lambda mark, body: F.concat(F.lit(mark), body)
    narrow = html.rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    body = (
        F.when(k == 0, put(b"\xef\xbb\xbf", utf8))
        .when(k == 1, put(b"\xff\xfe", F.encode(html, "UTF-16LE")))
        .when(k == 2, put(b"\xfe\xff", F.encode(html, "UTF-16BE")))
        .when((k == 3) & narrow, put(b'<meta charset="ISO-8859-1">\x80', F.encode(html, "ISO-8859-1")))
        .when(k == 4, F.concat(F.lit(b"<meta http-equiv=content-type content='text/html; charset=Shift_JIS'>\x93\xfa\x96\x7b"), F.encode(F.col("page_id").cast("string"), "UTF-8")))
        .when(k == 5, put(b"\xff", utf8))
        .otherwise(utf8)
    )
    header = F.when(k.isin(0, 1, 2), "iso-8859-1").when(k == 3, "none-such")
    sent = table(spark, sf_dir, "pages").select("page_id", body.alias("body"), header.alias("header"))
    return charsets.html_text(sent, "body", F.col("header")).select("page_id", "text")


def html_items_fields(spark, sf_dir):
    return pages.items(table(spark, sf_dir, "pages"), "page_id", "html", "url", "nav li").select("page_id", "pos", "url", "title")


def item_fields(spark, sf_dir):
    """Listings written for each page: items with labelled fields, a repeated label, an empty one, one without a link."""
    k = F.col("page_id").cast("string")
    unit = lambda n, fields: F.concat(F.lit(f'<li class="unit"><h2>no</h2><a href="/i{n}-'), k, F.lit('?utm_source=x"> Item <b>'), k, F.lit(f"</b></a><dl>{fields}</dl></li>"))
    listing = F.concat(
        F.lit('<ul id="list">'), unit(1, "<dt>Price</dt><dd>5 &nbsp;EUR</dd><dt>Size</dt><dd>9 m<sup>2</sup></dd><dt>&nbsp;</dt><dd>no</dd>"), unit(2, "<dt>Price</dt><dd>7</dd><dt>Price</dt><dd>8</dd><dd>9</dd>"),
        F.lit('<li class="unit">no link</li><li class="other"><a href="/o">o</a></li></ul>'),
    )
    pages_ = table(spark, sf_dir, "pages").select("page_id", listing.alias("html"), F.lit("https://e.org/l").alias("url"))
    found = pages.items(pages_, "page_id", "html", "url", "#list li.unit", ("Price", "Size"))
    return found.select("page_id", "pos", "url", "title", text.fields_summary(F.col("fields")).alias("summary"))


SELECTED = "nav li:nth-child(2n+1) > a[href^='/'], div.ad + article h1, article ~ footer, p:first-of-type > b"


def selected_elements(spark, sf_dir):
    """Elements that a list of selectors names, by tag: structural joins over the elements of all pages."""
    found = pages.elements(table(spark, sf_dir, "pages"), "page_id", "html")
    return pages.select_elements(found, "page_id", SELECTED).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("depth").cast("long").alias("depth"))


def linked_items(spark, sf_dir):
    """Items by selectors of their own for link, title and fields, one field by a label."""
    k = F.col("page_id").cast("string")
    one = lambda n: F.concat(F.lit(f'<div class="unit wide" data-n="{n}"><h2>T{n} &amp; '), k, F.lit(f'</h2><a href="mailto:x@y.z">m</a><a class="more" href="/i{n}-'), k, F.lit(f'">more</a><span class="v">v{n} </span><span class="v">no</span><dl><dt> Size</dt><dd>{n}&nbsp;m</dd></dl></div>'))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<main>"), one(1), one(2), F.lit("<p>"), one(3), F.lit("</main>")).alias("html"), F.lit("https://e.org/l").alias("url"))
    found = pages.items(p, "page_id", "html", "url", "main > .unit[data-n], .none", (("value", ".v"), ("size", None, "Size"), ("none", "b")), link="a.more", title="h2")
    return found.select("page_id", "pos", "url", "title", text.fields_summary(F.col("fields")).alias("summary"))


_R = text.REMOVED
_CLEANED = f"""SELECT *, list_aggregate(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(
      '<a href="' || regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || list_aggregate(list_transform(string_split(substr(tags[i], 10, length(tags[i]) - 11), ''), lambda c: CASE WHEN unicode(c) > 126 THEN url_encode(c) ELSE c END), 'string_agg', '') || '">', '')), 'string_agg', '') AS clean
  FROM (SELECT *, regexp_extract_all(kept, '<a href="/[^"]*">') AS tags, string_split_regex(kept, '<a href="/[^"]*">') AS gaps
        FROM (SELECT *, regexp_replace(body, '{_R}', '', 'g') AS kept FROM {CAPTURES}))"""


def block_text_sql(c: str) -> str:
    tag = text.BLOCK_TAG.replace("'", "''")
    every = text.ANY_TAG.replace("'", "''")
    return rf"""coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({c}, '{tag}', chr(57344), 'g'), '{every}', '', 'g'), '[ \t\r\n\f]+', ' ', 'g'), chr(57344)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '')"""


_HASHED = rf"""SELECT monitor_id, round, sha256(body) AS raw_hash,
    sha256(regexp_replace(regexp_replace(regexp_replace(clean, '>[ \t\r\n\f]*[\r\n][ \t\r\n\f]*<', '><', 'g'), '[ \t\r\n\f]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS normalized_hash,
    sha256({block_text_sql("clean")}) AS text_hash FROM ({_CLEANED})"""

LCS_SQL = rf"""WITH RECURSIVE t AS (SELECT doc_id, text, regexp_extract_all(text, '{LINE}') AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, a, regexp_extract_all(array_to_string([x FOR x, i IN a IF i % 3 <> 0], '') || array_to_string(a[2:3], ''), '{LINE}') AS b FROM t),
s AS (SELECT doc_id, a, b, 0 AS i, [0 FOR x IN range(len(b) + 1)] AS r FROM u UNION ALL
  SELECT doc_id, a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j] THEN r[j] + 1 ELSE greatest(r[j + 1], acc[-1]) END), [0]) FROM s WHERE i < len(a))
SELECT doc_id, len(b) - r[-1] AS added_count, len(a) - r[-1] AS removed_count FROM s WHERE i = len(a)"""

QUERIES = {
    "content_changes": (
        content_changes,
        f"""WITH h AS ({_HASHED}), p AS (SELECT *, lag(raw_hash) OVER w AS r0, lag(normalized_hash) OVER w AS n0, lag(text_hash) OVER w AS t0 FROM h WINDOW w AS (PARTITION BY monitor_id ORDER BY round))
SELECT monitor_id, round, 'updated' AS kind, CASE WHEN t0 = text_hash THEN 'normalized_hash' ELSE 'text_hash' END AS level,
       CASE WHEN t0 = text_hash THEN normalized_hash ELSE text_hash END AS dedupe_key, normalized_hash, text_hash
FROM p WHERE r0 <> raw_hash AND n0 <> normalized_hash""",
    ),
    "snapshot_hashes": (snapshot_hashes, _HASHED),
    "page_text_blocks": (page_text_blocks, f"SELECT page_id, {block_text_sql(f"regexp_replace(html, '{_R}', '', 'g')")} AS extracted_text FROM pages"),
    "page_titles": (
        page_titles,
        r"""SELECT page_id, nullif(left(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 512), '') AS title FROM pages""",
    ),
    "page_links_absolute": (
        page_links_absolute,
        r"""SELECT page_id, pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || list_aggregate(list_transform(string_split(href, ''), lambda c: CASE WHEN unicode(c) > 126 THEN url_encode(c) ELSE c END), 'string_agg', '') AS url
FROM (SELECT page_id, url, unnest(l) AS href, unnest(range(len(l)))::BIGINT AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1) AS l FROM pages))""",
    ),
    "tracking_params_stripped": (
        tracking_params_stripped,
        r"""SELECT page_id, CASE WHEN len(kept) = len(q) THEN url ELSE head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url
FROM (SELECT *, list_filter(q, lambda x: NOT regexp_matches(x, '(?i)^(?:utm_[^=]*|gclid|fbclid|yclid|mc_cid|mc_eid)(?:=|$)')) AS kept
      FROM (SELECT page_id, url, string_split(url, '?')[1] AS head, string_split(coalesce(string_split(url, '?')[2], ''), '&') AS q FROM pages))""",
    ),
    "url_parts": (
        url_parts,
        r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS origin, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host,
       CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END::BIGINT AS port, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '(\?[^#]*)', 1) AS query FROM pages""",
    ),
    "previous_snapshot_lag": (previous_snapshot_lag, f"SELECT monitor_id, round, sha256(body) AS raw_hash, lag(sha256(body)) OVER (PARTITION BY monitor_id ORDER BY round) AS previous_hash FROM {CAPTURES}"),
    "blob_put_if_absent": (
        blob_put_if_absent,
        """SELECT DISTINCT sha256(text) AS key, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0
AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0)""",
    ),
    "raw_equal_captures": (
        raw_equal_captures,
        f"SELECT first_round, captures, count(*) AS bodies FROM (SELECT min(round) AS first_round, count(*) AS captures FROM {CAPTURES} GROUP BY sha256(body)) GROUP BY ALL",
    ),
    "line_diff_counts": (
        line_diff_counts,
        """SELECT doc_id, CAST(0 AS BIGINT) AS added, CAST(len(string_split(text, chr(10))) // 3 AS BIGINT) AS removed FROM documents WHERE text IS NOT NULL""",
    ),
    "line_diff_patch": (line_diff_patch, None),
    "line_diff_minimal": (line_diff_minimal, LCS_SQL),
    "charset_decode": (charset_decode, "SELECT page_id, url AS text FROM pages"),
    "charset_sniffed": (
        charset_sniffed,
        r"""SELECT page_id, CASE WHEN page_id % 7 = 3 AND regexp_matches(html, '^[\x{00}-\x{7F}\x{A0}-\x{FF}]*$') THEN '<meta charset="ISO-8859-1">€' || html
  WHEN page_id % 7 = 4 THEN '<meta http-equiv=content-type content=''text/html; charset=Shift_JIS''>日本' || page_id WHEN page_id % 7 = 5 THEN chr(65533) || html ELSE html END AS text FROM pages""",
    ),
    "html_items_fields": (
        html_items_fields,
        r"""WITH l AS (SELECT page_id, url, unnest(h) AS href, unnest(t) AS title, unnest(range(len(h)))::BIGINT AS pos FROM (SELECT page_id, url, regexp_extract_all(n, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(n, '<a href="[^"]*">([^<]*)</a>', 1) AS t
  FROM (SELECT page_id, url, regexp_extract(html, '(?s)<nav>.*?</nav>') AS n FROM pages))),
u AS (SELECT page_id, pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || list_aggregate(list_transform(string_split(href, ''), lambda c: CASE WHEN unicode(c) > 126 THEN url_encode(c) ELSE c END), 'string_agg', '') AS url, title FROM l)
SELECT page_id, pos, url, title FROM u QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""",
    ),
    "selected_elements": (
        selected_elements,
        """WITH p AS (SELECT page_id, html, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<li><a href="/')) AS links FROM pages)
SELECT page_id, 'a' AS tag, (links + 1) // 2 AS n, 5::BIGINT AS depth FROM p WHERE links > 0 UNION ALL SELECT page_id, 'h1', 1, 3 FROM p WHERE html LIKE '%</div><article><h1>%'
UNION ALL SELECT page_id, 'footer', 1, 2 FROM p WHERE html LIKE '%</article>%<footer>%' UNION ALL SELECT page_id, 'b', 1, 4 FROM p WHERE regexp_matches(html, '</h1><p><b>')""",
    ),
    "linked_items": (
        linked_items,
        """SELECT page_id, n - 1 AS pos, 'https://e.org/i' || n || '-' || page_id AS url, 'T' || n || ' &amp; ' || page_id AS title, 'value: v' || n || chr(10) || 'size: ' || n || ' m' AS summary FROM pages, (SELECT unnest([1, 2]::BIGINT[]) AS n)""",
    ),
    "item_fields": (
        item_fields,
        """SELECT page_id, n - 1 AS pos, 'https://e.org/i' || n || '-' || page_id AS url, 'Item ' || page_id AS title, CASE n WHEN 1 THEN 'Price: 5 EUR' || chr(10) || 'Size: 9 m2' ELSE 'Price: 7' END AS summary
FROM pages, (SELECT unnest([1, 2]::BIGINT[]) AS n)""",
    ),
}

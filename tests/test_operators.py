"""Keyed writes, matches, policies, sources and streams on small tables; laws that must hold on any."""

import tempfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import differences, keyed, policy, relations
from tidemark.plans.content import page_changes
from tidemark.plans.feeds import detected
from tidemark.sources import feeds, pages, robots
from tidemark.streaming import delivery, limiter

LAWS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 9))), max_size=20)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@LAWS
@given(ROWS, ROWS)
def test_inserting_again_adds_nothing(spark, a, z):
    stored, batch = (spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "n int, k int, v int") for x in (a, z))
    new = keyed.insert_if_new(batch, stored, ["k"], ["n"])
    assert {r.k for r in new.collect()} == {k for k, _ in z} - {k for k, _ in a}
    assert keyed.insert_if_new(batch, stored.unionByName(new), ["k"], ["n"]).isEmpty()
    assert rows(keyed.first_wins(new, ["k"], ["n"])) == rows(new)


@LAWS
@given(ROWS, ROWS)
def test_watermarks_never_fall(spark, a, z):
    stored = spark.createDataFrame(list({k: v for k, v in a}.items()), "k int, mark int")
    seen = spark.createDataFrame(z, "k int, mark int")
    out = {r.k: r.mark for r in keyed.advance_watermark(stored, seen, ["k"], "mark").collect()}
    for k, old in {k: v for k, v in a}.items():
        marks = [v for kk, v in z if kk == k and v is not None] + ([old] if old is not None else [])
        assert out[k] == (max(marks) if marks else None)


@LAWS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.sampled_from("ab"))), max_size=8), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.sampled_from("ab")), max_size=8))
def test_wildcards(spark, subs, changes):
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(subs)], "s int, site_id int, monitor_id int, kind string")
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(changes)], "c int, site_id int, monitor_id int, kind string")
    want = sorted((j, i) for i, x in enumerate(subs) for j, y in enumerate(changes) if all(p is None or p == q for p, q in zip(x, y, strict=True)))
    assert sorted((r.c, r.s) for r in relations.wildcard_match(c, s).collect()) == want


def test_page_bounds(spark):
    df = spark.range(20)
    assert [r.id for r in relations.page(df, ["id"], 5, 10).collect()] == [10, 11, 12, 13, 14]
    for limit, offset in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            relations.page(df, ["id"], limit, offset)


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int")
    new = spark.createDataFrame([(1, None, 7, 1), (3, "c", None, 1), (1, "z", None, 0)], "k int, v string, w int, n int")
    assert rows(keyed.upsert(old, new, ["k"], ["n"])) == [(1, "a", 7), (2, "b", 6), (3, "c", None)]


def test_set_difference_of_equal_sets_is_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "k string, v string")
    assert relations.set_difference(df, df, ["k", "v"]).isEmpty()
    assert rows(relations.set_difference(df.limit(0), df, ["k", "v"])) == [("a", None, "added"), ("b", "x", "added")]


def test_captures_three_levels(spark):
    page = "<html><body><p>Hello</p></body></html>"
    captures = [(1, 1, page), (1, 2, page), (2, 1, page), (2, 2, page.replace("<p>", "<!-- x --><p nonce='1'>")), (3, 1, page), (3, 2, page.replace("p>", "div>")), (4, 1, page), (4, 2, page.replace("Hello", "Goodbye")), (5, 1, page)]
    df = spark.createDataFrame([(m, "https://e.org/", r, b) for m, r, b in captures], "monitor_id int, url string, round int, body string")
    assert [(r.monitor_id, r.level) for r in page_changes(df).orderBy("monitor_id").collect()] == [(3, "normalized_hash"), (4, "text_hash")]
    assert page_changes(df.limit(0)).isEmpty()


def test_feed_rounds(spark):
    items = lambda *x: spark.createDataFrame([(1, i, k, f"https://e.org/{k}", d) for i, (k, d) in enumerate(x)], "monitor_id int, pos int, stable_key string, url string, updated_at string")
    known = spark.createDataFrame([(1, "a", "t1")], "monitor_id int, stable_key string, known_at string")
    assert [r.suppressed for r in detected(items(("a", "t1")), known.limit(0)).collect()] == [True]
    assert detected(items(("a", "t1")), known).isEmpty()
    assert [(r.kind, r.dedupe_key, r.suppressed) for r in detected(items(("a", "t2"), ("a", "t3")), known).collect()] == [("updated", "a:t2", False)]
    assert [r.kind for r in detected(items(("b", None)), known).collect()] == ["new"]


def test_feeds(spark):
    rss = "<rss><channel><title>t</title><item><title>A</title><link>https://e.org/1</link><guid>g</guid><pubDate>Wed, 02 Oct 2002 08:00:00 EST</pubDate></item><item><link>https://e.org/2</link></item><item><title>only</title></item><item><guid>g</guid><title>again</title></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>i</id><title>A</title><link rel='self' href='/s'/><link rel='alternate' href='/p'/><updated>2024-02-02T03:04:05+09:00</updated></entry></feed>"
    sitemap = "<urlset><url><loc> /page-1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>/page-1</loc><lastmod>2025-01-01</lastmod></url></urlset>"
    index = "<sitemapindex><sitemap><loc>https://e.org/s.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame(list(enumerate([rss, atom, sitemap, index, "<html/>", "no xml", "<urlset><url></urlset>", None])), "doc int, xml string").withColumn("base_url", F.lit("https://e.org"))
    got = feeds.rss_items(df).orderBy("pos").collect()
    assert [(r.stable_key, r.url, r.title) for r in got[:2]] == [("g", "https://e.org/1", "A"), ("https://e.org/2", "https://e.org/2", None)]
    assert len(got) == 3 and len(got[2].stable_key) == 8 and got[0].published_at == "2002-10-02T13:00:00.000Z"
    assert [(r.stable_key, r.url, r.updated_at) for r in feeds.atom_items(df).collect()] == [("i", "https://e.org/p", "2024-02-01T18:04:05.000Z")]
    assert [(r.url, r.updated_at) for r in feeds.sitemap_items(df.filter("doc = 2")).collect()] == [("https://e.org/page-1", "2024-01-01T00:00:00.000Z")]
    assert [r.url for r in feeds.sitemap_items(df, index=True).collect()] == ["https://e.org/s.xml"]
    assert [r.error for r in feeds.parse_errors(df).orderBy("doc").collect()] == [None, None, None, None, "unexpected_root", "invalid_xml", "invalid_xml", "invalid_xml"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /eq\nAllow: /eq\nDisallow: /*.pdf$\n\nUser-agent: tidebot\nDisallow: /only\n"
    rules = robots.parsed(spark.createDataFrame([("https://o", body)], "origin string, body string"))
    urls_ = ["/a/x", "/a/b/x", "/eq", "/x.pdf", "/x.pdf.html", "/only", "/"]
    targets = spark.createDataFrame([("https://o", f"https://o{u}") for u in urls_] + [("https://none", "https://none/a")], "origin string, url string")
    plain = {r.url: r.verdict for r in policy.robots_verdict(targets, rules, "someone").collect()}
    assert [plain[f"https://o{u}"] for u in urls_] == ["disallowed", "allowed", "allowed", "disallowed", "allowed", "allowed", "allowed"] and plain["https://none/a"] == "allowed"
    named = {r.url: (r.verdict, r.agent_group) for r in policy.robots_verdict(targets, rules, "TideBot").collect()}
    assert named["https://o/only"] == ("disallowed", "TideBot") and named["https://o/a/x"][0] == "allowed"
    fetched = spark.createDataFrame([("a", 200, "x"), ("b", 404, "y"), ("c", 503, "z"), ("d", None, None)], "origin string, status int, body string")
    assert [(r.body, r.unavailable) for r in robots.from_fetches(fetched).orderBy("origin").collect()] == [("x", False), ("", False), ("", True), ("", True)]


def test_items_by_selector(spark):
    page = '<ul><li class="unit"><h2>T</h2><a href="mailto:x">m</a><a href="/1?utm_source=a"> One <b>x</b></a><dl><dt>Price</dt><dd>5 &nbsp;EUR</dd><dt>&nbsp;</dt><dd>no</dd></dl></li><li class="unit"><a href="/1">again</a></li><li class="other"><a href="/2">no</a></li><li class="unit">none</li></ul>'
    df = spark.createDataFrame([(1, page, "https://e.org/l"), (2, None, "https://e.org/")], "k int, html string, url string")
    got = pages.items(df, "k", "html", "url", "ul li.unit", ("Price",)).collect()
    assert [(r.url, r.title, [(f.name, f.value) for f in r.fields]) for r in got] == [("https://e.org/1", "One x", [("Price", "5 EUR")])]


def test_line_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "s", "s"), (3, None, "n")], "k int, old string, new string")
    patch = {r.k: r.d for r in df.select("k", differences.unified()("old", "new").alias("d")).collect()}
    assert (patch[1].added_count, patch[1].removed_count) == (2, 1) and "@@" in patch[1].patch and patch[2].patch == ""
    assert rows(differences.line_counts(df, "k", "old", "new"))[:2] == [(1, 2, 1), (2, 0, 0)]


def test_limiter_rules():
    x = limiter.Limiter()
    assert x.ask(0, 5_000, False) == (True, 0)
    assert x.ask(3_000, 1, False) == (False, 7_000)
    assert x.ask(10_000, 60_000, True) == (True, 0) and x.ask(20_000, 60_000, True) == (True, 0)
    assert x.ask(31_000, 1, False) == (False, limiter.SPACING)
    y, now = limiter.Limiter(), 0
    for _ in range(5):
        while not y.ask(now, 1, True)[0]:
            now += 1_000
        now += 10
    granted, wait = y.ask(now, 1, False)
    assert not granted and wait > 200_000
    now += wait
    assert y.ask(now, 30_000, False) == (True, 0) and y.ask(now + 11_000, 1, False)[0] is True


def test_limiter_waits_as_long_as_a_429_asks():
    x = limiter.Limiter()
    assert x.ask(0, 1_000, True, 90_000) == (True, 0)
    assert x.ask(30_000, 1, False) == (False, 61_000) and x.ask(91_000, 1, False) == (True, 0)


def test_limiter_stream_equals_batch(spark):
    rows_ = [(i, i % 3, 1_000 * i * (1 + i % 2), 500 + 37 * i, i % 4 == 0, 40_000 * (i % 8 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows_, "attempt_id long, origin_id long, at_ms long, hold_ms long, failed boolean, wait_ms long").orderBy("at_ms")
    path = tempfile.mkdtemp(prefix="spark-tidemark-")
    df.coalesce(1).write.parquet(f"{path}/in")
    stream = limiter.limited_stream(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("limited")) == rows(limiter.limited(df))


def test_deliveries(spark):
    tries = [(1, 1, "delivered"), (2, 1, "retry"), (2, 2, "delivered"), (3, 1, "dead"), (3, 2, "delivered"), *[(4, n, "retry") for n in range(1, 6)], (5, 1, "retry")]
    got = rows(delivery.settled(spark.createDataFrame(tries, "delivery_id int, attempt_no int, result string")))
    assert got == [(1, "delivered", 1), (2, "delivered", 2), (3, "dead", 1), (4, "dead", 5), (5, "failed", 1)]

"""Expressions against stated facts, a row per fact."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, html, network, outcomes, text, urls


@pytest.fixture(scope="module")
def each(spark):
    """Values of an expression over rows of strings."""

    def run(expression, *rows):
        table = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        names = ["a", "b", "c", "d"][: len(table[0]) - 1]
        df = spark.createDataFrame(table, "i int, " + ", ".join(f"{n} string" for n in names))
        out = df.select("i", expression(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()
        return [r.x for r in out]

    return run


def test_rfc822(each):
    got = each(dates.rfc822, "Wed, 02 Oct 2002 08:00:00 EST", "Thu, 03 Oct 2002 08:00:00 +0900", "02 Oct 02 08:00 GMT", "1 Jan 70 00:00:00 Z", "Wed, 32 Oct 2002 08:00:00 GMT", "Wed, 02 Oct 2002 25:00:00 GMT", "Wed, 02 Oct 2002 08:60:00 GMT", "Wed, 02 Oct 2002 08:00:60 GMT", "", None, "soon", " 30 Feb 2002 00:00:00 GMT ")
    assert got == ["2002-10-02T13:00:00.000Z", "2002-10-02T23:00:00.000Z", "2002-10-02T08:00:00.000Z", "1970-01-01T00:00:00.000Z", None, None, None, None, None, None, None, "2002-03-02T00:00:00.000Z"]


def test_iso(each):
    assert each(dates.iso, "2024-01-01", "2024-02-02T03:04:05+09:00", "2024-01-01T10:00:00.5Z", "no date", "  ", None) == ["2024-01-01T00:00:00.000Z", "2024-02-01T18:04:05.000Z", "2024-01-01T10:00:00.500Z", "no date", None, None]


def test_resolve(each):
    base = "https://example.com/dir/page?x=1#f"
    rows = {"/a b": "https://example.com/a%20b", "x/../y": "https://example.com/dir/y", "../../z/": "https://example.com/z/", "//other.org/p": "https://other.org/p", "?q=1": "https://example.com/dir/page?q=1", "#top": "https://example.com/dir/page?x=1#top", "mailto:a@b.c": None, "HTTP://X.org": "http://x.org/", "é": "https://example.com/dir/%C3%A9", "": None}
    assert each(urls.resolve, *[(k, base) for k in rows]) == list(rows.values())


def test_tracking(each):
    rows = {"https://a.b/c?utm_source=x&y=1&GCLID=2#f": "https://a.b/c?y=1#f", "https://a.b/c?utm_source=x": "https://a.b/c", "https://a.b/c?y=utm_x&b": "https://a.b/c?y=utm_x&b", "https://a.b/c": "https://a.b/c", "https://a.b/?fbclidx=1": "https://a.b/?fbclidx=1"}
    assert each(urls.without_tracking, *rows) == list(rows.values())


def test_entities(each):
    assert each(urls.decode_entities, "a&amp;b&#65;&#x42;&unknown;&lt;&", "plain", None) == ["a&bAB&unknown;<&", "plain", None]


def test_percent(each):
    assert each(urls.percent_normalized, "/%7euser/%c3%a4 b%2F", "/é%", "") == ["/~user/%C3%A4%20b%2F", "/%C3%A9%", ""]


def test_glob(each):
    rows = [("/a", "/a/b", True), ("/*.pdf", "/report.pdf.html", True), ("/*.pdf$", "/report.pdf.html", False), ("/*.pdf$", "/x.pdf", True), ("/a*b*c", "/axbyc", True), ("/a*b*c$", "/axbycd", False), ("*", "", True), ("/a$", "/a", True), ("/a$", "/ab", False), ("/search?q=", "/search?q=1", True), ("/ab*ba$", "/aba", False), ("*" * 300 + "x$", "a" * 5000, False)]
    assert each(urls.glob_match, *[r[:2] for r in rows]) == [r[2] for r in rows]
    assert each(lambda p, t: urls.glob_match(p, t, prefix=False), ("a*.xml", "a1.xml"), ("a*.xml", "a1.xml.gz"), ("A*", "a"), ("a+b", "a+b")) == [True, False, False, True]


def test_hosts(each):
    from tidemark.plans.policies import HOSTS

    assert each(network.host_class, *[h for h, _ in HOSTS]) == [r for _, r in HOSTS]


def test_url_check(each):
    rows = {"https://example.com/": None, "http://example.com:8443/x": None, "http://example.com:81/": "port", "ftp://a/": "scheme", "http://u:p@a.b/": "userinfo", "nonsense": "invalid_url", "http:///x": "invalid_url", "http://2130706433/": "loopback", "https://[::1]:8080/": "loopback", "http://169.254.169.254/": "metadata"}
    assert each(network.url_check, *rows) == list(rows.values())


def test_title(each):
    assert each(text.title_of, "<title>\n A  b </title><title>c</title>", "<p>x", "<TITLE> </TITLE>", "<title>" + "x" * 600 + "</title>") == ["A b", None, None, "x" * 512]


def test_clean(each):
    base = "https://e.org/d/"
    page = '<div nonce="1" id=\'q\' class="z"><a href="x?utm_source=1" data-csrf-token="t">L</a><script>"</p>"</script><!-- c --><img src=/i.png alt="a>b"/></div>'
    want = '<div class="z" id="q"><a href="https://e.org/d/x">L</a><img alt="a>b" src="https://e.org/i.png" /></div>'
    assert each(html.cleaned, (page, base), ("no tags", base), (None, base), ("", base)) == [want, "no tags", None, ""]


def test_nonce_only_changes_are_equal_and_text_changes_are_not(each):
    one = lambda n, t: f'<html><body nonce="{n}"><p>{t}</p>\n  <p>x</p></body></html>'
    a, b, c = each(lambda h: html.normalized(h, F.lit("https://e.org/")), one(1, "Hello"), one(2, "Hello"), one(1, "Goodbye"))
    assert a == b and a.extracted_text == "Hello\nx" and a.extracted_text != c.extracted_text


def test_block_text(each):
    assert each(text.block_text, "<ul><li>a <b>b</b></li><li> </li><li>c&amp;d</li></ul>x<br/>y", "a\n b") == ["a b\nc&amp;d\nx\ny", "a b"]


def test_failure_classes(each):
    f = lambda s, e, n: outcomes.failure_class(s.cast("int"), e, F.lit(False), n.cast("int"), F.lit(True))
    rows = [("200", None, "1"), ("304", None, "1"), ("401", None, "1"), ("403", None, "1"), ("410", None, "1"), ("429", None, "1"), ("503", None, "1"), ("200", None, "9000000"), (None, "timeout", None), (None, "reset", None), ("302", None, "1")]
    assert each(f, *rows) == [None, None, "auth_required", "http_403", "not_found", "http_429", "http_5xx", "too_large", "timeout", "network_error", "network_error"]


def test_proceed_and_backoff(each):
    assert each(lambda f: outcomes.may_proceed(f, F.lit(None).cast("array<string>")), "timeout", "http_5xx", "not_found", "http_429") == [True, True, False, False]
    assert each(lambda f: outcomes.may_proceed(f, F.array(F.lit("http_429"), F.lit("not_found"))), "http_429", "not_found") == [True, False]
    assert each(lambda n: outcomes.backoff_ms(n.cast("int")), "0", "1", "2", "5", "6", "99") == [0, 10_000, 20_000, 160_000, 300_000, 300_000]


def test_secrets(each):
    key, other, iv = F.lit(b"k" * 32), F.lit(b"o" * 32), F.lit(b"i" * 12)
    sealed = each(lambda s: outcomes.sealed(s, key, iv), "https://h.org/secret")[0]
    assert sealed.startswith("enc:v1:") and "secret" not in sealed
    assert each(lambda e: outcomes.opened(e, key), sealed, "plain") == ["https://h.org/secret", "plain"]
    assert each(lambda e: outcomes.opened(e, other), sealed) == [None]


def test_previews(each):
    assert each(lambda c: text.preview(c, 3, "!"), "abc", "abcd", None) == ["abc", "abc!", None]
    assert each(lambda c: text.shortened(c, 3), "abc", "abcd") == ["abc", "ab…"]
    assert each(text.field_text, " a&nbsp; b ", None) == ["a b", None]


def test_payload(each):
    f = lambda t, k, p, d: outcomes.payload(t, k, F.lit("https://e.org/a"), F.lit("Site"), p, d)
    rows = [(None, "new", None, "2024-01-01T15:04:05Z"), ("T" * 300, "removed", "x" * 901, "no date"), ("T", "updated", "", "2024-06-30T20:00:00.000Z")]
    got = [json.loads(x) for x in each(f, *rows)]
    assert got[0] == {"embeds": [{"title": "Site", "color": 0x57F287, "description": "**種別**: 新規検出\n**URL**: https://e.org/a\n**検出日時**: 2024-01-02 00:04:05 JST", "timestamp": "2024-01-01T15:04:05.000Z"}]}
    one = got[1]["embeds"][0]
    assert one["title"] == "T" * 255 + "…" and one["color"] == 0xED4245 and "timestamp" not in one
    assert one["description"].endswith("**検出日時**: no date\n```diff\n" + "x" * 900 + "\n…(truncated)\n```")
    assert "diff" not in got[2]["embeds"][0]["description"] and "更新検出" in got[2]["embeds"][0]["description"]


def test_masked_urls(each):
    assert each(outcomes.masked_url, "https://h.example:8443/api/secret", "nonsense") == ["h.example:8443/***cret", "***ense"]


def test_rfc822_parts(each):
    rows = {
        "Wed, 02 Oct 2002 08:00:00 EST": "2002-10-02T13:00:00.000Z", "2 Oct 02 08:00 GMT": "2002-10-02T08:00:00.000Z", "02 Oct 99 08:00:01+0900": "1999-10-01T23:00:01.000Z", "Tue, 1 Jul 2003 10:52:37 +0200 (CEST)": "2003-07-01T08:52:37.000Z",
        "02 Oct 2002 08:00": "2002-10-02T08:00:00.000Z", "02 Oct 2002 24:00:00 GMT": None, "02 Foo 2002 08:00:00 GMT": None, "02 Oct 2002 08:00:00 XYZ": None, "Oct 2002": None, "": None, None: None,
    }
    assert each(dates.rfc822, *rows) == list(rows.values())
    assert each(dates.feed_date, "2024-01-02", "02 Jan 2024 00:00 Z", "soon") == ["2024-01-02T00:00:00.000Z", "2024-01-02T00:00:00.000Z", None]


def test_written_out_dates(spark):
    want = {
        "October 2, 2002": "2002-10-02T00:00:00.000Z", "Wed, 2 Oct 2002": "2002-10-02T00:00:00.000Z", "2002/10/2 08:05": "2002-10-02T08:05:00.000Z", "10/2/2002 12:05 AM": "2002-10-02T00:05:00.000Z", "Oct 2 2002 8:05:06pm EST": "2002-10-03T01:05:06.000Z",
        "Wed Oct 02 2002 08:00:00 GMT+0900 (Japan)": "2002-10-01T23:00:00.000Z", "2 October 2002 08:00 +09:00": "2002-10-01T23:00:00.000Z", "13/2/2002": None, "October 32, 2002": None, "2 Oct 2002 25:00": None, "2 Oct 2002 13:00 pm": None, "maybe 2 Oct 2002": None, "2 Oct": None, "": None,
    }
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r.s: r.d for r in df.select("s", dates.feed_date(F.col("s")).alias("d")).collect()} == want

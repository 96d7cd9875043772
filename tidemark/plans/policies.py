"""Access policies: network safety, robots rules, fetch outcomes and sequences, failure streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import configs, network, outcomes, urls
from tidemark.operators import policy, relations, scans
from tidemark.plans import bindings as b
from tidemark.sources import robots

# Hosts in odd notations: (host, class).
HOSTS = [
    ("127.0.0.1", "loopback"), ("10.1.2.3", "private"), ("172.15.0.1", None), ("172.16.0.1", "private"), ("172.31.9.9", "private"), ("172.32.0.1", None), ("192.168.1.1", "private"), ("192.169.1.1", None),
    ("169.254.169.254", "metadata"), ("169.254.1.1", "link-local"), ("100.64.0.1", "cgn"), ("100.128.0.1", None), ("0.1.2.3", "invalid"), ("224.0.0.1", "invalid"), ("255.255.255.255", "invalid"), ("8.8.8.8", None),
    ("2130706433", "loopback"), ("0x7f000001", "loopback"), ("0177.0.0.1", "loopback"), ("127.1", "loopback"), ("10.258", "private"), ("256.1.1.1", None), ("1.2.3.4.5", None), ("08.1.1.1", None), ("example.com", None),
    ("localhost", "loopback"), ("a.localhost", "loopback"), ("metadata.google.internal", "metadata"), ("[::1]", "loopback"), ("::", "invalid"), ("fe80::1", "link-local"), ("[fd12::1]", "private"), ("::ffff:127.0.0.1", "loopback"),
    ("::10.0.0.1", "private"), ("2001:4860:4860::8888", None), ("fd00:ec2::254", "metadata"), ("1::2::3", None), ("::ffff:8.8.8.8", None),
]


def host_classes(spark, sf_dir):
    """Classes of the hosts that pages name, some of them replaced by odd notations, user and port before and behind them."""
    odd = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HOSTS)], "k long, odd string")
    p = b.table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 4 != 0, F.floor(F.col("page_id") / 4) % len(HOSTS)).alias("k")).join(odd, "k", "left")
    named = F.when(F.col("odd").contains(":") & ~F.col("odd").startswith("["), F.concat(F.lit("["), "odd", F.lit("]"))).otherwise(F.col("odd"))
    url = F.when(F.col("odd").isNull(), F.col("url")).otherwise(F.concat(F.lit("http://me@"), named, F.lit(":8080/")))
    return p.select("page_id", network.host_class(urls.host(url)).alias("reason"))


def ipv4_classify(spark, sf_dir):
    """Class of an address per document, in the notation of a single decimal number."""
    ip = F.pmod(F.col("doc_id") * 2654435761, F.lit(1 << 32))
    return b.table(spark, sf_dir, "documents").select("doc_id", network.ipv4_class(network.ipv4(ip.cast("string"))).alias("reason"))


def ssrf_static(spark, sf_dir):
    k = F.col("page_id") % 6
    odd = F.when(k == 1, F.replace(F.col("url"), F.lit("://"), F.lit("://me@"))).when(k == 2, F.lit("ftp://x.org/")).when(k == 3, F.lit("http://x.org:22/")).when(k == 4, F.lit("http://10.0.0.1:8080/")).when(k == 5, F.lit("nothing")).otherwise(F.col("url"))
    return b.table(spark, sf_dir, "pages").select("page_id", network.url_check(odd).alias("reason"))


def dns_all_public(spark, sf_dir):
    """Sites by their answers: every address must be public, no answer is a refusal."""
    ip = F.when(F.col("s_suppkey") % 9 == 5, "10.0.0.1").otherwise("8.8.8.8")
    answers = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), F.col("s_suppkey").alias("pos"), ip.alias("ip"))
    hosts = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("host"))
    return policy.dns_verdict(hosts, answers, network.ipv4_class(network.ipv4(F.col("ip"))))


def http_failure_class(spark, sf_dir):
    a = b.attempts(spark, sf_dir)
    error = F.when(F.col("attempt_id") % 11 == 0, "timeout").when(F.col("attempt_id") % 13 == 0, "reset")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 301, 304, 401, 403, 404, 410, 429, 503, 302)]), (F.col("attempt_id") % 10 + 1).cast("int"))
    f = outcomes.failure_class(status, error, F.col("attempt_id") % 4 == 0, F.when(F.col("attempt_id") % 7 == 0, 6 << 20).otherwise(100), F.col("attempt_id") % 5 != 0)
    return a.select("attempt_id", F.coalesce(f, F.lit("ok")).alias("failure"))


def robots_rules_parsed(spark, sf_dir):
    """A robots.txt for every fifty pages, a line for each: agents, rules, comments, unknown fields and paths that are none."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    line = (
        F.when(k % 9 < 2, F.concat(F.lit("User-Agent : Bot"), (k % 7).cast("string"), F.lit(" # agent")))
        .when(k % 9 == 2, F.concat(F.lit("Disallow: /%7Ea"), n, F.lit("/%c3%a4 b*")))
        .when(k % 9 == 3, F.concat(F.lit("\tallow:/b"), n, F.lit("$")))
        .when(k % 9 == 4, F.when(k % 2 == 0, "Disallow:").otherwise("Allow:"))
        .when(k % 9 == 5, F.concat(F.lit("# Disallow: /no"), n))
        .when(k % 9 == 6, "Crawl-delay: 5")
        .when(k % 9 == 7, F.concat(F.lit("Sitemap: https://e.org/s"), n, F.lit(".xml")))
        .otherwise(F.concat(F.lit("Disallow: no"), n))
    )
    lines = b.table(spark, sf_dir, "pages").select(F.concat(F.lit("https://r"), F.floor(k / 50).cast("string"), F.lit(".example")).alias("origin"), F.struct("page_id", line.alias("line")).alias("l"))
    files = lines.groupBy("origin").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\r\n").alias("body"))  # fifty lines
    return robots.parsed(files).select("origin", "group_no", F.array_join("agents", ",").alias("agents"), "directive", "pattern")


def robots_verdict(spark, sf_dir):
    """Paths of all links against rules whose patterns come from the first letters of links."""
    links = b.page_links(spark, sf_dir)
    targets = links.select("page_id", "pos", F.col("site_id").alias("origin"), F.concat("site_id", "href").alias("url"))
    rules = links.filter("pos < 4 and href rlike '^/[A-Za-z]{2}'").groupBy("site_id", F.substring("href", 1, 3).alias("p")).agg(F.min("page_id").alias("n"))
    rules = rules.select(F.col("site_id").alias("origin"), F.lit(1).alias("group_no"), F.array(F.lit("*")).alias("agents"), F.col("n").alias("rule_no"), F.when(F.col("n") % 3 == 0, "allow").otherwise("disallow").alias("directive"), F.concat("p", F.lit("*")).alias("pattern"))
    return policy.robots_verdict(targets, rules, "tidebot").select("page_id", "pos", "verdict", "agent_group")


def fetch_sequence(spark, sf_dir):
    """Orders as jobs, lines as tries: a fetcher for every two lines, failures by return flag and line status."""
    failure = F.when(F.col("l_returnflag") == "A", "http_5xx").when(F.col("l_returnflag") == "R", "not_found").when(F.col("l_linestatus") == "F", "timeout")
    lines = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber").cast("long") - 1).alias("n")).agg(F.min(failure).alias("failure"))
    k = F.floor(F.col("n") / 2).cast("long")
    tries = lines.select("job_id", k.alias("order_index"), (F.col("n") % 2).alias("try_no"), F.concat(F.lit("f"), k.cast("string")).alias("fetcher"), "failure", F.lit(None).cast("array<string>").alias("proceed_on"))
    return policy.fetch_sequence(tries, attempts=3, retries=2)


def policy_validation(spark, sf_dir):
    """Allow lists of suppliers' nations against order lists with gaps and repeats."""
    s = b.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("f"), (F.col("s_suppkey") % 5).cast("string")))).alias("allow"))
    lists = s.withColumn("ordered", F.when(F.col("s_nationkey") % 3 == 0, F.col("allow")).when(F.col("s_nationkey") % 3 == 1, F.slice("allow", 1, 1)).otherwise(F.concat("allow", F.slice("allow", 1, 1))))
    return relations.occurrences(lists, ["s_nationkey"], "allow", "ordered").select("s_nationkey", F.size("errors").cast("long").alias("n_errors"))


def attempt_index(spark, sf_dir):
    return scans.numbered(b.attempts(spark, sf_dir), "origin_id", ["seen_at", "attempt_id"], "attempt_index").select("attempt_id", "attempt_index")


def failure_streak(spark, sf_dir):
    """Streaks per origin with the wait they cause and whether the breaker is open."""
    s = scans.streaks(b.attempts(spark, sf_dir), "origin_id", ["seen_at", "attempt_id"], F.col("ok"))
    return s.select("attempt_id", "streak", outcomes.backoff_ms(F.col("streak")).alias("wait_ms"), (F.col("streak") >= 5).alias("breaker_open"))


def hot_streaks(spark, sf_dir):
    """Streaks where one origin has a third of all attempts and every attempt tells what the last answer but 429 was."""
    a = b.attempts(spark, sf_dir).withColumn("origin_id", F.when(F.col("attempt_id") % 3 == 0, -1).otherwise(F.col("origin_id")))
    s = scans.streaks(a.select("origin_id", "attempt_id", "seen_at", "ok", "status_code"), "origin_id", ["seen_at", "attempt_id"], F.col("ok"))
    last = F.when(F.col("status_code") != 429, F.col("status_code"))
    out = scans.running(s, "origin_id", ["seen_at", "attempt_id"], sums={"failures": (~F.col("ok")).cast("long")}, maxima={"worst": F.col("streak")}, lasts={"last_status": last})
    return out.select("attempt_id", "streak", "failures", "worst", "last_status")


def robots_cache_as_of(spark, sf_dir):
    """Checks of origins, each against the newest cache entry of its own time: from the cache if that is younger than an hour."""
    e = b.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("origin"), "ts", "event_type", "value")
    cache = e.filter("event_type = 'purchase'").select("origin", F.col("ts").alias("fetched_at"), F.col("event_id").alias("entry"), (F.col("value") < 10).alias("unavailable"))
    checks = e.filter("event_type <> 'purchase'").select("event_id", "origin", F.col("ts").alias("checked_at"))
    return policy.cached_as_of(checks, cache, "checked_at").select("event_id", "entry", "from_cache", "unavailable")


def snapshot_as_of(spark, sf_dir):
    """Errors with the snapshot their user's target had before: the last click or view strictly before them."""
    e = b.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    seen = e.filter("event_type in ('click', 'view')").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("snapshot_id"))
    found = scans.as_of(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), seen, "user_id", "ts", "seen_at", exact=False)
    return found.select("event_id", "found.snapshot_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("found.seen_at").cast("timestamp"))).alias("age_us"))


# Configurations by type of source: (type, configuration or null, keys not taken, error).
CONFIGS = [
    ("page", None, None, None), ("page", "{}", "", None), ("page", '{"page_mode":"content","ignore_selectors":[".ad"],"strip_query_params":["x"]}', "", None), ("page", '{"max_depth":2,"page_mode":"content"}', "max_depth", "config_not_applicable"),
    ("page", '{"page_mode":"extract"}', "", "invalid_selector"), ("page", '{"page_mode":"extract","extract":{"item_selector":"ul.news > > li"}}', "", "invalid_selector"), ("page", '{"page_mode":"extract","extract":{"item_selector":"ul.news li"}}', "", None),
    ("page", '{"extract":{"item_selector":"li","fields":[{"name":"a","selector":"b","label":"c"}]}}', "", "invalid_field"), ("page", '{"extract":{"item_selector":"li","fields":[{"name":"a"}]}}', "", "invalid_field"),
    ("page", '{"extract":{"item_selector":"li","fields":[{"name":"a","label":"c"},{"name":"b","selector":"[["}]}}', "", "invalid_selector"), ("page", '{"extract":{"item_selector":"li","fields":[{"name":"a","label":"c"}]}}', "", None),
    ("sitemap", '{"sitemap_mode":"traverse","max_depth":2,"child_include_patterns":["a*"]}', "", None), ("sitemap-index", '{"lastmod_max_age_days":3}', "", None), ("sitemap", '{"page_mode":"extract","extract":{}}', "page_mode,extract", "config_not_applicable"),
    ("rss", None, None, None), ("rss", "{}", "", "config_not_applicable"), ("atom", '{"max_depth":1}', "max_depth", "config_not_applicable"),
]


def config_applicability(spark, sf_dir):
    """Configurations of pages, sitemaps and feeds: keys that their type does not take, and the first error."""
    rows = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(CONFIGS)], "case int, kind string, config string")
    k, c = F.col("kind"), F.col("config")
    e = b.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(CONFIGS)).cast("int").alias("case"))
    return e.join(rows, "case").select("event_id", F.array_join(configs.not_applicable(k, c), ",").alias("not_applicable"), configs.config_error(k, c).alias("error"))


def retry_after(spark, sf_dir):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    k = F.col("event_id")
    v = F.when(k % 3 == 0, (k % 500).cast("string")).when(k % 3 == 1, F.concat(F.lit("Mon, 01 Jan 2024 00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00 GMT"))).otherwise("soon")
    return b.table(spark, sf_dir, "events").select("event_id", outcomes.retry_after(v, now).alias("seconds"))


_HOSTS = ", ".join(f"('{h}', {f"'{r}'" if r else 'NULL'})" for h, r in HOSTS)
_CONFIGS = ", ".join(f"({i}, {', '.join(f"'{v}'" if v is not None else 'NULL::VARCHAR' for v in x[2:])})" for i, x in enumerate(CONFIGS))
QUERIES = {
    "host_classes": (
        host_classes,
        f"""SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN reason END AS reason FROM pages LEFT JOIN (SELECT row_number() OVER () - 1 AS k, reason FROM (VALUES {_HOSTS}) t(host, reason)) ON page_id // 4 % {len(HOSTS)} = k""",
    ),
    "ipv4_classify": (
        ipv4_classify,
        """SELECT doc_id, CASE WHEN a = 127 THEN 'loopback' WHEN a = 0 THEN 'invalid' WHEN ip = 2852039166 THEN 'metadata' WHEN a = 169 AND b = 254 THEN 'link-local'
  WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'cgn' WHEN a >= 224 THEN 'invalid' END AS reason
FROM (SELECT doc_id, ip, ip // 16777216 AS a, ip // 65536 % 256 AS b FROM (SELECT doc_id, (doc_id * 2654435761) % 4294967296 AS ip FROM documents))""",
    ),
    "ssrf_static": (ssrf_static, "SELECT page_id, [NULL, 'userinfo', 'scheme', 'port', 'private', 'invalid_url'][page_id % 6 + 1] AS reason FROM pages"),
    "dns_all_public": (
        dns_all_public,
        """SELECT n_nationkey AS host, CASE WHEN n IS NULL THEN 'dns_resolution_failed' WHEN bad THEN 'private' END AS reason FROM nation
LEFT JOIN (SELECT s_nationkey, count(*) AS n, bool_or(s_suppkey % 9 = 5) AS bad FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey""",
    ),
    "http_failure_class": (
        http_failure_class,
        """SELECT event_id AS attempt_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'network_error' ELSE
 CASE event_id % 10 WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'invalid_content_type' WHEN event_id % 7 = 0 THEN 'too_large' ELSE 'ok' END WHEN 1 THEN 'network_error' WHEN 2 THEN 'ok' WHEN 3 THEN 'auth_required'
 WHEN 4 THEN CASE WHEN event_id % 7 = 0 THEN 'too_large' WHEN event_id % 4 = 0 THEN 'captcha_challenge' ELSE 'http_403' END WHEN 5 THEN 'not_found' WHEN 6 THEN 'not_found' WHEN 7 THEN 'http_429' WHEN 8 THEN 'http_5xx' ELSE 'network_error' END END AS failure FROM events""",
    ),
    "robots_rules_parsed": (
        robots_rules_parsed,
        r"""WITH l AS (SELECT 'https://r' || page_id // 50 || '.example' AS origin, page_id AS k, page_id % 9 AS m FROM pages),
f AS (SELECT *, m < 2 AND coalesce(lag(m) OVER (PARTITION BY origin ORDER BY k), 9) >= 2 AS opens FROM l WHERE m NOT IN (5, 6)),
g AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY k) AS BIGINT) AS group_no FROM f),
a AS (SELECT origin, group_no, string_agg(DISTINCT 'bot' || k % 7, ',' ORDER BY 'bot' || k % 7) AS agents FROM g WHERE m < 2 GROUP BY ALL),
r AS (SELECT origin, group_no, CASE WHEN m = 2 THEN 'disallow' ELSE 'allow' END AS directive, CASE m WHEN 2 THEN '/~a' || k || '/%C3%A4%20b*' WHEN 3 THEN '/b' || k || '$' ELSE '' END AS pattern FROM g WHERE m IN (2, 3) OR (m = 4 AND k % 2 = 1))
SELECT origin, group_no, agents, directive, pattern FROM a LEFT JOIN r USING (origin, group_no)""",
    ),
    "robots_verdict": (
        robots_verdict,
        f"""WITH l AS {b.LINKS}, r AS (SELECT site_id, substr(href, 1, 3) AS p, min(page_id) AS n FROM l WHERE pos < 4 AND regexp_matches(href, '^/[A-Za-z][A-Za-z]') GROUP BY ALL)
SELECT l.page_id, l.pos, CASE WHEN r.n % 3 <> 0 THEN 'disallowed' ELSE 'allowed' END AS verdict, CASE WHEN l.site_id IN (SELECT site_id FROM r) THEN '*' ELSE 'none' END AS agent_group
FROM l LEFT JOIN r ON r.site_id = l.site_id AND substr(l.href, 1, 3) = r.p""",
    ),
    "fetch_sequence": (
        fetch_sequence,
        """WITH t AS (SELECT l_orderkey AS job_id, (l_linenumber - 1) // 2 AS i, (l_linenumber - 1) % 2 AS k,
  min(CASE WHEN l_returnflag = 'A' THEN 'http_5xx' WHEN l_returnflag = 'R' THEN 'not_found' WHEN l_linestatus = 'F' THEN 'timeout' END) AS f FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL),
e AS (SELECT job_id, i, CASE WHEN arg_min(coalesce(f, 'ok'), k) = 'http_5xx' THEN arg_max(coalesce(f, 'ok'), k) ELSE arg_min(coalesce(f, 'ok'), k) END AS f,
             CASE WHEN arg_min(coalesce(f, 'ok'), k) = 'http_5xx' THEN max(k) ELSE min(k) END + 1 AS used FROM t GROUP BY ALL),
s AS (SELECT job_id, coalesce(min(i) FILTER (WHERE f NOT IN ('http_5xx', 'timeout', 'network_error')), max(i)) AS stop FROM e GROUP BY job_id)
SELECT e.job_id, max(e.f) FILTER (WHERE e.i = s.stop) AS outcome, CAST(sum(used) AS BIGINT) AS n_attempts, 'f' || CAST(any_value(s.stop) AS VARCHAR) AS last_fetcher FROM e JOIN s ON e.job_id = s.job_id AND e.i <= s.stop GROUP BY e.job_id""",
    ),
    "policy_validation": (
        policy_validation,
        """SELECT s_nationkey, CAST(CASE s_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN n - 1 ELSE 1 END AS BIGINT) AS n_errors FROM (SELECT s_nationkey, count(DISTINCT s_suppkey % 5) AS n FROM supplier GROUP BY ALL)""",
    ),
    "attempt_index": (attempt_index, f"SELECT attempt_id, row_number() OVER (PARTITION BY origin_id ORDER BY seen_at, attempt_id) - 1 AS attempt_index FROM {b.ATTEMPTS}"),
    "failure_streak": (
        failure_streak,
        f"""SELECT attempt_id, streak, CASE WHEN streak = 0 THEN 0 ELSE least(300000, 10000 * CAST(pow(2, streak - 1) AS BIGINT)) END::BIGINT AS wait_ms, streak >= 5 AS breaker_open FROM (
SELECT attempt_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY origin_id, g ORDER BY seen_at, attempt_id) AS BIGINT) AS streak FROM (
SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY origin_id ORDER BY seen_at, attempt_id) AS g FROM {b.ATTEMPTS}))""",
    ),
    "hot_streaks": (
        hot_streaks,
        f"""WITH a AS (SELECT attempt_id, CASE WHEN attempt_id % 3 = 0 THEN -1 ELSE origin_id END AS o, seen_at, ok, status_code FROM {b.ATTEMPTS}),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY seen_at, attempt_id) AS g FROM a),
s AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY o, g ORDER BY seen_at, attempt_id) AS BIGINT) AS streak FROM g)
SELECT attempt_id, streak, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS BIGINT) AS failures, max(streak) OVER w AS worst, last_value(CASE WHEN status_code <> 429 THEN status_code END IGNORE NULLS) OVER w AS last_status
FROM s WINDOW w AS (PARTITION BY o ORDER BY seen_at, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "robots_cache_as_of": (
        robots_cache_as_of,
        """WITH e AS (SELECT *, user_id % 20 AS origin FROM events), c AS (SELECT origin, ts, max({'e': event_id, 'u': value < 10}) AS x FROM e WHERE event_type = 'purchase' GROUP BY ALL),
m AS (SELECT event_id, x, coalesce(epoch_us(e.ts) - epoch_us(c.ts) < 3600000000, false) AS fresh FROM e ASOF LEFT JOIN c ON e.origin = c.origin AND e.ts >= c.ts WHERE event_type <> 'purchase')
SELECT event_id, CASE WHEN fresh THEN x.e END AS entry, fresh AS from_cache, CASE WHEN fresh THEN x.u END AS unavailable FROM m""",
    ),
    "snapshot_as_of": (
        snapshot_as_of,
        """WITH s AS (SELECT user_id, ts, max(event_id) AS snapshot_id FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT event_id, snapshot_id, epoch_us(e.ts) - epoch_us(s.ts) AS age_us FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts > s.ts WHERE event_type = 'error'""",
    ),
    "config_applicability": (config_applicability, f"SELECT event_id, not_applicable, error FROM events JOIN (VALUES {_CONFIGS}) t(c, not_applicable, error) ON event_id % {len(CONFIGS)} = c"),
    "retry_after": (retry_after, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 500 WHEN 1 THEN (event_id % 60) * 60 END AS seconds FROM events"),
}

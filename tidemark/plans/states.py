"""Relations as they stand after jobs, policies, monitors and deliveries were updated, replaced or deleted; keys and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import outcomes, text, urls
from tidemark.operators import keyed, relations, scans, transitions
from tidemark.plans import bindings as b
from tidemark.sources import pages


def _day(c, fmt="yyyy-MM-dd"):
    return F.date_format(c, fmt)


def job_insert_if_new(spark, sf_dir):
    """Jobs of hourly slots; a slot that has a job, or gets its second one, adds nothing."""
    a = b.attempts(spark, sf_dir)
    jobs = a.select(F.col("origin_id").alias("monitor_id"), _day("seen_at", "yyyy-MM-dd HH").alias("slot"), F.col("attempt_id").alias("job_id"))
    return keyed.insert_if_new(jobs.filter("job_id % 4 <> 0"), jobs.filter("job_id % 4 = 0"), ["monitor_id", "slot"], ["job_id"])


def job_status_update(spark, sf_dir):
    """Jobs after their runs: the last status counts, times that a run does not tell stay; runs of jobs beyond the stored ones add nothing."""
    jobs = b.changes(spark, sf_dir).select(F.col("change_id").alias("job_id"), F.lit("pending").alias("status"), F.when(F.col("change_id") % 2 == 0, _day("detected_at")).alias("started_on"))
    runs = b.deliveries(spark, sf_dir).select((F.col("change_id") + 1).alias("job_id"), "line", "status", F.when(F.col("status") != "pending", _day("claimed_at")).alias("started_on"))
    return transitions.updated(jobs, runs, ["job_id"], ["line", "status", "started_on"])


def robots_policy_upsert(spark, sf_dir):
    """Policies of sites: a new mode is taken, the identifier and the day of creation stay."""
    old = b.table(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").cast("long").alias("site_id")).agg(F.min("c_custkey").alias("policy_id"))
    stored = old.select("site_id", "policy_id", F.lit("enforce").alias("mode"), F.lit("2024-01-01").alias("created_on"))
    mode = F.when(F.col("s_acctbal") < 0, "ignore").otherwise("enforce")
    batch = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("site_id"), F.col("s_suppkey").alias("policy_id"), mode.alias("mode"), F.lit("2024-06-01").alias("created_on"))
    return transitions.upsert_keeping(stored, batch, ["site_id"], ["policy_id"], ["policy_id", "created_on"])


def monitor_updates(spark, sf_dir):
    """Monitors after a check: a new status clears its reason, a policy stop sets one and ends the schedule."""
    k, stop = F.col("monitor_id") % 4, F.col("monitor_id") % 4 == 2
    asked = F.when(k == 0, "active").when(stop, "blocked_by_robots")
    reason = F.when(stop, "policy_stop").when(asked.isNull() & (F.col("status") == "failing"), "errors")
    return b.monitors(spark, sf_dir).select(
        "monitor_id", F.coalesce(asked, "status").alias("status"), reason.alias("status_reason"), F.when(~stop, F.unix_timestamp(F.lit(b.AS_OF)) + F.col("interval_seconds")).alias("next_run_s"), F.lit(b.AS_OF).alias("last_checked")
    )


def delivery_recorded(spark, sf_dir):
    """Deliveries, one per change and destination, after sends of those that were being sent."""
    one = keyed.first_wins(b.deliveries(spark, sf_dir), ["change_id", "destination_id"], ["line", "status", "claimed_at"])
    d = one.select("change_id", "destination_id", "line", "status", F.col("line").alias("attempt_count"))
    result = F.when(F.col("line") % 3 == 0, "delivered").when(F.col("line") % 3 == 1, "retry").otherwise("dead")
    return transitions.recorded(d, d.filter("status = 'sending'").select("change_id", "destination_id", result.alias("result")), ["change_id", "destination_id"])


def policy_replace(spark, sf_dir):
    """Fetchers of sites, in order; sites of which a new list came have that list alone."""
    stored = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("site_id"), F.col("s_suppkey").alias("fetcher_id"))
    batch = b.table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 2).cast("long").alias("site_id"), F.col("c_custkey").alias("fetcher_id"))
    return transitions.replaced(stored, batch, ["site_id"])


def fetch_plan(spark, sf_dir):
    """The first three fetchers of each site in order, and those that are not registered."""
    s = b.table(spark, sf_dir, "supplier").withColumn("site_id", F.col("s_nationkey").cast("long"))
    first = relations.within_budget(s, ["site_id"], ["s_suppkey"], 3).groupBy("site_id").agg(F.sort_array(F.collect_list("s_suppkey")).alias("l"))
    known = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: (x * 2).cast("long"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return first.select("site_id", joined(F.col("l")).alias("plan"), joined(F.array_except("l", known)).alias("unknown"))


def site_delete_cascade(spark, sf_dir):
    """Rows left in each relation after a site (a region) went with all that hangs on it."""
    sources = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), "n_regionkey")
    monitors = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_nationkey").alias("source_id"))
    changes, deliveries = b.changes(spark, sf_dir).select("change_id", "monitor_id"), b.deliveries(spark, sf_dir).select("change_id")
    gone = sources.filter("n_regionkey = 2")
    out = [("sources", keyed.without(sources, gone, ["source_id"]))]
    for name, df, key in (("monitors", monitors, "source_id"), ("changes", changes, "monitor_id"), ("deliveries", deliveries, "change_id")):
        out.append((name, keyed.without(df, gone, [key])))
        gone = df.join(gone.select(key).distinct(), key, "left_semi")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in out]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def destination_delete(spark, sf_dir):
    """Destinations asked to go: refused where deliveries that were claimed late stand on them."""
    d = b.destinations(spark, sf_dir).select("destination_id", "name")
    late = b.deliveries(spark, sf_dir).filter("claimed_at >= '1998-11-25 00:00:00'")
    return transitions.guarded_delete(d, d.filter("destination_id % 3 <> 0"), late, ["destination_id"])


def watermark_carry_over(spark, sf_dir):
    """Children whose links were not all read keep their old watermark."""
    links = b.page_links(spark, sf_dir)
    stored = b.table(spark, sf_dir, "pages").select("page_id", F.lit("2024-01-12").alias("mark"))
    return transitions.held_watermark(stored, links.select("page_id", F.col("updated_at").alias("mark"), (F.col("pos") < 6).alias("done")), ["page_id"], "mark")


def truncation_report(spark, sf_dir):
    """Per page: links seen, read and cut; a warning for any, an audit row only if something was cut."""
    n = b.page_links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("seen"), F.count_if(F.col("updated_at") < "2024-01-13").alias("old"))
    cut = F.greatest(F.col("seen") - 5, F.lit(0).cast("long"))
    return n.select("page_id", "seen", F.least("seen", F.lit(5).cast("long")).alias("read"), cut.alias("truncated"), ((cut > 0) | (F.col("old") > 0)).alias("warned"), (cut > 0).alias("audited"))


def breaker_windows(spark, sf_dir):
    """Waits before retries of a streak, and until when its origin is left alone."""
    s = scans.streaks(b.attempts(spark, sf_dir), "origin_id", ["seen_at", "attempt_id"], F.col("ok")).filter("streak > 0")
    until = transitions.breaker_until(F.col("streak"), F.col("seen_at"))
    return s.select("attempt_id", "streak", (250 * F.least("streak", F.lit(3))).cast("long").alias("retry_ms"), F.unix_timestamp(until).alias("open_until_s"))


def change_keys(spark, sf_dir):
    """Keys that make a change one change: by text for pages, by item for new ones, by item and date for updated ones."""
    key = F.when(F.col("kind") == "removed", text.sha256(F.col("dedupe_key"))).when(F.col("kind") == "new", F.col("dedupe_key")).otherwise(F.concat_ws(":", "dedupe_key", _day("detected_at")))
    return b.changes(spark, sf_dir).select("change_id", key.alias("dedupe_key"))


def path_escapes(spark, sf_dir):
    """Escapes of unreserved characters are decoded, others written in capitals."""
    byte = F.lpad(F.lower(F.hex(F.col("event_id") % 256)), 2, "0")
    return b.table(spark, sf_dir, "events").select("event_id", urls.percent_normalized(F.concat(F.lit("/x%"), byte, F.lit("/y"))).alias("path"))


def entities_decoded(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("&amp;", "&lt;", "&gt;", "&quot;", "&#65;", "&#x42;", "&nope;")])
    s = F.concat(F.lit("/p?a=1"), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")), F.lit("b"))
    return b.table(spark, sf_dir, "events").select("event_id", urls.decode_entities(s).alias("url"))


def header_charset(spark, sf_dir):
    k = F.col("event_id") % 4
    s = F.when(k == 0, "text/html").when(k == 1, "text/html; charset=UTF-8").when(k == 2, 'text/html;charset="shift_jis"').otherwise("text/xml; q=1; charset=euc-jp")
    return b.table(spark, sf_dir, "events").select("event_id", pages.charset_of(s).alias("charset"))


def fields_summary(spark, sf_dir):
    """Labelled values as lines; null without one."""
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))
    fields = F.when(F.col("p_size") % 3 != 0, F.array(pair("Brand", F.col("p_brand")), pair("Size", F.col("p_size")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    return b.table(spark, sf_dir, "part").select("p_partkey", text.fields_summary(fields).alias("summary"))


def webhook_hosts(spark, sf_dir):
    """Whether the host of a webhook is allowed: the name itself or a name below it."""
    k = F.col("destination_id") % 4
    host = F.when(k == 0, "hooks.example.org").when(k == 1, "a.hooks.example.org").when(k == 2, "evilhooks.example.org").otherwise("example.org")
    return b.destinations(spark, sf_dir).select("destination_id", outcomes.webhook_host_ok(host, ("hooks.example.org",)).alias("allowed"))


def words_ordered(spark, sf_dir):
    """Names of an element in code point order, as its attributes are written."""
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")), " ").alias("names"))


def json_fallback(spark, sf_dir):
    """JSON columns read tolerantly: text that is no JSON gives the default."""
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken"), F.col("props"))).otherwise(F.col("props"))
    return b.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(s, "k long")["k"], F.lit(-1).cast("long")).alias("k"))


QUERIES = {
    "job_insert_if_new": (
        job_insert_if_new,
        f"""WITH j AS (SELECT origin_id AS monitor_id, strftime(seen_at, '%Y-%m-%d %H') AS slot, attempt_id AS job_id FROM {b.ATTEMPTS})
SELECT monitor_id, slot, min(job_id) AS job_id FROM j WHERE job_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM j o WHERE o.job_id % 4 = 0 AND o.monitor_id = j.monitor_id AND o.slot = j.slot) GROUP BY ALL""",
    ),
    "job_status_update": (
        job_status_update,
        f"""WITH r AS (SELECT change_id + 1 AS change_id, status, CASE WHEN status <> 'pending' THEN strftime(claimed_at, '%Y-%m-%d') END AS started_on FROM {b.DELIVERIES}
QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY line DESC, status DESC, started_on DESC NULLS LAST) = 1)
SELECT c.change_id AS job_id, coalesce(r.status, 'pending') AS status, coalesce(r.started_on, CASE WHEN c.change_id % 2 = 0 THEN strftime(c.detected_at, '%Y-%m-%d') END) AS started_on
FROM {b.CHANGES} c LEFT JOIN r ON r.change_id = c.change_id""",
    ),
    "robots_policy_upsert": (
        robots_policy_upsert,
        """WITH o AS (SELECT c_nationkey::BIGINT AS site_id, min(c_custkey) AS policy_id FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL),
n AS (SELECT s_nationkey::BIGINT AS site_id, s_suppkey AS policy_id, CASE WHEN s_acctbal < 0 THEN 'ignore' ELSE 'enforce' END AS mode FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1)
SELECT site_id, coalesce(o.policy_id, n.policy_id) AS policy_id, coalesce(n.mode, 'enforce') AS mode, CASE WHEN o.policy_id IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS created_on FROM o FULL JOIN n USING (site_id)""",
    ),
    "monitor_updates": (
        monitor_updates,
        f"""SELECT monitor_id, CASE monitor_id % 4 WHEN 0 THEN 'active' WHEN 2 THEN 'blocked_by_robots' ELSE status END AS status,
CASE WHEN monitor_id % 4 = 2 THEN 'policy_stop' WHEN monitor_id % 2 = 1 AND status = 'failing' THEN 'errors' END AS status_reason,
CASE WHEN monitor_id % 4 <> 2 THEN CAST(epoch(TIMESTAMP '{b.AS_OF}') AS BIGINT) + interval_seconds END AS next_run_s, '{b.AS_OF}' AS last_checked FROM {b.MONITORS}""",
    ),
    "delivery_recorded": (
        delivery_recorded,
        f"""WITH d AS (SELECT * FROM {b.DELIVERIES} QUALIFY row_number() OVER (PARTITION BY change_id, destination_id ORDER BY line, status, claimed_at) = 1)
SELECT change_id, destination_id, line, CASE WHEN status <> 'sending' THEN status WHEN line % 3 = 0 THEN 'delivered' WHEN line % 3 = 1 THEN 'failed' ELSE 'dead' END AS status,
line + CASE WHEN status = 'sending' AND line % 3 <> 0 THEN 1 ELSE 0 END AS attempt_count FROM d""",
    ),
    "policy_replace": (
        policy_replace,
        """WITH n AS (SELECT c_nationkey::BIGINT * 2 AS site_id, c_custkey AS fetcher_id FROM customer)
SELECT s_nationkey::BIGINT AS site_id, s_suppkey AS fetcher_id FROM supplier WHERE s_nationkey NOT IN (SELECT site_id FROM n) UNION ALL SELECT * FROM n""",
    ),
    "fetch_plan": (
        fetch_plan,
        """SELECT s_nationkey::BIGINT AS site_id, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS plan,
coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey BETWEEN 2 AND 100)), '') AS unknown
FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 3) GROUP BY s_nationkey""",
    ),
    "site_delete_cascade": (
        site_delete_cascade,
        f"""WITH s AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), m AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM s)), c AS (SELECT change_id FROM {b.CHANGES} WHERE monitor_id IN (FROM m))
SELECT 'sources' AS relation, count(*) AS n FROM nation WHERE n_nationkey NOT IN (FROM s) UNION ALL SELECT 'monitors', count(*) FROM customer WHERE c_custkey NOT IN (FROM m)
UNION ALL SELECT 'changes', count(*) FROM {b.CHANGES} WHERE change_id NOT IN (FROM c) UNION ALL SELECT 'deliveries', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM c)""",
    ),
    "destination_delete": (
        destination_delete,
        f"""SELECT destination_id, name, CASE WHEN destination_id % 3 = 0 THEN 'kept' WHEN destination_id IN (SELECT destination_id FROM {b.DELIVERIES} WHERE claimed_at >= TIMESTAMP '1998-11-25') THEN 'refused' ELSE 'deleted' END AS outcome
FROM {b.DESTINATIONS}""",
    ),
    "watermark_carry_over": (
        watermark_carry_over,
        f"""SELECT p.page_id, CASE WHEN d THEN greatest('2024-01-12', m) ELSE '2024-01-12' END AS mark FROM pages p
LEFT JOIN (SELECT page_id, max(updated_at) AS m, bool_and(pos < 6) AS d FROM {b.LINKS} GROUP BY page_id) l ON l.page_id = p.page_id""",
    ),
    "truncation_report": (
        truncation_report,
        f"""SELECT page_id, count(*) AS seen, least(count(*), 5) AS read, greatest(count(*) - 5, 0) AS truncated, count(*) > 5 OR count(*) FILTER (WHERE updated_at < '2024-01-13') > 0 AS warned, count(*) > 5 AS audited
FROM {b.LINKS} GROUP BY page_id""",
    ),
    "breaker_windows": (
        breaker_windows,
        f"""SELECT attempt_id, streak, 250 * least(streak, 3) AS retry_ms, CASE WHEN streak >= 5 THEN CAST(floor(epoch(seen_at)) AS BIGINT) + 300 END AS open_until_s FROM (
SELECT attempt_id, seen_at, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY origin_id, g ORDER BY seen_at, attempt_id) AS BIGINT) AS streak FROM (
SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY origin_id ORDER BY seen_at, attempt_id) AS g FROM {b.ATTEMPTS})) WHERE streak > 0""",
    ),
    "change_keys": (change_keys, f"SELECT change_id, CASE kind WHEN 'removed' THEN sha256(dedupe_key) WHEN 'new' THEN dedupe_key ELSE dedupe_key || ':' || strftime(detected_at, '%Y-%m-%d') END AS dedupe_key FROM {b.CHANGES}"),
    "path_escapes": (
        path_escapes,
        """SELECT event_id, '/x' || CASE WHEN k < 128 AND regexp_full_match(chr(k::INTEGER), '[A-Za-z0-9._~-]') THEN chr(k::INTEGER) ELSE '%' || upper(printf('%02x', k)) END || '/y' AS path
FROM (SELECT event_id, event_id % 256 AS k FROM events)""",
    ),
    "entities_decoded": (entities_decoded, "SELECT event_id, '/p?a=1' || (['&', '<', '>', '\"', 'A', 'B', '&nope;'])[event_id % 7 + 1] || 'b' AS url FROM events"),
    "header_charset": (header_charset, "SELECT event_id, (['', 'utf-8', 'shift_jis', 'euc-jp'])[event_id % 4 + 1] AS charset FROM events"),
    "fields_summary": (fields_summary, "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'Brand: ' || p_brand || chr(10) || 'Size: ' || p_size END AS summary FROM part"),
    "webhook_hosts": (webhook_hosts, "SELECT s_suppkey AS destination_id, s_suppkey % 4 < 2 AS allowed FROM supplier"),
    "words_ordered": (words_ordered, "SELECT p_partkey, array_to_string(list_sort(string_split(p_name || ' ' || p_type, ' ')), ' ') AS names FROM part"),
    "json_fallback": (json_fallback, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"),
}

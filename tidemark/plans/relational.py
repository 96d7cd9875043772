"""Lookups, lists, joins, counts and keyed writes over the stored relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import outcomes
from tidemark.operators import keyed, pagination, relations
from tidemark.plans import bindings as b
from tidemark.plans.bindings import AS_OF


def monitor_lookup(spark, sf_dir):
    return b.monitors(spark, sf_dir).filter("monitor_id = 7").select("monitor_id", "site_id", "status", "interval_seconds")


def monitors_due(spark, sf_dir):
    return b.monitors(spark, sf_dir).filter((F.col("status") == "active") & (F.col("next_run_at") <= F.lit(AS_OF).cast("timestamp"))).orderBy("next_run_at", "monitor_id").select("monitor_id", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run_at"))


def reconcile_overdue(spark, sf_dir):
    """Due for longer than five minutes."""
    late = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 5 MINUTES")
    return b.monitors(spark, sf_dir).filter((F.col("status") == "active") & (F.col("next_run_at") <= late)).select("monitor_id", (F.unix_timestamp(F.lit(AS_OF)) - F.unix_timestamp("next_run_at")).alias("late_s"))


def monitors_runnable(spark, sf_dir):
    s = F.col("status")
    skip = s.isin("archived", "blocked_by_robots")
    return b.monitors(spark, sf_dir).select("monitor_id", (~skip & (s != "paused")).alias("scheduled"), (~skip).alias("manual"))


def changes_page(spark, sf_dir):
    rows = relations.page(b.changes(spark, sf_dir), [F.col("detected_at").desc(), "change_id"], 50, 100)
    return rows.select("change_id", "monitor_id", "kind", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected_at"))


def changes_count(spark, sf_dir):
    return b.changes(spark, sf_dir).groupBy("monitor_id", "kind").agg(F.count("*").alias("n"))


def attempts_page(spark, sf_dir):
    return relations.page(b.attempts(spark, sf_dir), ["seen_at", "attempt_id"], 25, 50).select("attempt_id", "origin_id", "status_code")


def deliveries_deep_page(spark, sf_dir):
    """Five hundred rows from the middle of all deliveries, the newest claims first."""
    held = pagination.in_ranges(b.deliveries(spark, sf_dir), [F.col("claimed_at").desc(), "change_id", "line"])
    return held.page(500, held.total // 2).select("change_id", "line", "status", F.date_format("claimed_at", "yyyy-MM-dd").alias("claimed_on"))


def latest_snapshot(spark, sf_dir):
    rows = b.attempts(spark, sf_dir).select("origin_id", "seen_at", "attempt_id", "status_code")
    return keyed.latest(rows, ["origin_id"], ["seen_at", "attempt_id"]).select("origin_id", "attempt_id", "status_code")


def subscription_match(spark, sf_dir):
    """How many changes each live subscription gets."""
    customer = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_nationkey").cast("long").alias("site_id"))
    live = b.destinations(spark, sf_dir).filter("archived_at is null").select("destination_id")
    subs = b.subscriptions(spark, sf_dir).join(live, "destination_id")
    met = relations.wildcard_match(b.changes(spark, sf_dir).select("change_id", "monitor_id", "kind").join(customer, "monitor_id"), subs)
    return met.groupBy("subscription_id", "destination_id").agg(F.count("*").alias("n_changes"), F.max("change_id").alias("last_change"))


def pending_delivery_join(spark, sf_dir):
    d = b.deliveries(spark, sf_dir).filter("status = 'pending'")
    dest = b.destinations(spark, sf_dir).select("destination_id", F.col("name").alias("destination"), F.col("archived_at").isNotNull().alias("archived"))
    c = b.changes(spark, sf_dir).select("change_id", "monitor_id", "kind")
    m = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_name").alias("monitor"), F.col("c_nationkey").alias("n_nationkey"))
    s = b.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("source"), F.col("n_regionkey").alias("r_regionkey"))
    site = b.table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("site"))
    out = d.join(c, "change_id").join(dest, "destination_id").join(m, "monitor_id").join(s, "n_nationkey").join(site, "r_regionkey")
    return out.select("change_id", "line", "destination_id", "destination", "archived", "kind", "monitor", "source", "site")


def robots_mode_default(spark, sf_dir):
    """Sites without a policy enforce robots rules; any active override is told per region."""
    n = b.table(spark, sf_dir, "nation")
    modes = b.table(spark, sf_dir, "supplier").filter("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.lit("ignore").alias("mode"))
    return n.join(modes, "n_nationkey", "left").groupBy("n_regionkey").agg(F.count_if(F.coalesce("mode", F.lit("enforce")) == "enforce").alias("enforced"), F.coalesce(F.bool_or(F.col("mode") == "ignore"), F.lit(False)).alias("has_active_override"))


def existing_target_lookup(spark, sf_dir):
    """Items of a feed with the watermark of the target they stand for, if there is one."""
    items = b.page_links(spark, sf_dir)
    stored = keyed.first_wins(items.filter("pos % 2 = 0").select("page_id", "href", F.col("updated_at").alias("known"), "pos"), ["page_id", "href"], ["pos"]).drop("pos")
    return items.join(stored, ["page_id", "href"], "left").select("page_id", "pos", F.col("known").isNull().alias("is_new"), "known")


def change_insert_if_new(spark, sf_dir):
    c = b.changes(spark, sf_dir)
    new = keyed.insert_if_new(c.filter("change_id % 3 <> 0"), c.filter("change_id % 3 = 0"), ["monitor_id", "dedupe_key"], ["detected_at", "change_id"])
    return new.select("monitor_id", "dedupe_key", "change_id", "kind")


def change_with_existing(spark, sf_dir):
    c = b.changes(spark, sf_dir)
    both = keyed.with_existing(c.filter("change_id % 3 <> 0"), c.filter("change_id % 3 = 0"), ["monitor_id", "dedupe_key"], ["detected_at", "change_id"], "change_id")
    return both.select("monitor_id", "dedupe_key", "change_id", "inserted")


def delivery_insert_if_new(spark, sf_dir):
    d = b.deliveries(spark, sf_dir)
    new = keyed.insert_if_new(d.filter("status <> 'delivered'"), d.filter("status = 'delivered'"), ["change_id", "destination_id"], ["line"])
    return new.select("change_id", "destination_id", "line")


def target_upsert(spark, sf_dir):
    a = b.attempts(spark, sf_dir)
    stored = keyed.latest(a.filter("attempt_id % 2 = 0").select("origin_id", "attempt_id", "status_code"), ["origin_id"], ["attempt_id"])
    batch = a.filter("attempt_id % 2 = 1").select("origin_id", "attempt_id", F.when(F.col("status_code") != 429, F.col("status_code")).alias("status_code"))
    return keyed.upsert(stored, batch, ["origin_id"], ["attempt_id"])


def watermark_advance(spark, sf_dir):
    a = b.attempts(spark, sf_dir)
    stored = a.filter("attempt_id % 2 = 0").groupBy("origin_id").agg(F.max("attempt_id").alias("mark"))
    return keyed.advance_watermark(stored, a.filter("attempt_id % 2 = 1").select("origin_id", F.col("attempt_id").alias("mark")), ["origin_id"], "mark")


def monitor_delete_cascade(spark, sf_dir):
    """Deliveries, changes and monitors left after the monitors of one site went."""
    gone = b.table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("monitor_id"))
    c = b.changes(spark, sf_dir)
    kept = keyed.without(c, gone, ["monitor_id"])
    d = keyed.without(b.deliveries(spark, sf_dir), c.join(gone, "monitor_id", "left_semi"), ["change_id"])
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
    return one(kept, "changes").unionByName(one(d, "deliveries"))


def destination_archive(spark, sf_dir):
    """Archiving again changes nothing; a new archive wipes the secret."""
    wanted = F.col("destination_id") % 3 == 0
    at = F.when(wanted & F.col("archived_at").isNull(), F.lit("2024-06-01 00:00:00").cast("timestamp")).otherwise(F.col("archived_at"))
    return b.destinations(spark, sf_dir).select("destination_id", F.date_format(at, "yyyy-MM-dd").alias("archived_on"), F.when(at.isNull(), F.col("name")).otherwise("").alias("secret"))


def guard_children(spark, sf_dir):
    """Changes that may be deleted: those without deliveries."""
    return keyed.without(b.changes(spark, sf_dir), b.deliveries(spark, sf_dir), ["change_id"]).select("change_id", "kind")


def monitor_policy_join(spark, sf_dir):
    """Monitors with their ordered fetchers; those without a policy are told."""
    m = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_nationkey").cast("long").alias("site"))
    entries = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("site"), F.col("s_suppkey").alias("fetcher"))
    policy = entries.groupBy("site").agg(F.count("*").alias("n_fetchers"), F.min("fetcher").alias("first_fetcher"))
    return m.join(policy, "site", "left").select("monitor_id", F.coalesce("n_fetchers", F.lit(0)).alias("n_fetchers"), "first_fetcher", F.col("n_fetchers").isNull().alias("missing"))


def change_serialized(spark, sf_dir):
    d = b.deliveries(spark, sf_dir).filter("line = 1")
    return b.changes(spark, sf_dir).join(d, "change_id", "left").select("change_id", F.concat(F.lit("c-"), F.col("change_id").cast("string")).alias("id"), F.col("status").isNotNull().alias("has_delivery"), F.coalesce("status", F.lit("none")).alias("status"))


def audit_recent(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return relations.page(e, [F.col("ts").desc(), "event_id"], 200).select("event_id", "event_type", "k")


def delivery_claim(spark, sf_dir):
    """Claims: pending ones, and those whose claim is older than five minutes at the clock given."""
    now = F.lit("1996-01-01 00:00:00").cast("timestamp")
    stale = (F.col("status") == "sending") & (F.col("claimed_at") < now - F.expr("INTERVAL 5 MINUTES"))
    claimed = (F.col("status") == "pending") | stale
    return b.deliveries(spark, sf_dir).select("change_id", "line", claimed.alias("claimed"), F.when(claimed, "sending").otherwise(F.col("status")).alias("status"))


def webhook_crypto(spark, sf_dir):
    """Secrets sealed and opened again; envelopes are as many as secrets."""
    key, iv = F.lit(b"0123456789abcdef0123456789abcdef"), F.substring(F.unhex(F.sha2(F.col("destination_id").cast("string"), 256)), 1, 12)
    secret = F.concat(F.lit("https://hooks.example.org/"), F.col("name"))
    rows = b.destinations(spark, sf_dir).select("destination_id", secret.alias("secret"), outcomes.sealed(secret, key, iv).alias("envelope"))
    return rows.select("destination_id", "secret", outcomes.opened(F.col("envelope"), key).alias("opened"), F.col("envelope").startswith("enc:v1:").alias("sealed"))


QUERIES = {
    "monitor_lookup": (monitor_lookup, f"SELECT monitor_id, site_id, status, interval_seconds FROM {b.MONITORS} WHERE monitor_id = 7"),
    "monitors_due": (monitors_due, f"SELECT monitor_id, strftime(next_run_at, '%Y-%m-%d %H:%M:%S') AS next_run_at FROM {b.MONITORS} WHERE status = 'active' AND next_run_at <= TIMESTAMP '{AS_OF}'"),
    "reconcile_overdue": (reconcile_overdue, f"SELECT monitor_id, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(next_run_at) AS BIGINT) AS late_s FROM {b.MONITORS} WHERE status = 'active' AND next_run_at <= TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE"),
    "monitors_runnable": (monitors_runnable, f"SELECT monitor_id, status NOT IN ('archived', 'blocked_by_robots', 'paused') AS scheduled, status NOT IN ('archived', 'blocked_by_robots') AS manual FROM {b.MONITORS}"),
    "changes_page": (changes_page, f"SELECT change_id, monitor_id, kind, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at FROM (SELECT * FROM {b.CHANGES} ORDER BY detected_at DESC, change_id LIMIT 50 OFFSET 100)"),
    "changes_count": (changes_count, f"SELECT monitor_id, kind, count(*) AS n FROM {b.CHANGES} GROUP BY ALL"),
    "attempts_page": (attempts_page, f"SELECT attempt_id, origin_id, status_code FROM (SELECT * FROM {b.ATTEMPTS} ORDER BY seen_at, attempt_id LIMIT 25 OFFSET 50)"),
    "deliveries_deep_page": (
        deliveries_deep_page,
        f"""WITH d AS {b.DELIVERIES}, n AS (SELECT *, row_number() OVER (ORDER BY claimed_at DESC, change_id, line) AS place FROM d)
SELECT change_id, line, status, strftime(claimed_at, '%Y-%m-%d') AS claimed_on FROM n WHERE place > (SELECT count(*) FROM d) // 2 AND place <= (SELECT count(*) FROM d) // 2 + 500""",
    ),
    "latest_snapshot": (latest_snapshot, f"SELECT origin_id, attempt_id, status_code FROM {b.ATTEMPTS} QUALIFY row_number() OVER (PARTITION BY origin_id ORDER BY seen_at DESC, attempt_id DESC) = 1"),
    "subscription_match": (
        subscription_match,
        f"""WITH c AS (SELECT change_id, monitor_id, kind = 'new' AS fresh, c_nationkey AS site FROM {b.CHANGES} JOIN customer ON c_custkey = monitor_id),
s AS (SELECT subscription_id, destination_id, site_id, monitor_id, kind IS NULL AS any_kind FROM {b.SUBSCRIPTIONS} WHERE destination_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)),
m AS (SELECT subscription_id, destination_id, change_id FROM s JOIN c ON s.monitor_id = c.monitor_id AND coalesce(s.site_id, c.site) = c.site AND (any_kind OR fresh) UNION ALL
      SELECT subscription_id, destination_id, change_id FROM s JOIN c ON s.monitor_id IS NULL AND s.site_id = c.site AND (any_kind OR fresh) UNION ALL
      SELECT subscription_id, destination_id, change_id FROM s CROSS JOIN c WHERE s.monitor_id IS NULL AND s.site_id IS NULL AND (any_kind OR fresh))
SELECT subscription_id, destination_id, count(*) AS n_changes, max(change_id) AS last_change FROM m GROUP BY ALL""",
    ),
    "pending_delivery_join": (
        pending_delivery_join,
        f"""SELECT d.change_id, d.line, d.destination_id, t.name AS destination, t.archived_at IS NOT NULL AS archived, c.kind, m.c_name AS monitor, n.n_name AS source, r.r_name AS site
FROM {b.DELIVERIES} d JOIN {b.CHANGES} c USING (change_id) JOIN {b.DESTINATIONS} t USING (destination_id) JOIN customer m ON m.c_custkey = c.monitor_id
JOIN nation n ON n.n_nationkey = m.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE d.status = 'pending'""",
    ),
    "robots_mode_default": (
        robots_mode_default,
        """SELECT n_regionkey, count(*) FILTER (WHERE mode IS NULL) AS enforced, bool_or(mode IS NOT NULL) AS has_active_override FROM nation
LEFT JOIN (SELECT DISTINCT s_nationkey, 'ignore' AS mode FROM supplier WHERE s_acctbal < 0) s ON s_nationkey = n_nationkey GROUP BY n_regionkey""",
    ),
    "existing_target_lookup": (
        existing_target_lookup,
        f"""WITH l AS {b.LINKS}, s AS (SELECT page_id, href, updated_at AS known FROM l WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
SELECT page_id, pos, known IS NULL AS is_new, known FROM l LEFT JOIN s USING (page_id, href)""",
    ),
    "change_insert_if_new": (
        change_insert_if_new,
        f"""WITH c AS {b.CHANGES} SELECT monitor_id, dedupe_key, change_id, kind FROM c WHERE change_id % 3 <> 0 AND (monitor_id, dedupe_key) NOT IN (SELECT (monitor_id, dedupe_key) FROM c WHERE change_id % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY monitor_id, dedupe_key ORDER BY detected_at, change_id) = 1""",
    ),
    "change_with_existing": (
        change_with_existing,
        f"""WITH c AS {b.CHANGES}, o AS (SELECT monitor_id, dedupe_key, min(change_id) AS old FROM c WHERE change_id % 3 = 0 GROUP BY ALL),
n AS (SELECT * FROM c WHERE change_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY monitor_id, dedupe_key ORDER BY detected_at, change_id) = 1)
SELECT monitor_id, dedupe_key, coalesce(old, change_id) AS change_id, old IS NULL AS inserted FROM n LEFT JOIN o USING (monitor_id, dedupe_key)""",
    ),
    "delivery_insert_if_new": (
        delivery_insert_if_new,
        f"""WITH d AS {b.DELIVERIES} SELECT change_id, destination_id, min(line) AS line FROM d WHERE status <> 'delivered'
AND NOT EXISTS (SELECT 1 FROM d e WHERE e.status = 'delivered' AND e.change_id = d.change_id AND e.destination_id = d.destination_id) GROUP BY ALL""",
    ),
    "target_upsert": (
        target_upsert,
        f"""WITH a AS {b.ATTEMPTS}, s AS (SELECT origin_id, attempt_id, status_code FROM a WHERE attempt_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY origin_id ORDER BY attempt_id DESC) = 1),
n AS (SELECT origin_id, attempt_id, CASE WHEN status_code <> 429 THEN status_code END AS status_code FROM a WHERE attempt_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY origin_id ORDER BY attempt_id DESC) = 1)
SELECT origin_id, coalesce(n.attempt_id, s.attempt_id) AS attempt_id, coalesce(n.status_code, s.status_code) AS status_code FROM s FULL JOIN n USING (origin_id)""",
    ),
    "watermark_advance": (
        watermark_advance,
        f"""WITH a AS {b.ATTEMPTS} SELECT origin_id, greatest(max(attempt_id) FILTER (WHERE attempt_id % 2 = 0), max(attempt_id) FILTER (WHERE attempt_id % 2 = 1)) AS mark FROM a
GROUP BY origin_id HAVING count(*) FILTER (WHERE attempt_id % 2 = 0) > 0""",
    ),
    "monitor_delete_cascade": (
        monitor_delete_cascade,
        f"""WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), c AS {b.CHANGES}
SELECT 'changes' AS relation, count(*) AS n FROM c WHERE monitor_id NOT IN (SELECT * FROM g) UNION ALL
SELECT 'deliveries', count(*) FROM {b.DELIVERIES} WHERE change_id NOT IN (SELECT change_id FROM c WHERE monitor_id IN (SELECT * FROM g))""",
    ),
    "destination_archive": (
        destination_archive,
        f"""SELECT destination_id, strftime(gone_at, '%Y-%m-%d') AS archived_on, CASE WHEN gone_at IS NULL THEN name ELSE '' END AS secret
FROM (SELECT *, coalesce(archived_at, CASE WHEN destination_id % 3 = 0 THEN TIMESTAMP '2024-06-01' END) AS gone_at FROM {b.DESTINATIONS})""",
    ),
    "guard_children": (guard_children, f"SELECT change_id, kind FROM {b.CHANGES} WHERE change_id NOT IN (SELECT l_orderkey FROM lineitem)"),
    "monitor_policy_join": (
        monitor_policy_join,
        """SELECT c_custkey AS monitor_id, coalesce(n, 0) AS n_fetchers, f AS first_fetcher, n IS NULL AS missing FROM customer
LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS f FROM supplier GROUP BY ALL) ON s_nationkey = c_nationkey""",
    ),
    "change_serialized": (
        change_serialized,
        f"""SELECT c.change_id, 'c-' || c.change_id AS id, d.status IS NOT NULL AS has_delivery, coalesce(d.status, 'none') AS status FROM {b.CHANGES} c
LEFT JOIN (SELECT * FROM {b.DELIVERIES} WHERE line = 1) d USING (change_id)""",
    ),
    "audit_recent": (audit_recent, "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 200)"),
    "delivery_claim": (
        delivery_claim,
        f"""SELECT change_id, line, x AS claimed, CASE WHEN x THEN 'sending' ELSE status END AS status FROM (SELECT *, status = 'pending' OR (status = 'sending' AND claimed_at < TIMESTAMP '1995-12-31 23:55:00') AS x FROM {b.DELIVERIES})""",
    ),
    "webhook_crypto": (webhook_crypto, "SELECT s_suppkey AS destination_id, 'https://hooks.example.org/' || s_name AS secret, 'https://hooks.example.org/' || s_name AS opened, true AS sealed FROM supplier"),
}

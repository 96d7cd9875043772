"""The engine's relations over the driver's tables: captures, changes, subscriptions, deliveries and attempts by formula.

Each relation stands here twice, as a DataFrame and as a DuckDB sub-query of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls

AS_OF = "2024-01-01 02:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """monitor_id, site_id, url, status, interval_seconds, next_run_at (null for every seventh)."""
    k = F.col("page_id") % 10
    status = F.when(k == 0, "paused").when(k == 1, "blocked_by_robots").when(k == 2, "archived").when(k == 3, "failing").otherwise("active")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("monitor_id"), urls.origin(F.col("url")).alias("site_id"), "url", status.alias("status"), (300 * (1 + F.col("page_id") % 12)).alias("interval_seconds"),
        F.when(F.col("page_id") % 7 != 0, F.timestamp_seconds(F.unix_timestamp(start) + 60 * F.col("page_id"))).alias("next_run_at"),
    )


MONITORS = """(SELECT page_id AS monitor_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS site_id, url,
  CASE page_id % 10 WHEN 0 THEN 'paused' WHEN 1 THEN 'blocked_by_robots' WHEN 2 THEN 'archived' WHEN 3 THEN 'failing' ELSE 'active' END AS status,
  300 * (1 + page_id % 12) AS interval_seconds,
  CASE WHEN page_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(page_id) END AS next_run_at FROM pages)"""


def second_body(html: Column, key: Column) -> Column:
    """What a second capture finds: the same, another comment, other markup, more text, or nothing (null)."""
    return (
        F.when(key % 5 == 0, html)
        .when(key % 5 == 1, F.replace(html, F.lit("<!-- ad "), F.lit("<!-- advert ")))
        .when(key % 5 == 2, F.replace(F.replace(html, F.lit("<article>"), F.lit("<section>")), F.lit("</article>"), F.lit("</section>")))
        .when(key % 5 == 3, F.replace(html, F.lit("</article>"), F.lit("<p>Updated body</p></article>")))
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """monitor_id, url, round, body: one scan, both captures from it."""
    p = table(spark, sf_dir, "pages")
    second = second_body(F.col("html"), F.col("page_id"))
    both = F.array(F.struct(F.lit(1).cast("long").alias("round"), F.col("html").alias("body")), F.struct(F.lit(2).cast("long").alias("round"), second.alias("body")))
    return p.select(F.col("page_id").alias("monitor_id"), "url", F.inline(both)).filter("body is not null")


CAPTURES = """(SELECT page_id AS monitor_id, url, 1::BIGINT AS round, html AS body FROM pages UNION ALL
  SELECT page_id, url, 2::BIGINT, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN replace(html, '<!-- ad ', '<!-- advert ')
    WHEN 2 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>')
    WHEN 3 THEN replace(html, '</article>', '<p>Updated body</p></article>') END FROM pages WHERE page_id % 5 <> 4)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, monitor_id, kind, detected_at, dedupe_key."""
    kind = F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "O", "updated").otherwise("removed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("monitor_id"), kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("detected_at"), F.col("o_orderpriority").alias("dedupe_key")
    )


CHANGES = """(SELECT o_orderkey AS change_id, o_custkey AS monitor_id, CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'updated' ELSE 'removed' END AS kind,
  o_orderdate AS detected_at, o_orderpriority AS dedupe_key FROM orders)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subscription_id, destination_id, site_id, monitor_id, kind: null stands for any."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("subscription_id"), (k % 10).alias("destination_id"), F.when(k % 50 != 0, F.col("c_nationkey").cast("long")).alias("site_id"), F.when(k % 10 != 0, k).alias("monitor_id"), F.when(k % 2 != 0, "new").alias("kind")
    )


SUBSCRIPTIONS = """(SELECT c_custkey AS subscription_id, c_custkey % 10 AS destination_id, CASE WHEN c_custkey % 50 <> 0 THEN c_nationkey::BIGINT END AS site_id,
  CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS monitor_id, CASE WHEN c_custkey % 2 <> 0 THEN 'new' END AS kind FROM customer)"""


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """destination_id, name, archived_at (set for every fourth)."""
    archived = F.when(F.col("s_suppkey") % 4 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("destination_id"), F.col("s_name").alias("name"), archived.alias("archived_at"))


DESTINATIONS = "(SELECT s_suppkey AS destination_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-01' END AS archived_at FROM supplier)"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, destination_id, line, status, claimed_at."""
    status = F.when(F.col("l_returnflag") == "A", "delivered").when(F.col("l_returnflag") == "R", "sending").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("change_id"), F.col("l_suppkey").alias("destination_id"), F.col("l_linenumber").cast("long").alias("line"), status.alias("status"), F.col("l_shipdate").cast("timestamp").alias("claimed_at")
    )


DELIVERIES = """(SELECT l_orderkey AS change_id, l_suppkey AS destination_id, l_linenumber::BIGINT AS line,
  CASE l_returnflag WHEN 'A' THEN 'delivered' WHEN 'R' THEN 'sending' ELSE 'pending' END AS status, l_shipdate AS claimed_at FROM lineitem)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, origin_id, seen_at, ok, status_code, value."""
    code = F.when(F.col("event_type") == "error", 500 + F.col("event_id") % 5).when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "click", 404).otherwise(200)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("origin_id"), F.col("ts").cast("timestamp").alias("seen_at"), (F.col("event_type") != "error").alias("ok"), code.cast("long").alias("status_code"), "value"
    )


ATTEMPTS = """(SELECT event_id AS attempt_id, user_id AS origin_id, ts AS seen_at, event_type <> 'error' AS ok,
  CASE event_type WHEN 'error' THEN 500 + event_id % 5 WHEN 'signup' THEN 429 WHEN 'click' THEN 404 ELSE 200 END::BIGINT AS status_code, value FROM events)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, site_id, pos, href, updated_at: links as feed items or sitemap entries, dates by formula."""
    found = table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("site_id"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    day = (F.col("page_id") * 7 + F.col("pos")) % 10
    return found.select("page_id", "site_id", F.col("pos").cast("long").alias("pos"), "href", F.concat(F.lit("2024-01-"), F.lpad((10 + day).cast("string"), 2, "0")).alias("updated_at"))


LINKS = """(SELECT page_id, site_id, pos, href, '2024-01-' || CAST(10 + (page_id * 7 + pos) % 10 AS VARCHAR) AS updated_at FROM
  (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS site_id, unnest(l) AS href, unnest(range(len(l)))::BIGINT AS pos
   FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)))"""

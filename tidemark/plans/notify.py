"""Notifications: payloads, deliveries and their outcomes, the limiter."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, outcomes, text
from tidemark.operators.tables import shared_folder
from tidemark.plans import bindings as b
from tidemark.streaming import delivery, limiter


def notification_payload(spark, sf_dir):
    """Changes with and without a title, a preview (none, empty, short, too long) and a time that is one."""
    n = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_name").alias("site"))
    c, k = b.changes(spark, sf_dir).join(n, "monitor_id"), F.col("change_id")
    title = F.when(k % 3 == 0, None).when(k % 3 == 1, F.repeat(F.lit("t"), 300)).otherwise(F.concat(F.lit("Change "), k.cast("string")))
    preview = F.when(k % 4 == 1, "").when(k % 4 == 2, "+ added").when(k % 4 == 3, F.repeat(F.lit("-x"), 500))
    at = F.when(k % 5 == 0, "unknown").otherwise(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return c.select("change_id", outcomes.payload(title, F.col("kind"), F.concat(F.lit("https://x.org/"), k.cast("string")), F.col("site"), preview, at).alias("payload"))


def jst_format(spark, sf_dir):
    s = F.when(F.col("change_id") % 5 == 0, "unknown").otherwise(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return b.changes(spark, sf_dir).select("change_id", dates.shifted(s).alias("shown"))


def preview_truncation(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return b.table(spark, sf_dir, "documents").select("doc_id", text.sha256(text.preview(t)).alias("preview"), text.shortened(t).alias("short"))


def webhook_mask(spark, sf_dir):
    u = F.when(F.col("destination_id") % 7 == 0, F.col("name")).otherwise(F.concat(F.lit("https://hooks.example.org/"), F.col("name")))
    return b.destinations(spark, sf_dir).select("destination_id", outcomes.masked_url(u).alias("masked"))


def delivery_outcomes(spark, sf_dir):
    """Events of a user as attempts of a delivery (five users' events each), numbered by time."""
    a = b.attempts(spark, sf_dir)
    group = F.concat_ws("-", "origin_id", (F.floor(F.col("attempt_id") / 700)).cast("string"))
    order = Window.partitionBy("delivery_id").orderBy("seen_at", "attempt_id")
    rows = a.withColumn("delivery_id", group).select("delivery_id", F.row_number().over(order).cast("long").alias("attempt_no"), delivery.result(F.col("status_code"), F.lit(None).cast("string")).alias("result"))
    return delivery.settled(rows)


def limiter_decisions(spark, sf_dir):
    return limiter.limited(limiter.attempts_of(b.attempts(spark, sf_dir)))


def schedule_next(spark, sf_dir):
    """Next run: the slot plus the interval plus a jitter by hash."""
    jitter = outcomes.jitter_s(F.col("monitor_id").cast("string"), F.col("interval_seconds"))
    return b.monitors(spark, sf_dir).select("monitor_id", (F.unix_timestamp(F.lit(b.AS_OF)) + F.col("interval_seconds") + jitter).alias("next_run_s"))


def change_stream(spark, sf_dir):
    """Orders streamed twice into a change table: the second time adds nothing."""
    at = f"{shared_folder(spark)}/stream/{uuid.uuid4().hex}"
    source = b.changes(spark, sf_dir)
    source.write.parquet(f"{at}/in")
    for run in (1, 2):
        stream = spark.readStream.schema(source.schema).parquet(f"{at}/in")
        delivery.write_stream(stream, f"{at}/out", f"{at}/checkpoint{run}", ["monitor_id", "dedupe_key"], ["detected_at", "change_id"]).awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{at}/out").select("monitor_id", "dedupe_key", "change_id", "kind")


QUERIES = {
    "notification_payload": (
        notification_payload,
        rf"""SELECT change_id, '{{"embeds":[{{"title":"' || CASE change_id % 3 WHEN 0 THEN c_name WHEN 1 THEN repeat('t', 255) || '…' ELSE 'Change ' || change_id END
 || '","color":' || CASE kind WHEN 'new' THEN 5763719 WHEN 'updated' THEN 16705372 ELSE 15548997 END
 || ',"description":"**種別**: ' || CASE kind WHEN 'new' THEN '新規検出' WHEN 'updated' THEN '更新検出' ELSE '削除検出' END || '\n**URL**: https://x.org/' || change_id
 || '\n**検出日時**: ' || CASE WHEN change_id % 5 = 0 THEN 'unknown' ELSE strftime(detected_at, '%Y-%m-%d') || ' 09:00:00 JST' END
 || CASE change_id % 4 WHEN 2 THEN '\n```diff\n+ added\n```' WHEN 3 THEN '\n```diff\n' || repeat('-x', 450) || '\n…(truncated)\n```' ELSE '' END || '"'
 || CASE WHEN change_id % 5 = 0 THEN '' ELSE ',"timestamp":"' || strftime(detected_at, '%Y-%m-%d') || 'T00:00:00.000Z"' END || '}}]}}' AS payload
FROM {b.CHANGES} JOIN customer ON c_custkey = monitor_id""",
    ),
    "jst_format": (jst_format, f"SELECT change_id, CASE WHEN change_id % 5 = 0 THEN 'unknown' ELSE strftime(detected_at + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' JST' END AS shown FROM {b.CHANGES}"),
    "preview_truncation": (
        preview_truncation,
        """SELECT doc_id, sha256(CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || chr(10) || '… (truncated)' ELSE t END) AS preview, CASE WHEN length(t) > 256 THEN substr(t, 1, 255) || '…' ELSE t END AS short
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    ),
    "webhook_mask": (webhook_mask, "SELECT s_suppkey AS destination_id, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'hooks.example.org/' END || '***' || right(s_name, 4) AS masked FROM supplier"),
    "delivery_outcomes": (
        delivery_outcomes,
        f"""WITH a AS (SELECT origin_id || '-' || attempt_id // 700 AS delivery_id, row_number() OVER (PARTITION BY origin_id, attempt_id // 700 ORDER BY seen_at, attempt_id) AS n, status_code FROM {b.ATTEMPTS}),
s AS (SELECT delivery_id, max(n) AS made, min(n) FILTER (WHERE status_code IN (200, 404)) AS ends FROM a WHERE n <= 5 GROUP BY ALL)
SELECT s.delivery_id, CASE WHEN ends IS NOT NULL THEN CASE a.status_code WHEN 200 THEN 'delivered' ELSE 'dead' END WHEN made >= 5 THEN 'dead' ELSE 'failed' END AS status, coalesce(ends, made) AS attempts
FROM s LEFT JOIN a ON a.delivery_id = s.delivery_id AND a.n = s.ends""",
    ),
    "limiter_decisions": (limiter_decisions, None),
    "schedule_next": (
        schedule_next,
        f"""SELECT monitor_id, CAST(epoch(TIMESTAMP '{b.AS_OF}') AS BIGINT) + interval_seconds + CAST(('0x' || substr(md5(CAST(monitor_id AS VARCHAR)), 1, 8)) AS BIGINT) % (least(interval_seconds // 10, 60) + 1) AS next_run_s
FROM {b.MONITORS}""",
    ),
    "change_stream": (change_stream, f"SELECT monitor_id, dedupe_key, change_id, kind FROM {b.CHANGES} QUALIFY row_number() OVER (PARTITION BY monitor_id, dedupe_key ORDER BY detected_at, change_id) = 1"),
}

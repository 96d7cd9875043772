"""What readers and writers of the engine's relations see: rows as JSON, requests checked against their schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import outcomes, requests
from tidemark.functions.serialized import FIELDS, as_struct, serialized
from tidemark.plans import bindings as b


def changes_json(spark, sf_dir):
    """All changes; updated ones have a stored difference."""
    c = b.changes(spark, sf_dir).withColumn("diff_key", F.when(F.col("kind") == "updated", F.concat(F.lit("d/"), F.col("change_id").cast("string"))))
    return serialized(c.withColumnRenamed("change_id", "id"), "change")


def snapshots_json(spark, sf_dir):
    """Captures with their hashes; every third body is gone."""
    c = b.captures(spark, sf_dir).select(
        (F.col("monitor_id") * 2 + F.col("round")).alias("id"), "monitor_id", F.sha2("body", 256).alias("body_hash"), F.when(F.col("monitor_id") % 3 != 0, F.concat(F.lit("b/"), F.sha2("body", 256))).alias("body_key"),
        F.when(F.col("round") == 2, "n").alias("normalized_key"), F.lit(2).alias("normalization_version"),
    )
    return serialized(c, "snapshot")


def monitors_json(spark, sf_dir):
    """Monitors with the robots evaluation they name inside, null where it is gone."""
    m = b.monitors(spark, sf_dir).withColumnRenamed("monitor_id", "id").withColumn("robots_evaluation_id", F.when(F.col("id") % 3 != 0, F.col("id") * 7 % 400))
    a = b.attempts(spark, sf_dir).filter("attempt_id < 400").select(F.col("attempt_id").alias("id"), F.col("origin_id").alias("origin"), F.when(F.col("ok"), "allowed").otherwise("disallowed").alias("verdict"), F.col("seen_at").alias("checked_at"), (~F.col("ok")).alias("robots_would_block"))
    inside = a.select(F.col("id").alias("robots_evaluation_id"), as_struct(a, "robots_evaluation").alias("robots_evaluation"))
    return serialized(m.join(inside, "robots_evaluation_id", "left"), "monitor")


def destinations_json(spark, sf_dir):
    """Destinations whose secret is sealed, wiped or plain."""
    k, plain = F.col("destination_id"), F.concat(F.lit("https://Hooks.example.org/x/"), F.col("name"))
    envelope = outcomes.sealed(F.lower(plain), F.lit(b"0123456789abcdef0123456789abcdef"), F.substring(F.unhex(F.sha2(k.cast("string"), 256)), 1, 12))
    d = b.destinations(spark, sf_dir).withColumn("webhook_url", F.when(k % 3 == 0, envelope).when(k % 3 == 1, "").otherwise(plain)).withColumn("enabled", k % 2 == 0)
    return serialized(d.withColumnRenamed("destination_id", "id"), "destination")


def subscriptions_json(spark, sf_dir):
    return serialized(b.subscriptions(spark, sf_dir).withColumnRenamed("subscription_id", "id"), "subscription")


def requests_checked(spark, sf_dir):
    """Requests for monitors: right ones, values out of bounds or of another type, missing ones, broken JSON, another content type, blank bodies."""
    k, n = F.col("event_id") % 8, F.col("event_id").cast("string")
    write = lambda source, seconds, more="": F.concat(F.lit('{"source_id":'), source, F.lit(',"interval_seconds":'), seconds, F.lit(f"{more}}}"))
    name = F.concat(F.lit('"s'), n, F.lit('"'))
    body = (
        F.when(k == 0, write(name, F.concat(F.lit("1"), n), ',"tag":[1]')).when(k == 1, write(F.lit('""'), F.concat(F.lit("-1"), n))).when(k == 2, F.concat(F.lit('{"interval_seconds":"'), n, F.lit('"}')))
        .when(k == 3, F.concat(F.lit('{"source_id":'), n)).when(k == 4, write(name, F.lit("60"))).when(k == 5, F.col("props")).when(k == 6, " \n").otherwise(write(name, F.lit("60"), ',"next_run_at":5'))
    )
    got = requests.checked(body, F.when(k == 4, "text/plain").when(k != 6, "Application/JSON; charset=utf-8"), requests.SCHEMAS["monitor"])
    r = b.table(spark, sf_dir, "events").select("event_id", got.alias("r"))
    return r.select("event_id", "r.error", F.array_join("r.issues", "; ").alias("issues"), F.col("r.value.source_id").alias("source_id"), F.col("r.value.interval_seconds").alias("interval_seconds"))


def _json(relation: str, **fields: str) -> str:
    """json_object over all fields of a relation, null unless given."""
    return f"CAST(json_object({', '.join(f"'{f}', {fields.get(f, 'NULL')}" for f in FIELDS[relation].split())}) AS VARCHAR) AS json"


_AT = "strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"
QUERIES = {
    "changes_json": (
        changes_json,
        f"SELECT change_id AS id, {_json('change', id='change_id', monitor_id='monitor_id', kind='kind', dedupe_key='dedupe_key', has_diff="kind = 'updated'", detected_at=_AT.format('detected_at'))} FROM {b.CHANGES}",
    ),
    "snapshots_json": (
        snapshots_json,
        f"""SELECT monitor_id * 2 + round AS id, {_json('snapshot', id='monitor_id * 2 + round', monitor_id='monitor_id', body_hash='sha256(body)', normalization_version='2', has_body='monitor_id % 3 <> 0', has_normalized_body='round = 2')} FROM {b.CAPTURES}""",
    ),
    "monitors_json": (
        monitors_json,
        f"""WITH m AS (SELECT *, CASE WHEN monitor_id % 3 <> 0 THEN monitor_id * 7 % 400 END AS e FROM {b.MONITORS}),
a AS (SELECT attempt_id, {_json('robots_evaluation', id='attempt_id', origin='origin_id', verdict="CASE WHEN ok THEN 'allowed' ELSE 'disallowed' END", checked_at="strftime(seen_at, '%Y-%m-%dT%H:%M:%S.%gZ')", robots_would_block='NOT ok')} FROM {b.ATTEMPTS} WHERE attempt_id < 400)
SELECT monitor_id AS id, {_json('monitor', id='monitor_id', site_id='site_id', status='status', robots_evaluation_id='e', robots_evaluation='a.json::JSON', interval_seconds='interval_seconds', next_run_at=_AT.format('next_run_at'))}
FROM m LEFT JOIN a ON e = attempt_id""",
    ),
    "destinations_json": (
        destinations_json,
        f"""SELECT destination_id AS id, {_json('destination', id='destination_id', name='name', webhook_url_masked="CASE destination_id % 3 WHEN 0 THEN 'hooks.example.org/***' || lower(right(name, 4)) WHEN 2 THEN 'hooks.example.org/***' || right(name, 4) END", enabled='destination_id % 2 = 0', archived_at=_AT.format('archived_at'))} FROM {b.DESTINATIONS}""",
    ),
    "subscriptions_json": (
        subscriptions_json,
        f"SELECT subscription_id AS id, {_json('subscription', id='subscription_id', destination_id='destination_id', site_id='site_id', monitor_id='monitor_id', kind='kind')} FROM {b.SUBSCRIPTIONS}",
    ),
    "requests_checked": (
        requests_checked,
        """SELECT event_id, ['validation_error', 'validation_error', 'invalid_json', 'invalid_content_type', 'validation_error', 'validation_error', 'validation_error'][k] AS error,
coalesce(['source_id: too small; interval_seconds: too small', 'source_id: missing; interval_seconds: type', '', '', 'source_id: missing; interval_seconds: missing', 'source_id: missing; interval_seconds: missing', 'next_run_at: type'][k], '') AS issues,
CASE WHEN k = 0 THEN 's' || event_id END AS source_id, CASE WHEN k = 0 THEN CAST('1' || event_id AS BIGINT) END AS interval_seconds FROM (SELECT event_id, event_id % 8 AS k FROM events)""",
    ),
}

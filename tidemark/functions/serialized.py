"""Rows as the JSON that readers get: fixed fields in a fixed order, nulls kept, flags in place of what stays inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of each relation, in the order in which they are written.
FIELDS = {
    "site": "id name primary_origin created_at updated_at",
    "source": "id site_id type url config pipeline created_at updated_at",
    "monitor": "id site_id source_id status stop_reason robots_evaluation_id robots_evaluation interval_seconds next_run_at last_checked_at created_at updated_at",
    "check_job": "id monitor_id scheduled_for status trigger started_at finished_at created_at",
    "check_attempt": "id check_job_id target_id fetcher_id attempt_index outcome failure_class status_code duration_ms snapshot_id error_message started_at finished_at created_at",
    "snapshot": "id monitor_id target_id check_attempt_id fetched_at http_status content_type etag last_modified body_hash normalized_hash text_hash normalization_version has_body has_normalized_body created_at",
    "change": "id monitor_id target_id target_url kind diff_level dedupe_key previous_snapshot_id snapshot_id has_diff diff_preview title detected_at created_at",
    "destination": "id name webhook_url_masked enabled archived_at created_at updated_at",
    "subscription": "id destination_id site_id monitor_id tag kind created_at updated_at",
    "robots_policy": "id site_id canonical_origin mode reason updated_by warning created_at updated_at",
    "robots_evaluation": "id origin verdict robots_url checked_at user_agent_group matched_rule unavailable robots_would_block robots_hash created_at",
    "audit_event": "id actor action subject reason payload created_at",
    "fetcher_policy": "allow_list order_list",
}


def masked(url: Column) -> Column:
    """A webhook's host and last four characters, null for one that was wiped; sealed ones carry their mask behind ``enc:v1:``, no key is needed."""
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)), F.lit("")), F.lit("invalid-url"))
    sealed = F.try_to_binary(F.try_element_at(F.split(url, ":"), F.lit(3)), F.lit("base64")).cast("string")
    return F.when(url.startswith("enc:v1:"), sealed).when(url != "", F.concat(host, F.lit("/***"), F.substring(url, -4, 4)))


def instant(c: Column) -> Column:
    """Times as ISO 8601 with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Fields that are told from others: (relation, field) -> (column that it is told from, how).
DERIVED: dict[tuple[str, str], tuple[str, Callable[[Column], Column]]] = {
    ("snapshot", "has_body"): ("body_key", Column.isNotNull),
    ("snapshot", "has_normalized_body"): ("normalized_key", Column.isNotNull),
    ("change", "has_diff"): ("diff_key", Column.isNotNull),
    ("destination", "webhook_url_masked"): ("webhook_url", masked),
    ("robots_policy", "warning"): ("mode", lambda c: c == "ignore"),
}


def as_struct(df: DataFrame, relation: str) -> Column:
    """The fields of a row of ``df`` as they are written, to stand inside another row."""

    def field(f: str) -> Column:
        source, how = DERIVED.get((relation, f), (f, None))
        if source not in df.columns:
            return F.lit(False).alias(f) if how is Column.isNotNull else F.lit(None).cast("string").alias(f)
        c = F.col(f"`{source}`")
        if how:
            return how(c).alias(f)
        return (instant(c) if df.schema[source].dataType.typeName().startswith("timestamp") else c).alias(f)

    return F.struct(*[field(f) for f in FIELDS[relation].split()])


def serialized(df: DataFrame, relation: str, name: str = "json") -> DataFrame:
    """id (where the relation has one) and ``name``: a JSON object per row of ``df``.

    Columns that ``df`` lacks are written as null, or as false where they tell whether something is there; further ones are left out. Timestamps
    become ISO 8601 with milliseconds, structs and arrays stay what they are.
    """
    return df.select(*(["id"] if "id" in df.columns else []), F.to_json(as_struct(df, relation), {"ignoreNullFields": "false"}).alias(name))

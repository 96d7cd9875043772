"""Fetch and delivery outcomes: classes of failures, retry times, backoff, message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.dates import rfc822

# Failure classes by what may follow them.
PROCEED_BY_DEFAULT = ("network_error", "timeout", "http_5xx")
NEVER_PROCEED = ("blocked_by_robots", "ssrf_blocked", "not_found", "auth_required", "too_large", "captcha_challenge")
TRANSIENT = ("http_5xx", "network_error")
# How a notification names and colours a kind of change, and how long its parts may be.
LABELS = {"new": "新規検出", "updated": "更新検出", "removed": "削除検出"}
COLOURS = {"new": 0x57F287, "updated": 0xFEE75C, "removed": 0xED4245}
MOST_PREVIEW, MOST_DESCRIPTION, MOST_TITLE = 900, 4096, 256


def captcha(header_names: Column, body: Column) -> Column:
    named = F.exists(header_names, lambda h: F.lower(h).startswith("cf-chl-") | (F.lower(h) == "cf-mitigated"))
    text = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(named, F.lit(False)) | text.contains("captcha") | text.contains("challenge")


def allowed_type(content_type: Column, allowed: Column) -> Column:
    """Whether a content type starts with one of ``allowed``; an empty list allows all."""
    starts = F.exists(allowed, lambda p: F.lower(content_type).startswith(F.lower(p)))
    return F.coalesce(F.size(allowed) <= 0, F.lit(True)) | F.coalesce(starts, F.lit(False))


def failure_class(status: Column, error: Column, is_captcha: Column, n_bytes: Column, type_ok: Column, most_bytes: int = 5 << 20) -> Column:
    """The failure of a final response; null for success and for 304. ``error`` names what ended a request without a response."""
    too_large = n_bytes > most_bytes
    return (
        F.when(error == "timeout", "timeout")
        .when(error.isNotNull() | status.isNull(), "network_error")
        .when(status == 304, None)
        .when(status.isin(401, 407), "auth_required")
        .when((status == 403) & too_large, "too_large")
        .when((status == 403) & is_captcha, "captcha_challenge")
        .when(status == 403, "http_403")
        .when(status.isin(404, 410), "not_found")
        .when(status == 429, "http_429")
        .when(status.between(500, 599), "http_5xx")
        .when(status.between(200, 299) & ~type_ok, "invalid_content_type")
        .when(status.between(200, 299) & too_large, "too_large")
        .when(status.between(200, 299), None)
        .otherwise("network_error")
    )


def may_proceed(failure: Column, proceed_on: Column) -> Column:
    """Whether the next fetcher may try after ``failure``; a null list means the default."""
    listed = F.coalesce(proceed_on, F.array(*[F.lit(x) for x in PROCEED_BY_DEFAULT]))
    return ~failure.isin(*NEVER_PROCEED) & F.array_contains(listed, failure)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait from a header: a number, or the distance to a date, 0 at least."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    at = F.try_to_timestamp(F.coalesce(rfc822(v), F.when(v.rlike("^[0-9]{4}-"), v)))
    return F.when(v.rlike(r"^\d+$"), v.try_cast("long")).otherwise(F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_timestamp(at) - F.unix_timestamp(now))))


def backoff_ms(streak: Column, base: int = 10_000, most: int = 300_000) -> Column:
    """Doubling per failure in a row, capped; 0 without one."""
    return F.when(streak <= 0, 0).otherwise(F.least(F.lit(most), base * F.pow(F.lit(2), F.least(streak, F.lit(30)) - 1))).cast("long")


def permanent(status: Column) -> Column:
    return status.between(400, 499) & (status != 429)


def jitter_s(key: Column, interval: Column) -> Column:
    """Up to a tenth of the interval, 60 s at most; by hash, so that reruns agree."""
    most = F.least(F.floor(interval / 10), F.lit(60)).cast("long")
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), most + 1)


def masked_url(url: Column) -> Column:
    """Host and last four characters of a secret URL; of text that is none the last four characters alone."""
    host = F.regexp_extract(url, r"^https?://([^/?#]+)", 1)
    return F.concat(F.when(host == "", "").otherwise(F.concat(host, F.lit("/"))), F.lit("***"), F.right(url, F.lit(4)))


def webhook_host_ok(host: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a host is one of ``allowed`` or below one."""
    found = F.lit(False)
    for h in allowed:
        found = found | (host == h) | host.endswith(f".{h}")
    return found


def payload(title: Column, kind: Column, url: Column, site: Column, preview: Column, detected: Column) -> Column:
    """A notification as JSON text: one embed with colour, a description of kind, URL, time and difference, and the time if it is one.

    ``detected`` is text; the title falls back to the name of the site, an empty preview is left out.
    """
    of_kind = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[kind]
    shown = F.when(preview != "", F.concat(F.lit("\n```diff\n"), text.preview(preview, MOST_PREVIEW, "\n…(truncated)"), F.lit("\n```")))
    lines = F.concat(F.lit("**種別**: "), of_kind(LABELS), F.lit("\n**URL**: "), url, F.lit("\n**検出日時**: "), dates.shifted(detected), F.coalesce(shown, F.lit("")))
    embed = F.struct(
        text.shortened(F.coalesce(title, site), MOST_TITLE).alias("title"), of_kind(COLOURS).alias("color"), text.shortened(lines, MOST_DESCRIPTION).alias("description"),
        dates.canonical(F.try_to_timestamp(detected)).alias("timestamp"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def sealed(secret: Column, key: Column, iv: Column) -> Column:
    """AES-GCM envelope enc:v1:<mask>:<iv>:<ciphertext>, parts in base64; ``iv`` has 12 bytes."""
    whole = F.aes_encrypt(secret, key, F.lit("GCM"), F.lit("DEFAULT"), iv)
    return F.concat_ws(":", F.lit("enc:v1"), F.base64(masked_url(secret).cast("binary")), F.base64(iv), F.base64(F.substring(whole, 13, 1 << 20)))


def opened(envelope: Column, key: Column) -> Column:
    """The secret of an envelope; text that is none stays as it is, a wrong key gives null."""
    p = F.split(envelope, ":")
    whole = F.concat(F.unbase64(F.try_element_at(p, F.lit(4))), F.unbase64(F.try_element_at(p, F.lit(5))))
    return F.when(envelope.startswith("enc:v1:"), F.try_aes_decrypt(whole, key, F.lit("GCM")).cast("string")).otherwise(envelope)

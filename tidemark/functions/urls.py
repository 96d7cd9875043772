"""URLs: parts, resolution against a base, tracking parameters, percent-encoding, globs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

# Query parameters that only track.
TRACKING = ("utm_*", "gclid", "fbclid", "yclid", "mc_cid", "mc_eid")


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host without user, port; brackets of an IPv6 address stay."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?+(\[[^\]]*\]|[^/?#:]*)", 1))


def port(url: Column) -> Column:
    """The port as written, else that of the scheme; null where it is no number."""
    written = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?+(?:\[[^\]]*\]|[^/?#:]*):([^/?#]*)", 1)
    return F.when(written == "", F.when(F.lower(url).startswith("https:"), 443).otherwise(80)).otherwise(written.try_cast("int"))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def decode_entities(c: Column) -> Column:
    """The five named references and numeric ones below U+FFFF."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&#[xX]?[0-9a-fA-F]+;|&[a-zA-Z]+;|[^&]+|&"), F.lit(0))
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(x: Column) -> Column:
        hexed, dec = F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]+);$", 1), F.regexp_extract(x, r"^&#([0-9]+);$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(dec != "", dec).try_cast("int")
        out = F.when(code.between(1, 65535), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE"))
        for k, v in named.items():
            out = out.when(F.lower(x) == k, v)
        return out.otherwise(x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def encode_other(c: Column) -> Column:
    """Percent-encodes spaces, controls and everything past ASCII."""
    each = lambda v: F.transform(F.split(v, ""), lambda x: F.when(x == " ", "%20").when((F.ascii(x) > 126) | (F.ascii(x) < 32), F.url_encode(x)).otherwise(x))
    return let(c, lambda v: F.when(v.rlike(r"[^\x21-\x7E]"), F.array_join(each(v), "")).otherwise(v))


def without_dots(p: Column) -> Column:
    """Removes . and .. segments of an absolute path."""

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))

    def walked(v: Column) -> Column:
        kept = F.array_join(F.aggregate(F.split(v, "/"), F.array().cast("array<string>"), step), "/")
        return F.concat(kept, F.when(v.rlike(r"/\.\.?$"), "/").otherwise(""))

    return let(p, lambda v: F.when(v.rlike(r"(?:^|/)\.\.?(?:/|$)"), walked(v)).otherwise(v))


def without_tracking(url: Column, names: Sequence[str] = TRACKING) -> Column:
    """Drops the query parameters ``names`` (a trailing * is a prefix), ignoring case."""
    pattern = "(?i)^(?:" + "|".join(n.replace("*", "[^=]*") for n in names) + ")(?:=|$)"

    def stripped(u: Column) -> Column:
        kept = F.array_join(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: ~x.rlike(pattern)), "&")
        return F.concat(F.regexp_extract(u, r"^([^?#]*)", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), F.regexp_extract(u, r"(#.*)$", 1))

    tracked = pattern.replace("^", "[?&]", 1).replace("|$)", "|&|#|$)").replace("[^=]*", "[^=&#]*")
    return let(url, lambda u: F.when(F.regexp_extract(u, r"^([^#]*)", 1).rlike(tracked), stripped(u)).otherwise(u))


def resolve(value: Column, base: Column) -> Column:
    """An absolute http(s) URL of a reference; null where it has another scheme or is empty."""


    def joined(v: Column) -> Column:
        return (
            F.when(v.rlike(r"^(?i)https?://"), v)
            .when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(v.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), v))
            .when(v.startswith("/"), F.concat(origin(base), v))
            .when(v.startswith("?"), F.concat(origin(base), path(base), v))
            .when(v.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), v))
            .when(v != "", F.concat(origin(base), F.regexp_extract(path(base), r"^(.*/)", 1), v))
        )

    def finished(u: Column) -> Column:
        return F.when(u.isNotNull(), F.concat(origin(u), without_dots(encode_other(path(u))), encode_other(F.regexp_extract(u, r"([?#].*)$", 1))))

    trimmed = F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return let(let(trimmed, joined), finished)


def normalized_attribute(value: Column, base: Column, names: Sequence[str] = TRACKING) -> Column:
    """href or src made absolute without tracking parameters; anything but http(s) stays as it was."""
    return let(value, lambda v: F.coalesce(without_tracking(resolve(decode_entities(v), base), names), v))


def percent_normalized(c: Column) -> Column:
    """Unreserved characters decoded, other escapes in upper case, the rest past printable ASCII encoded."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 2, 2), 16, 10).cast("int")
        plain = F.when(code < 128, F.chr(code)).otherwise("")
        escaped = F.when(plain.rlike(r"^[A-Za-z0-9._~-]$"), plain).otherwise(F.upper(x))
        return (
            F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), escaped)
            .when(F.ascii(x) > 126, F.url_encode(x))
            .when(F.ascii(x) <= 32, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0")))
            .otherwise(x)
        )

    return F.array_join(F.transform(parts, one), "")


def glob_match(pattern: Column, text: Column, prefix: bool = True) -> Column:
    """``*`` stands for anything, a final ``$`` anchors; otherwise a match may end early if ``prefix``.

    Literal pieces are located from left to right, so cost is linear in the text for any pattern.
    """
    anchored = pattern.endswith("$") if prefix else F.lit(True)
    body = F.when(pattern.endswith("$"), F.left(pattern, F.length(pattern) - 1)).otherwise(F.concat(pattern, F.lit("*"))) if prefix else pattern
    p = F.split(body, r"\*", -1)
    n, first, last = F.size(p), F.element_at(p, 1), F.element_at(p, -1)
    middle = F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0)))

    def walk(at: Column, piece: Column) -> Column:
        found = F.when(piece == "", at + 1).otherwise(F.call_function("locate", piece, text, at + 1))
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(found - 1 + F.length(piece))

    at = F.aggregate(middle, F.length(first), walk)
    many = text.startswith(first) & (at >= 0) & text.endswith(last) & (F.length(text) - F.length(last) >= at)
    return F.when(n == 1, (text == first) & anchored).otherwise(many)

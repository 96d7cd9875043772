"""Dates of feeds: RFC 822 and ISO 8601 to canonical UTC text; fixed-offset display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

CANONICAL = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# Minutes east of UTC of the named zones.
ZONES = {"ut": 0, "gmt": 0, "utc": 0, "z": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def canonical(ts: Column) -> Column:
    return F.date_format(ts, CANONICAL)


def rfc822(c: Column) -> Column:
    """Canonical UTC text of an RFC 822 date; null where it is none or out of range.

    Read by parts: comments and the day of the week go, then day, month, year, time and zone stand between spaces. The
    zone may follow the time at once or be missing (UTC); two-digit years below 70 are of this century.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"^\s*[A-Za-z]{3},", " "), r"\s+", " ")
    apart = F.regexp_replace(F.trim(plain), r":(\d\d)(?=[A-Za-z+-])", ":$1 ")
    return let(F.split(apart, " "), lambda parts: let(_fields(parts), _at))


def _fields(parts: Column) -> Column:
    part = lambda k: F.try_element_at(parts, F.lit(k))
    number = lambda x, shape: F.when(x.rlike(shape), x.try_cast("int"))
    clock = F.split(part(4), ":")
    unit = lambda k, shape: number(F.try_element_at(clock, F.lit(k)), shape)
    year, zone = number(part(3), r"^\d{2,4}$"), part(5)
    century = F.when(F.length(part(3)) == 2, F.when(year < 70, 2000).otherwise(1900)).otherwise(0)
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.lower(zone))
    shift = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    offset = F.when(zone.isNull(), 0).when(zone.rlike(r"^\+\d{4}$"), shift).when(zone.rlike(r"^-\d{4}$"), -shift).otherwise(named)
    whole = F.size(parts).between(4, 5) & F.size(clock).between(2, 3)
    second = F.when(F.size(clock) == 3, unit(3, r"^\d{2}$")).otherwise(0)
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2))).cast("int"), F.lit(0))
    return F.struct(
        whole.alias("whole"), number(part(1), r"^\d{1,2}$").alias("day"), month.alias("month"), (year + century).alias("year"),
        unit(1, r"^\d{1,2}$").alias("hour"), unit(2, r"^\d{2}$").alias("minute"), second.alias("second"), offset.alias("offset"),
    )


def _at(x: Column) -> Column:
    """Days beyond a month's end run into the next one."""
    inside = x["whole"] & x["day"].between(1, 31) & (x["hour"] < 24) & (x["minute"] < 60) & (x["second"] < 60)
    start = F.try_make_timestamp(x["year"], x["month"], F.lit(1), x["hour"], x["minute"], x["second"])
    return F.when(inside, canonical(F.timestamp_seconds(F.unix_timestamp(start) + (x["day"] - 1) * 86400 - x["offset"] * 60)))


def written_out(c: Column) -> Column:
    """Canonical UTC text of a date in other words: a month's name or its first letters, day and year in any order, or y/m/d or m/d/y, with or without a time.

    Commas, comments and the name of a day count for nothing. Days need one or two digits, years four, times a colon, perhaps am or pm; a zone is a named one,
    or an offset, and UTC if missing. Anything else, and what is out of range, is null.
    """
    slashed = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\b(\d{4})/(\d{1,2})/(\d{1,2})\b", "$2/$3/$1")
    apart = F.regexp_replace(F.regexp_replace(slashed, r"(?i)(\d)(am|pm|gmt|utc|z)\b", "$1 $2"), r"(?i)\b(gmt|utc)(?=[+-]\d)|(?<=\d)(?=[+-]\d{4}\b)", " ")
    words = F.filter(F.split(F.lower(F.regexp_replace(apart, ",", " ")), r"\s+"), lambda w: (w != "") & ~w.rlike(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?$"))
    return let(words, lambda w: let(_words(w), _at))


def _words(words: Column) -> Column:
    """day, month, year, hour, minute, second, offset of words, each of which must be one of these."""
    kinds = {
        "slashed": r"^\d{1,2}/\d{1,2}/\d{4}$", "month": rf"^(?:{'|'.join(MONTHS)})[a-z]*\.?$", "year": r"^\d{4}$", "day": r"^\d{1,2}$", "clock": r"^\d{1,2}:\d{2}(?::\d{2})?$",
        "half": "^[ap]m$", "offset": r"^[+-]\d{2}:?\d{2}$", "zone": rf"^(?:{'|'.join(ZONES)})$",
    }
    fitting = lambda shape: F.filter(words, lambda w: w.rlike(shape))
    of = {k: fitting(shape) for k, shape in kinds.items()}
    one = {k: F.try_element_at(v, F.lit(1)) for k, v in of.items()}
    n = {k: F.size(v) for k, v in of.items()}
    known = fitting("|".join(kinds.values()))
    named = (n["slashed"] == 0) & (n["month"] == 1) & (n["year"] == 1) & (n["day"] == 1)
    numeric = (n["slashed"] == 1) & (n["month"] == 0) & (n["year"] == 0) & (n["day"] == 0)
    whole = (F.size(known) == F.size(words)) & (named | numeric) & (n["clock"] <= 1) & (n["half"] <= n["clock"]) & (n["zone"] <= 1) & (n["offset"] <= 1)
    day_of, clock = F.split(one["slashed"], "/"), F.split(one["clock"], ":")
    at = lambda parts, k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(one["month"], 1, 3)).cast("int"), F.lit(0))
    hour = F.coalesce(at(clock, 1), F.lit(0))
    half = F.when(n["half"] == 0, hour).when(hour.between(1, 12), hour % 12 + F.when(one["half"] == "pm", 12).otherwise(0))
    digits = F.regexp_replace(one["offset"], ":", "")
    east = (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(digits.startswith("-"), -1).otherwise(1)
    offset = F.coalesce(east, F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), one["zone"]), F.lit(0))
    return F.struct(
        whole.alias("whole"), F.coalesce(at(day_of, 2), one["day"].try_cast("int")).alias("day"), F.coalesce(at(day_of, 1), month).alias("month"), F.coalesce(at(day_of, 3), one["year"].try_cast("int")).alias("year"),
        half.alias("hour"), F.coalesce(at(clock, 2), F.lit(0)).alias("minute"), F.coalesce(at(clock, 3), F.lit(0)).alias("second"), offset.alias("offset"),
    )


def feed_date(c: Column) -> Column:
    """Canonical UTC text of an RFC 822, ISO 8601 or written-out date, null if it is none of these."""
    s = F.trim(c)
    return F.coalesce(rfc822(c), F.when(s.rlike(r"^\d{4}-\d{2}"), canonical(F.try_to_timestamp(s))), written_out(s))


def iso(c: Column) -> Column:
    """Canonical UTC text; text that is no date stays, blank text is null."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    at = F.when(s.rlike(r"^\d{4}-\d{2}(?:-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?$"), F.try_to_timestamp(s))
    return F.when(s == "", None).otherwise(F.coalesce(canonical(at), s))


def shifted(c: Column, hours: int = 9, label: str = "JST") -> Column:
    """Display at a fixed offset; text that is no date stays."""
    return F.coalesce(F.concat(F.date_format(F.try_to_timestamp(c) + F.expr(f"INTERVAL {hours} HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit(f" {label}")), c)

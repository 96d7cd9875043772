"""Text of pages: cleaning, white space, block text, titles, hashes and previews; all JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that break lines in extracted text.
BLOCK_TAGS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul"
).split()
NORMALIZATION_VERSION = 2
BREAK = "\ue000"
BLANKS = r"[ \t\r\n\f]"
REMOVED = r"(?is)<script\b[^>]*>.*?</script\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
# One tag, quoted values may hold >.
ANY_TAG = r"""</?[A-Za-z!][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
BLOCK_TAG = rf"""(?i)</?(?:{"|".join(sorted(BLOCK_TAGS, key=lambda t: (-len(t), t)))})(?:[\s/][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)?>"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_white(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def removed(html: Column) -> Column:
    """Without scripts, styles and comments, in document order."""
    return F.regexp_replace(html, REMOVED, "")


def collapse_html(html: Column) -> Column:
    """Gaps between tags go where they hold a line break; other white space becomes one space."""
    gaps = F.regexp_replace(html, rf">{BLANKS}*[\r\n]{BLANKS}*<", "><")
    return strip_white(F.regexp_replace(gaps, rf"{BLANKS}+", " "))


def block_text(html: Column) -> Column:
    """Text by blocks, one line each; entities stay as written."""
    marked = F.regexp_replace(F.regexp_replace(html, BLOCK_TAG, BREAK), ANY_TAG, "")
    lines = F.transform(F.split(F.regexp_replace(marked, rf"{BLANKS}+", " "), BREAK), strip_white)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def title_of(html: Column, longest: int = 512) -> Column:
    """The first title, white space collapsed, at most ``longest`` code points; null if missing or blank."""
    inner = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    return F.nullif(F.substring(strip_white(F.regexp_replace(inner, r"\s+", " ")), 1, longest), F.lit(""))


def preview(c: Column, longest: int = 2000, mark: str = "\n… (truncated)") -> Column:
    """Cut to ``longest`` code points with a mark behind."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(mark))).otherwise(c)


def shortened(c: Column, longest: int = 256) -> Column:
    """Cut so that an ellipsis still fits."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 1), F.lit("…"))).otherwise(c)


def field_text(c: Column) -> Column:
    """Non-breaking space entities count as white space; then collapsed."""
    return strip_white(F.regexp_replace(F.regexp_replace(c, "(?i)&nbsp;|&#160;|&#xa0;|\u00a0", " "), r"\s+", " "))


def fields_summary(fields: Column) -> Column:
    """``name: value`` lines of array<struct<name, value>>; null if there is none. A null value is written as empty."""
    lines = F.transform(fields, lambda x: F.concat(x["name"], F.lit(": "), F.coalesce(x["value"], F.lit(""))))
    return F.when(F.size(fields) > 0, F.array_join(lines, "\n"))


def compared(old: Column, new: Column) -> tuple[Column, Column]:
    """(changed, level) of two structs with raw_hash, normalized_hash, text_hash: the cheapest equal hash decides."""
    same = (old["raw_hash"] == new["raw_hash"]) | (old["normalized_hash"] == new["normalized_hash"])
    level = F.when(same, None).when(old["text_hash"] == new["text_hash"], "normalized_hash").otherwise("text_hash")
    return ~same, level

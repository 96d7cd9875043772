"""The clean pass over HTML: scripts, styles, comments and dynamic attributes go, URLs become absolute, attributes are sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.functions.regions import regions

# Attributes that change with every response.
DYNAMIC = r"(?i)^(?:nonce|data-nonce)$|csrf|timestamp"
START_TAG = r"""<[A-Za-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def rewritten_tag(tag: Column, base: Column, dynamic: str = DYNAMIC, tracking: Sequence[str] = urls.TRACKING) -> Column:
    """A start tag with its lasting attributes in code point order; of repeated names the first counts."""

    def attribute(a: Column) -> Column:
        key = F.lower(F.regexp_extract(a, ATTRIBUTE, 1))
        value = F.regexp_replace(F.regexp_extract(a, ATTRIBUTE, 2), r"""^["']|["']$""", "")
        return text.let(F.struct(key.alias("k"), value.alias("v")), lambda x: F.struct(x["k"].alias("k"), F.when(x["k"].isin("href", "src"), urls.normalized_attribute(x["v"], base, tracking)).otherwise(x["v"]).alias("v")))

    def written(lasting: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(lasting, lambda x: x["k"])))
        return F.array_join(F.transform(keys, lambda k: F.concat(F.lit(" "), k, F.lit('="'), F.element_at(F.filter(lasting, lambda x: x["k"] == k), 1)["v"], F.lit('"'))), "")

    inside = F.regexp_replace(F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*", ""), r">$", "")
    found = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0)), attribute)
    attributes = text.let(F.filter(found, lambda x: ~x["k"].rlike(dynamic)), written)
    name = F.lower(F.regexp_extract(tag, r"^<([A-Za-z][^\s/>]*)", 1))
    return F.concat(F.lit("<"), name, attributes, F.when(tag.rlike(r"/\s*>$"), " />").otherwise(">"))


def cleaned(html: Column, base: Column) -> Column:
    """The clean pass; only start tags that carry something besides their name are rewritten."""

    def rebuilt(kept: Column) -> Column:
        tags = F.regexp_extract_all(kept, F.lit(START_TAG), F.lit(0))
        new = F.transform(tags, lambda t: F.when(t.rlike(r"^<[a-z][a-z0-9]*>$"), t).otherwise(rewritten_tag(t, base)))
        return F.array_join(F.zip_with(F.split(kept, START_TAG, -1), F.concat(new, F.array(F.lit(""))), lambda g, t: F.concat(g, t)), "")

    return text.let(text.removed(html), rebuilt)


def normalized(html: Column, base: Column) -> Column:
    """struct<normalized_html, extracted_text>."""
    return text.let(cleaned(html, base), lambda c: F.struct(text.collapse_html(c).alias("normalized_html"), text.block_text(c).alias("extracted_text")))


def hashed(html: Column, base: Column, ignore: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """struct<normalized_html, extracted_text, raw_hash, normalized_hash, text_hash>; regions count for all but the raw hash."""
    with_hashes = lambda n: F.struct(
        n["normalized_html"].alias("normalized_html"), n["extracted_text"].alias("extracted_text"), text.sha256(html).alias("raw_hash"),
        text.sha256(n["normalized_html"]).alias("normalized_hash"), text.sha256(n["extracted_text"]).alias("text_hash"),
    )
    return text.let(normalized(regions(html, ignore, include), base), with_hashes)

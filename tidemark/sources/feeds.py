"""RSS, Atom and sitemaps from XML text with ``from_xml``: one row per item in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, urls
from tidemark.functions.text import strip_white
from tidemark.operators.keyed import first_wins

RSS = "channel struct<title:string, item:array<struct<title:string, link:string, guid:string, pubDate:string, description:string>>>, _bad string"
LINK = "array<struct<_href:string, _rel:string>>"
ATOM = f"title string, entry array<struct<title:string, id:string, link:{LINK}, published:string, updated:string, summary:string, content:string>>, _bad string"
SITEMAP = "url array<struct<loc:string, lastmod:string>>, _bad string"
SITEMAP_INDEX = "sitemap array<struct<loc:string, lastmod:string>>, _bad string"
OPTIONS = {"columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}


def root_of(xml: Column) -> Column:
    """The root element's local name, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(xml, r"(?s)^(?:﻿)?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<![^>]*>\s*)*<(?:[A-Za-z0-9_.-]+:)?([A-Za-z0-9_.-]+)", 1))


def feed_kind(xml: Column) -> Column:
    """rss, atom, sitemap, sitemap-index, or null."""
    root = root_of(xml)
    return F.when(root == "rss", "rss").when(root == "feed", "atom").when(root == "urlset", "sitemap").when(root == "sitemapindex", "sitemap-index")


def blank_null(c: Column) -> Column:
    return F.nullif(strip_white(c), F.lit(""))


def fallback_key(title: Column, date: Column) -> Column:
    """Eight hexadecimal digits for items without any other identity."""
    return F.substring(F.sha2(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(date, F.lit(""))), 256), 1, 8)


def _items(df: DataFrame, key: str, xml: str, schema: str, root: str, items: str) -> DataFrame:
    """key, pos, x: the exploded elements of the documents whose root is ``root``."""
    parsed = df.filter(root_of(F.col(xml)) == root).select(key, *[c for c in ("base_url",) if c in df.columns], F.from_xml(F.col(xml), F.lit(schema), OPTIONS).alias("d"))
    return parsed.filter(F.col("d._bad").isNull()).select(key, *[c for c in ("base_url",) if c in df.columns], F.posexplode(f"d.{items}").alias("pos", "x"))


def rss_items(df: DataFrame, key: str = "doc", xml: str = "xml") -> DataFrame:
    """key, pos, stable_key, url, title, published_at, updated_at, summary; of equal keys the first stays."""
    x = _items(df, key, xml, RSS, "rss", "channel.item")
    field = lambda c: blank_null(F.col(f"x.{c}"))
    rows = x.select(
        key, F.col("pos").cast("long").alias("pos"), F.coalesce(field("guid"), field("link"), fallback_key(field("title"), field("pubDate"))).alias("stable_key"), field("link").alias("url"),
        field("title").alias("title"), dates.feed_date(field("pubDate")).alias("published_at"), F.lit(None).cast("string").alias("updated_at"), field("description").alias("summary"),
    )
    return first_wins(rows, [key, "stable_key"], ["pos"])


def atom_items(df: DataFrame, key: str = "doc", xml: str = "xml") -> DataFrame:
    """The same columns; the link is the first alternate one, else the first; it is resolved against ``base_url``."""
    x = _items(df, key, xml, ATOM, "feed", "entry")
    field = lambda c: blank_null(F.col(f"x.{c}"))
    alternate = F.filter("x.link", lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate")
    href = F.coalesce(F.try_element_at(alternate, F.lit(1))["_href"], F.try_element_at(F.col("x.link"), F.lit(1))["_href"])
    link = F.coalesce(urls.resolve(href, F.col("base_url")), href) if "base_url" in df.columns else href
    rows = x.select(
        key, F.col("pos").cast("long").alias("pos"), F.coalesce(field("id"), link, fallback_key(field("title"), field("updated"))).alias("stable_key"), link.alias("url"),
        field("title").alias("title"), dates.iso(field("published")).alias("published_at"), dates.iso(field("updated")).alias("updated_at"), F.coalesce(field("summary"), field("content")).alias("summary"),
    )
    return first_wins(rows, [key, "stable_key"], ["pos"])


def sitemap_items(df: DataFrame, key: str = "doc", xml: str = "xml", index: bool = False) -> DataFrame:
    """key, pos, stable_key, url, updated_at of a urlset, or of the children of an index."""
    x = _items(df, key, xml, *((SITEMAP_INDEX, "sitemapindex", "sitemap") if index else (SITEMAP, "urlset", "url")))
    loc = blank_null(F.col("x.loc"))
    url = F.coalesce(urls.resolve(loc, F.col("base_url")), loc) if "base_url" in df.columns else loc
    rows = x.select(key, F.col("pos").cast("long").alias("pos"), url.alias("stable_key"), url.alias("url"), dates.iso(blank_null(F.col("x.lastmod"))).alias("updated_at"))
    return first_wins(rows.filter(F.col("url").isNotNull()), [key, "stable_key"], ["pos"])


def parse_errors(df: DataFrame, key: str = "doc", xml: str = "xml") -> DataFrame:
    """key, error: invalid_xml, unexpected_root, or null for documents that one of the readers takes."""
    kind = feed_kind(F.col(xml))
    bad = F.from_xml(F.col(xml), F.lit(SITEMAP), OPTIONS)["_bad"].isNotNull()
    return df.select(key, F.when(root_of(F.coalesce(xml, F.lit(""))) == "", "invalid_xml").when(kind.isNull(), "unexpected_root").when(bad, "invalid_xml").alias("error"))

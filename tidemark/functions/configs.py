"""Configurations of sources: which keys a type takes, and what is wrong with an extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys that a configuration of each type of source may have; feeds take none.
SITEMAP_KEYS = ("sitemap_mode", "lastmod_max_age_days", "max_depth", "child_include_patterns")
PAGE_KEYS = ("page_mode", "extract", "ignore_selectors", "include_selectors", "strip_query_params")
EXTRACT = "page_mode string, extract struct<item_selector:string, link_selector:string, title_selector:string, fields:array<struct<name:string, selector:string, label:string>>>"
SELECTOR = r"^(?:[A-Za-z*][A-Za-z0-9-]*|[.#][A-Za-z_][\w-]*|\[[\w-]+(?:=[^\]]*)?\])+(?:\s+(?:[A-Za-z*][A-Za-z0-9-]*|[.#][A-Za-z_][\w-]*|\[[\w-]+(?:=[^\]]*)?\])+)*$"


def not_applicable(kind: Column, config: Column) -> Column:
    """The keys of a JSON configuration that its type does not take, in order; null without a configuration."""
    keys = lambda names: F.array(*[F.lit(k) for k in names]).cast("array<string>")
    taken = F.when(kind == "page", keys(PAGE_KEYS)).when(kind.isin("sitemap", "sitemap-index"), keys(SITEMAP_KEYS)).otherwise(keys(()))
    return F.filter(F.json_object_keys(config), lambda k: ~F.array_contains(taken, k))


def config_error(kind: Column, config: Column) -> Column:
    """config_not_applicable, invalid_selector, invalid_field, or null: the first thing that is wrong with a configuration.

    Feeds take no configuration at all. Extraction needs an item selector; every selector must be one; a field has either a
    selector or a label, never both and never neither.
    """
    c = F.from_json(config, EXTRACT)
    e = c["extract"]
    wrong = lambda s: s.isNotNull() & ~s.rlike(SELECTOR)
    feed = kind.isin("rss", "atom") & config.isNotNull()
    odd_field = F.exists(e["fields"], lambda f: f["selector"].isNull() == f["label"].isNull())
    odd_selector = wrong(e["item_selector"]) | wrong(e["link_selector"]) | wrong(e["title_selector"])
    missing = (kind == "page") & (c["page_mode"] == "extract") & (F.coalesce(e["item_selector"], F.lit("")) == "")
    return (
        F.when(feed | (F.size(not_applicable(kind, config)) > 0), "config_not_applicable")
        .when(F.coalesce(missing, F.lit(False)) | F.coalesce(odd_selector, F.lit(False)), "invalid_selector")
        .when(F.coalesce(odd_field, F.lit(False)), "invalid_field")
        .when(F.coalesce(F.exists(e["fields"], lambda f: wrong(f["selector"])), F.lit(False)), "invalid_selector")
    )

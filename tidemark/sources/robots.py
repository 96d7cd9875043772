"""robots.txt into groups and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.text import strip_white

FIELDS = ("user-agent", "allow", "disallow", "sitemap")


def directives(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, field, value of the known directives; comments and other lines go."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    lines = df.select(key, F.posexplode(F.split(clean, "\n")).alias("line", "raw"))
    body = strip_white(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(strip_white(F.regexp_extract(body, "^([^:]*):", 1)))
    return lines.select(key, F.col("line").cast("long").alias("line"), field.alias("field"), strip_white(F.regexp_extract(body, "^[^:]*:(.*)$", 1)).alias("value")).filter(F.col("field").isin(*FIELDS))


def parsed(df: DataFrame, key: str = "origin", text: str = "body") -> DataFrame:
    """key, group_no, agents, rule_no, directive, pattern: a row per rule, one of nulls for a group without rules.

    A user-agent line after anything else opens a group; a running count of such lines numbers
    the groups of a file. Files are capped where they are fetched, so a file's lines are a bounded group.
    """
    order = Window.partitionBy(key).orderBy("line")
    d = directives(df, key, text).withColumn("opens", (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent"))
    d = d.withColumn("group_no", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = d.filter((F.col("field") == "user-agent") & (F.col("value") != "")).groupBy(key, "group_no").agg(F.array_sort(F.collect_set(F.lower("value"))).alias("agents"))
    valid = F.col("value").rlike(r"^[/*]") | ((F.col("field") == "allow") & (F.col("value") == ""))
    rules = d.filter(F.col("field").isin("allow", "disallow") & valid).select(
        key, "group_no", F.col("line").alias("rule_no"), F.col("field").alias("directive"), urls.percent_normalized(F.col("value")).alias("pattern")
    )
    return agents.join(rules, [key, "group_no"], "left").select(key, "group_no", "agents", "rule_no", "directive", "pattern")


def sitemaps(df: DataFrame, key: str = "origin", text: str = "body") -> DataFrame:
    return directives(df, key, text).filter((F.col("field") == "sitemap") & (F.col("value") != "")).select(key, "line", F.col("value").alias("sitemap"))


def capped(text: Column, most_bytes: int) -> Column:
    """The longest start of ``text`` of at most ``most_bytes`` UTF-8 bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.hex(F.substring(raw, most_bytes + 1 - k, 1)).rlike("^[89AB]")  # noqa: E731  the byte behind the cut continues a character
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(text) > most_bytes, F.decode(F.substring(raw, F.lit(1), F.lit(most_bytes) - back), "UTF-8")).otherwise(text)


def from_fetches(fetches: DataFrame, most_bytes: int = 500 * 1024) -> DataFrame:
    """origin, body, unavailable: 2xx gives its text (capped in bytes, between characters), 4xx allows everything, anything else is unavailable."""
    ok, client = F.col("status").between(200, 299), F.col("status").between(400, 499)
    return fetches.select("origin", F.when(ok, F.coalesce(capped(F.col("body"), most_bytes), F.lit(""))).otherwise("").alias("body"), (~F.coalesce(ok | client, F.lit(False))).alias("unavailable"))

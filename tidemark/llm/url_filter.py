"""URL filters: rules on a host and its subdomains below a path, met by short hash prefixes.

A rule's key is its host and its path up to the last slash; what stands behind that slash is its tail. A URL is expanded
into the expressions that could name it: suffixes of its host, cut at dots, with prefixes of its path, cut at slashes,
no more of either than the longest rule has. Expressions and keys meet by an equi-join on the first eight hex digits of their
SHA-256; full digests confirm the match, and of the rules that fit a URL the longest decides. Where rules have tails, their
lengths come along with the key, and the URL's path, cut to these lengths, is joined with the rules by digest again: a URL
meets rules that fit it and collisions of prefixes, however many rules a host has.

Rules are what joins send to every task, if they are few by their own count; else both sides are dealt out. The pages never are:
their table is small on disk, as URLs compress well, and makes many times as many expressions in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut

#: The contract's rules: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
RULE_COLUMNS = "host string, path string, verdict string"
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
PREFIX = 8
#: Rules of at most so many bytes are sent to every task; one takes so many besides its text.
SENT, RULE_BYTES = 8 << 20, 256


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path as written; both empty for a null URL or one without ``://``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(whole, URL, 1)), F.regexp_extract(whole, URL, 2)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the short prefix of its digest ``name`` as ``_short``: what is joined on."""
    return df.withColumn("_short", F.substring(name, 1, PREFIX))


def met(expressions: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Rows of ``expressions`` (_digest) with those of ``table`` (_key, unique): joined on prefixes, confirmed by full digests. ``how``: the table's join hint."""
    return prefixed(expressions, "_digest").join(prefixed(table, "_key").hint(how), "_short").filter(F.col("_digest") == F.col("_key")).drop("_short", "_key", "_digest")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``.

    ``rules``: host, path, verdict. A rule fits hosts equal to its own or below it, if the URL's path starts with the rule's. The longest
    rule wins, by code points of host and path together, then by those of its host; of rules that differ in
    the verdict alone the larger one counts (block before allow). A URL that no rule fits gets ``default`` and a null rule; so do
    null URLs and those without ``://``, whose host and path are empty. A URL with an empty path meets rules with an empty
    path only. Rows of null and repeated ids are judged each by itself; an empty table gives no rows, no rules (or none but null
    ones) leave all to ``default``. Very long URLs make no more expressions than the rules have labels and slashes.
    """
    host, path = split_url(F.col(url_col))
    rows = cut(pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    known = rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), "verdict").filter("h is not null and p is not null").groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("d", F.expr("substring(p, 1, length(p) - length(substring_index(p, '/', -1)))")).withColumn("tail", F.expr("length(p) - length(d)"))
    rule = F.struct(F.expr("length(h) + length(p)").alias("n"), F.length("h").alias("nh"), F.concat("h", "p").alias("rule"), F.col("verdict").alias("verdict"))
    slashes = F.expr("length(d) - length(replace(d, '/', ''))")
    most = known.agg(F.max(F.size(F.split("h", r"\."))).alias("labels"), F.max(slashes).alias("slashes"), F.max("tail").alias("tail"), F.sum(F.octet_length(F.concat("h", "p", F.coalesce("verdict", F.lit("")))) + RULE_BYTES).alias("bytes")).first()
    if most["labels"] is None:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    how = "broadcast" if most["bytes"] <= SENT else "merge"
    keys = known.groupBy(digest(F.col("h"), F.col("d")).alias("_key")).agg(F.max(F.when(F.col("tail") == 0, rule)).alias("r"), F.collect_set(F.when(F.col("tail") > 0, F.col("tail"))).alias("tails"))
    hosts = F.expr(f"array_distinct(transform(sequence(1, {most['labels']}), k -> substring_index(host, '.', -k)))")
    starts = F.expr(f"transform(sequence(0, least({most['slashes']}, length(path) - length(replace(path, '/', '')))), k -> if(k = 0, '', concat(substring_index(path, '/', k), '/')))")
    asked = rows.select("rid", "path", F.explode(hosts).alias("eh"), starts.alias("ed")).withColumn("ed", F.explode("ed"))
    hits = met(asked.withColumn("_digest", digest(F.col("eh"), F.col("ed"))), keys, how)
    found = hits.select("rid", "r")
    if most["tail"]:
        longer = hits.select("rid", "eh", "ed", "path", F.explode("tails").alias("k")).filter("length(path) >= length(ed) + k")
        longer = longer.select("rid", digest(F.col("eh"), F.expr("substring(path, 1, length(ed) + k)")).alias("_digest"))
        found = found.unionByName(met(longer, known.filter("tail > 0").select(digest(F.col("h"), F.col("p")).alias("_key"), rule.alias("r")), how))
    best = rows.join(found.groupBy("rid").agg(F.max("r").alias("b")).hint("merge"), "rid", "left")
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), RULE_COLUMNS)


ORACLE = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, row_number() OVER () AS rid FROM pages),
     r(h, p, v) AS (VALUES {", ".join(map(str, RULES))}),
     m AS (SELECT rid, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS verdict
           FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""

"""Fetch sequences and robots verdicts as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import outcomes, urls
from tidemark.operators.keyed import latest
from tidemark.operators.scans import as_of
from tidemark.sources import robots


def fetch_sequence(tries: DataFrame, attempts: int = 3, retries: int = 2) -> DataFrame:
    """From what each try would give to what happens: job_id, outcome, n_attempts, last_fetcher.

    ``tries``: job_id, order_index, fetcher, try_no (from 0), failure (null: success), proceed_on (array or null). A
    fetcher is tried again after transient failures, ``retries`` times at most; the next one follows if the
    last failure lets it. Nothing is collected: each step is a minimum over (job, fetcher), then over jobs.
    """
    used = tries.filter((F.col("order_index") < attempts) & (F.col("try_no") <= retries))
    transient = F.coalesce(F.col("failure").isin(*outcomes.TRANSIENT), F.lit(False)) & (F.col("try_no") < retries)
    ends = used.groupBy("job_id", "order_index").agg(
        F.min(F.when(~transient, F.struct("try_no", "failure", "fetcher", "proceed_on"))).alias("end"), F.max(F.struct("try_no", "failure", "fetcher", "proceed_on")).alias("last")
    )
    ends = ends.withColumn("end", F.coalesce("end", "last"))
    stops = F.col("end.failure").isNull() | ~outcomes.may_proceed(F.col("end.failure"), F.col("end.proceed_on"))
    row = F.struct("order_index", "end")
    found = ends.groupBy("job_id").agg(F.min(F.when(stops, row)).alias("stop"), F.max(row).alias("last"))
    found = found.select("job_id", F.coalesce("stop", "last").alias("f"))
    spent = ends.join(found.select("job_id", F.col("f.order_index").alias("_at")), "job_id").filter("order_index <= _at")
    count = spent.groupBy("job_id").agg(F.sum(F.col("end.try_no") + 1).cast("long").alias("n_attempts"))
    return found.join(count, "job_id").select(
        "job_id", F.coalesce("f.end.failure", F.lit("ok")).alias("outcome"), "n_attempts", F.col("f.end.fetcher").alias("last_fetcher")
    )


def applying(rules: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """(origin, top, lengths) of every origin that has groups, and the rules (origin, start, pattern, best) that apply to ``agent``.

    ``start`` is what a pattern says before its first wildcard. Of equal patterns of an origin one row is left, the one that would decide.
    """
    named = F.array_max(F.transform(F.filter("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), F.lower(a))), F.length))
    weight = F.coalesce(named, F.when(F.array_contains("agents", "*"), 0), F.lit(-1))
    weighed = rules.withColumn("weight", weight).groupBy("origin", "weight", "pattern").agg(
        F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), (F.col("directive") == "allow").alias("allow"), (-F.col("rule_no")).alias("r"), "directive", "pattern"))).alias("best")
    )
    weighed = weighed.withColumn("start", F.regexp_extract("pattern", r"^(.*?)(?:\*|\$$|$)", 1))
    tops = weighed.groupBy("origin").agg(F.max("weight").alias("top"))
    apply = weighed.join(tops, "origin").filter((F.col("weight") == F.col("top")) & (F.col("top") >= 0) & F.col("best").isNotNull()).select("origin", "start", "pattern", "best")
    lengths = apply.groupBy("origin").agg(F.array_sort(F.collect_set(F.length("start"))).alias("lengths"))  # no more than a path has characters
    return tops.join(lengths, "origin", "left"), apply


def robots_verdict(targets: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``targets`` (origin, url, ...) with verdict, agent_group and matched_rule; repeated targets are judged each.

    ``rules``: origin, group_no, agents array, rule_no, directive, pattern (a group without rules has one row of nulls).
    The groups with the longest declared name inside ``agent`` apply, else those for ``*``; of their rules the
    longest matching pattern decides, allow before disallow. Rules are an index by origin and literal start: a
    path is cut to the lengths that starts of its origin have, met with the rules by equality, and globs are verified for
    those alone, so an origin with very many rules is no product of rules and paths. Each different URL is judged once, as
    a narrow row, and keeps one best rule by an aggregate that is combined before the shuffle. Targets without an origin are allowed.
    """
    origins, apply = applying(rules, agent)
    asked = targets.select("origin", "url").distinct().join(origins.filter("lengths is not null").select("origin", "lengths"), "origin")
    asked = asked.withColumn("_path", urls.percent_normalized(F.concat(urls.path(F.col("url")), urls.query(F.col("url")))))
    cuts = asked.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("_path")))).withColumn("start", F.expr("substring(_path, 1, n)"))
    hits = cuts.select("origin", "url", "_path", "start").join(apply, ["origin", "start"]).filter(urls.glob_match(F.col("pattern"), F.col("_path")))
    found = hits.groupBy("origin", "url").agg(F.max("best").alias("b"))
    out = targets.join(found, ["origin", "url"], "left").join(origins.select("origin", "top"), "origin", "left")
    return out.select(
        *targets.columns,
        F.when(F.col("b.directive") == "disallow", "disallowed").otherwise("allowed").alias("verdict"),
        F.when(F.col("top") > 0, agent).when(F.col("top") == 0, "*").otherwise("none").alias("agent_group"),
        F.when(F.col("b").isNotNull(), F.concat("b.directive", F.lit(": "), "b.pattern")).alias("matched_rule"),
    )


def fresh_at(now: str, ttl_s: int) -> Column:
    """Whether an entry's ``fetched_at`` is less than ``ttl_s`` seconds before ``now`` and not after it, to the microsecond."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return (age >= 0) & (age < ttl_s * 1_000_000)


def robots_check(targets: DataFrame, cache: DataFrame, fetches: DataFrame, agent: str, now: str, ttl_s: int = 3600) -> DataFrame:
    """``targets`` (origin, url, ...) with verdict, agent_group, matched_rule, from_cache and unavailable.

    ``cache``: origin, fetched_at, body, unavailable; an origin's newest entry that is younger than ``ttl_s`` and not of the future
    gives its rules. The others take what was fetched now (origin, status, body): 2xx its text, 4xx allows everything, anything
    else, or no answer at all, is unavailable and closes the origin.
    """
    fresh = latest(cache.filter(fresh_at(now, ttl_s)), ["origin"], ["fetched_at", "body"]).select("origin", "body", "unavailable", F.lit(True).alias("from_cache"))
    new = robots.from_fetches(fetches).join(fresh, "origin", "left_anti").select("origin", "body", "unavailable", F.lit(False).alias("from_cache"))
    known = fresh.unionByName(new)
    rules = robots.parsed(known.filter("not unavailable").select("origin", "body"))
    judged = robots_verdict(targets, rules, agent).join(known.drop("body"), "origin", "left")
    closed = F.coalesce("unavailable", F.lit(True))
    return judged.select(
        *targets.columns,
        F.when(closed, "disallowed").otherwise(F.col("verdict")).alias("verdict"),
        F.when(closed, "unavailable").otherwise(F.col("agent_group")).alias("agent_group"),
        F.when(~closed, F.col("matched_rule")).alias("matched_rule"),
        F.coalesce("from_cache", F.lit(False)).alias("from_cache"),
        closed.alias("unavailable"),
    )


def cached_as_of(checks: DataFrame, cache: DataFrame, at: str, ttl_s: int = 3600) -> DataFrame:
    """``checks`` (origin, ``at``, ...) with the columns of the newest entry of ``cache`` (origin, fetched_at, ...) not after each check's own time, and from_cache.

    An entry of ``ttl_s`` seconds or more counts as none: its columns are null and the origin has to be fetched again.
    """
    others = [c for c in cache.columns if c not in ("origin", "fetched_at")]
    met = as_of(checks, cache, "origin", at, "fetched_at", "_entry")
    age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_entry.fetched_at").cast("timestamp"))
    met = met.withColumn("from_cache", F.coalesce(age < ttl_s * 1_000_000, F.lit(False)))
    return met.select(*checks.columns, "from_cache", *[F.when(F.col("from_cache"), F.col(f"_entry.{c}")).alias(c) for c in others])


def dns_verdict(hosts: DataFrame, answers: DataFrame, reason) -> DataFrame:
    """``hosts`` (host) with reason: the first blocked answer's, or dns_resolution_failed without one; null if all are public."""
    seen = answers.groupBy("host").agg(F.min(F.when(reason.isNotNull(), F.struct("pos", reason.alias("r")))).alias("bad"))
    return hosts.join(seen.withColumn("known", F.lit(True)), "host", "left").select(
        "host", F.when(F.col("known").isNull(), "dns_resolution_failed").otherwise(F.col("bad.r")).alias("reason")
    )

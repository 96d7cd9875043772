"""Robots rules: caps in bytes, the prefix index against a walk over all rules, hot origins."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import policy
from tidemark.plans.check import cached_rules
from tidemark.sources import robots


@pytest.mark.parametrize("most", range(5, 13))
def test_caps_end_between_characters(spark, most):
    texts = ["é" * 6, "日" * 4, "😀" * 3, "a" * 12, "ab" + "日é😀x", "", "a" * 5, "é" * 3000]
    df = spark.createDataFrame([(str(i), 200, t) for i, t in enumerate(texts)] + [("n", 200, None)], "origin string, status int, body string")
    got = {r.origin: r.body for r in robots.from_fetches(df, most).collect()}
    for i, t in enumerate(texts):
        assert got[str(i)] == t.encode()[:most].decode(errors="ignore")
    assert got["n"] == ""


def walked(rules, origin, path):
    """The deciding rule by a walk over all of them."""
    best = None
    for at, n, directive, pattern in rules:
        if at == origin:
            body = pattern[:-1] if pattern.endswith("$") else pattern + "*"
            if re.fullmatch("(?s)" + ".*".join(map(re.escape, body.split("*"))), path):
                key = (len(pattern), directive == "allow", -n)
                best = max(best or (key, ""), (key, f"{directive}: {pattern}"))
    return best[1] if best else None


def test_index_finds_what_a_walk_finds(spark):
    rng = random.Random(6)
    piece = lambda: "".join(rng.choice("ab/*$") for _ in range(rng.randint(0, 6)))
    rules = [(f"https://o{rng.randrange(3)}.org", n, rng.choice(["allow", "disallow"]), rng.choice(["/", "*", ""]) + piece()) for n in range(400)]
    paths = ["/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    targets = [(f"https://o{rng.randrange(5)}.org", p, k) for k, p in enumerate(paths + paths[:50])] + [(None, "/", 900), (None, "/", 900)]
    t = spark.createDataFrame([(o, f"{o or 'https://x.org'}{p}", k) for o, p, k in targets] + [(targets[0][0], targets[0][0] + targets[0][1], 0)], "origin string, url string, k int")
    r = spark.createDataFrame([(o, 1, ["*"], n, d, p) for o, n, d, p in rules] + [("https://o4.org", 1, ["other"], None, None, None)], "origin string, group_no long, agents array<string>, rule_no long, directive string, pattern string")
    got = policy.robots_verdict(t, r, "bot").collect()
    assert len(got) == len(targets) + 1  # equal targets stay apart
    for x in got:
        want = walked(rules, x.origin, x.url.split(".org", 1)[1])
        assert x.matched_rule == want and x.verdict == ("disallowed" if (want or "").startswith("dis") else "allowed")
        assert x.agent_group == ("*" if x.origin in {o for o, *_ in rules} else "none")


def test_one_origin_with_very_many_rules(spark):
    rules = spark.range(10_000).select(F.lit("https://hot.org").alias("origin"), F.lit(1).alias("group_no"), F.array(F.lit("*")).alias("agents"), F.col("id").alias("rule_no"), F.lit("disallow").alias("directive"), F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/*.pdf")).alias("pattern"))
    targets = spark.range(200_000).select(F.lit("https://hot.org").alias("origin"), F.concat(F.lit("https://hot.org/d"), (F.col("id") % 20_000).cast("string"), F.lit("/x"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".pdf").otherwise(".htm")).alias("url"))
    began = time.time()
    assert {r.verdict: r["count"] for r in policy.robots_verdict(targets, rules, "bot").groupBy("verdict").count().collect()} == {"disallowed": 50_000, "allowed": 150_000}
    assert time.time() - began < 60  # the product has 2 * 10^9 rows


def test_lifetimes_end_inside_a_second(spark):
    """An entry is fresh for whole lifetimes, to the microsecond, and one of the same second after now is of the future."""
    times = {"just": "2024-01-14 23:00:00.000001", "over": "2024-01-14 23:00:00", "now": "2024-01-15 00:00:00", "later": "2024-01-15 00:00:00.000001", "old": "2024-01-14 22:59:59.999999", "none": None}
    cache = spark.createDataFrame(list(times.items()), "origin string, at string").select("origin", F.col("at").cast("timestamp").alias("fetched_at"), F.lit("").alias("body"), F.lit(False).alias("unavailable"))
    want = {o: o in ("just", "now") for o in times}
    assert {r.origin: r.from_cache for r in cached_rules(cache.select("origin"), cache, "2024-01-15 00:00:00").collect()} == want
    targets = cache.select("origin", F.lit("https://x.org/a").alias("url"))
    fetches = spark.createDataFrame([], "origin string, status int, body string")
    assert {r.origin: r.from_cache for r in policy.robots_check(targets, cache, fetches, "bot", "2024-01-15 00:00:00").collect()} == want

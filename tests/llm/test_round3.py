"""Vector codes, URL filters and hard negatives against plain Python written from their contracts."""

import hashlib
import math
import random

import numpy as np
import pytest

from tests.llm.test_brute_force import LOW, rows_of, same
from tidemark.llm import hard_negatives, url_filter, vector_codes

# ------------------------------------------------------------------ URL filters


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:at].translate(LOW), rest[at:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [
    None, "", "x", "://", "http://", "http://COM", "http://a.COM/", "com/", "http://www.example.com/en/x?y#z", "http://example.com/en", "http://xexample.com/en/", "http://b.example.com/en/",
    "HTTP://c.net/es/1", "http://c.net/ES/1", "http://net/fr/", "http://a..net/fr//", "http://net./fr/", "http://u@www.example.com:80/en/", "http://a.net?x=/es/", "http://a.net#/es/", "x://y://z.com/",
    "http://" + "a." * 3000 + "com/" + "d/" * 3000, "http://é.com/日本", "http://e.com/\n/x", "http:///en/", "http://example.com//en/",
]


def test_urls_by_the_contract(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[8], ""), (3, URLS[8], ""), (3, URLS[8], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    same(rows_of(url_filter.filter_urls(df, url_filter.contract_rules(spark)), "page_id", "host", "path", "rule", "verdict"), [(i, *brute_url(u, url_filter.RULES)) for i, u, _ in rows])


def test_urls_by_many_rules(spark):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(0, n)))
    host = lambda: ".".join(part(2) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/"]) + "/".join(part(2) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(300))}.values())
    rules += [("hot", f"/k{i}", "block") for i in range(2000)]
    rows = [(i, f"http://{host()}{path()}") for i in range(600)] + [(1000 + i, f"http://x.hot/k{i}") for i in range(200)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], url_filter.RULE_COLUMNS))
    same(rows_of(got, "page_id", "host", "path", "rule", "verdict"), [(i, *brute_url(u, rules)) for i, u in rows])


@pytest.mark.parametrize("sent", [url_filter.SENT, 0])
def test_urls_are_not_broadcast(spark, monkeypatch, sent):
    monkeypatch.setattr(url_filter, "SENT", sent)
    rules = [*url_filter.RULES, *(("example.com", f"/en/k{i}", "allow") for i in range(0, 900, 7)), ("b.example.com", "/en/k1", None)]
    rows = [(i, f"http://{'abc'[i % 3]}.example.{'net' if i % 5 == 0 else 'com'}/en/k{i % 1000}") for i in range(3000)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, url_filter.RULE_COLUMNS))
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()]
    same(found, [(i, h, p, r, v or "allow") for i, (h, p, r, v) in ((i, brute_url(u, rules)) for i, u in rows)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "BroadcastHashJoin [rid" not in plan  # pages: few bytes on disk, any number of expressions in memory
    assert ("BroadcastHashJoin" in plan) == (sent > 0)


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_COLUMNS)
    same(rows_of(url_filter.filter_urls(df, none), "page_id", "host", "path", "rule", "verdict"), [(1, "a.com", "/", None, "allow")])
    assert url_filter.filter_urls(df.limit(0), url_filter.contract_rules(spark)).count() == 0


# ------------------------------------------------------------------ vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    ok = [(i, [max(-(1 << 24), min(1 << 24, math.floor(4096 * float(np.float32(x))))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = -(-max((len(v) for _, v, _ in ok), default=0) // parts)
    ok = sorted(((i, v + [0] * (w * parts - len(v)), label) for i, v, label in ok), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in ok]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds + 1):
        near = [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cuts]
        final, old = books, books
        books = [[(lambda own, e: [sum(x) // len(own) for x in zip(*own, strict=True)] if own else e)([c[p] for c, n in zip(cuts, near, strict=True) if n[p][1] == k], e) for k, e in enumerate(old[p])] for p in range(parts)]
    error = [sum(d for d, _ in n) for n in near]
    total = {}
    for (_, _, label), e in zip(ok, error, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in final for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in n), e, total[label], sha) for (i, _, label), n, e in zip(ok, near, error, strict=True)]


def vector_rows(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.4, (7, dims))
    return [(i, [float(x) for x in np.round(centers[rng.integers(7)] + rng.normal(0, spread, dims), 2)], int(rng.integers(4))) for i in range(n)]


BAD_VECTORS = [(9001, None, 1), (9002, [None] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [0.0] * 15, 1)]


@pytest.mark.parametrize("rows", [5, 64, 4096])
def test_codes_by_brute_force(spark, rows):
    data = vector_rows(300, 16, rows) + BAD_VECTORS
    data += [(7, data[7][1], None), (7, data[8][1], 2), (None, data[9][1], None), (400, [0.0] * 16, 0), (401, [0.0] * 16, 0), (402, [1e9, -1e9] + [0.5] * 14, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got = vector_codes.with_label_error(vector_codes.compress(df, rows=rows))
    same(rows_of(got, "vec_id", "code", "error", "label_error", "codebooks_sha256"), brute_codes(data))


def test_codes_of_few_and_odd_vectors(spark):
    for data in ([(3, [1.0] * 16, 1)], [(i, [0.25] * 16, 1) for i in range(20)], [(1, [0.5] * 11, 1), (2, [0.5] * 3, None), (3, [], 2)], [(1, [], 1)], BAD_VECTORS, []):
        df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
        same(rows_of(vector_codes.with_label_error(vector_codes.compress(df)), "vec_id", "code", "error", "label_error", "codebooks_sha256"), brute_codes(data))


def test_heaps_leave_what_drift_does_not_reach():
    rng = np.random.default_rng(5)
    parts = rng.integers(-4000, 4000, (4096, 8))
    books = parts[:16][None]
    pop = vector_codes.Heaps(np.array([3, 0]), np.array([2, 0, 1], np.int32), np.array([0.5, 1.5, 2.5]))
    assert pop.violated(0, 0.4) == [] and not pop.open  # nothing leaves its array
    assert pop.violated(0, 1.5) == [2, 0] and pop.violated(1, 9.0) == []
    assert [x.tolist() for x in pop.arrays()] == [[1, 0], [1], [2.5]]
    found = vector_codes.squared(parts, books[0])
    assert (found == ((parts[:, None].astype(object) - books[0][None]) ** 2).sum(axis=2)).all()


# ------------------------------------------------------------------ hard negatives


def brute_negatives(rows):
    held = lambda x: max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x)))))
    ok = [(i, [held(x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, v, label) in enumerate(ok):
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for b, (i, w, other) in enumerate(ok) if a != b)
        for neg, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -neg <= 100 * -s[0] <= 95 * -neg][:3]
            out += [(anchor, positive, k + 1, i, -neg, -s) for k, (s, i, _) in enumerate(fits)]
    return out


@pytest.mark.parametrize("block", [9, 100, None])
def test_negatives_by_brute_force(spark, block):
    data = vector_rows(400, 16, 11, 0.15) + BAD_VECTORS
    data += [(0, data[0][1], data[0][2]), (0, data[5][1], 3), (450, data[7][1], None), (None, data[9][1], 1), (1450, [0.0] * 16, 0), (1500, [1e12] * 16, 1), (1550, [-0.5] * 16, 9), (1600, [0.5] * 5, 2)]
    df = spark.createDataFrame([(*r, 0) for r in data], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    got = hard_negatives.mine(hard_negatives.relabelled(df), block=block, entries=8)
    same(rows_of(got, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), brute_negatives(data))


def test_negatives_of_few_rows(spark):
    for data in ([], BAD_VECTORS, [(50, [1.0] * 8, 1)], [(50, [1.0] * 8, 1), (51, [1.0] * 8, 1)], [(50, [], 1), (51, [], 1), (52, [], 2)], [(50, [1.0] * 3, 1), (51, [1.0] * 3, 1), (52, [0.7, 0.7, 0.7], 2)]):
        df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
        same(rows_of(hard_negatives.mine(hard_negatives.relabelled(df)), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), brute_negatives(data))


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(2)
    v = (rng.normal(0, 1, (5, 64))[rng.integers(5, size=2000)] * 200 + rng.normal(0, 20, (2000, 64))).astype(np.int64)
    books = hard_negatives.fitted(v[:500], 8, 16)
    import pyarrow as pa

    rows = pa.StructArray.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array([0] * 2000), pa.array(v.tolist(), pa.list_(pa.int32()))], ["rid", "id", "label", "v"])
    cell = pa.RecordBatch.from_arrays([pa.array([0]), pa.ListArray.from_arrays(pa.array([0, 2000], pa.int32()), rows)], ["cb", "rows"])
    block = hard_negatives.Block(next(hard_negatives.coded_blocks(iter([cell]), books)), books)
    for q in v[:20]:
        low, high = block.bounds(q, slice(0, 2000))
        assert ((low <= v @ q) & (v @ q <= high)).all()
        assert (high < np.sort(low)[-5]).mean() > 0.5

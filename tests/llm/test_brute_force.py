"""Operators against plain Python written from their contracts, on awkward and on random rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, license_scan, line_dedup, mixing, packing, pii, tokens, topk_search

WHITE = re.compile(r"[\x20\x09-\x0D]")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A B C"), (6, "abc"), (6, "abc"), (None, "a\x0bbc"), (None, None),
    (7, "x" * 70_000 + " end"), (8, "\n" * 3000), (9, "one two three four five six"), (10, "ONE two three four five six"), (11, "\U0001f600 \U0001f600"),
]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


# ------------------------------------------------------------------ exact dedup


def test_exact_dedup(make):
    rng = random.Random(1)
    rows = ODD + [(100 + i, " ".join(rng.choice(["a", "b", "ab", "\t"]) for _ in range(rng.randint(0, 4)))) for i in range(300)]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        want += [(m[3], members[0][3], len(members), k == 0, sha(norm)) for k, m in enumerate(members)]
    same(rows_of(exact_dedup.exact_dedup(make(rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), want)


def test_exact_dedup_rounds(spark):
    """Groups of two and of eight runs over several rounds: a hot text in every run, pairs far apart, all counted once."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 701}" + " " * (i % 5)) for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(19)
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    want = {(i, min(g := groups[t.replace(" ", "")])[1], len(g)) for i, t in rows}
    records = exact_dedup.cut(exact_dedup.digests(df, "doc_id", "text"))
    assert exact_dedup.tree(1, 8) == (2, 1) and exact_dedup.tree(19, 8) == (5, 2) and exact_dedup.tree(19, 2) == (2, 5)
    for fan in (2, 8):
        got = exact_dedup.exact_dedup(df, fan=fan)
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == want and got.filter("kept").count() == len(groups)
        assert exact_dedup.merge_runs(records, fan).count() == len(groups)


# ------------------------------------------------------------------ mixing


def brute_mix(rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, free = Fraction(3 * sum(size.values()), 2), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        for s in over or list(free):
            target[s] = Fraction(2 * size[s]) if over else level * weight[s]
            free.discard(s)
            left -= target[s]
    return size, target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(make, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "\U0001f600", None, "z", "zz"][: 3 + seed]
    rows = [(i, rng.choice([None, "", "w " * rng.randint(0, 30)]), sources[min(len(sources) - 1, int(rng.expovariate(0.9)))]) for i in range(700)]
    df = make(rows)
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    size, target = brute_mix(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, float(target[r.source]), rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in size} == {s: math.floor(float(target[s])) for s in size}
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=key) == sorted((tuple(r)[:5] for r in got), key=key)


def test_mixing_does_not_depend_on_layout_where_ids_repeat(make):
    rows = [(i % 7, f"{'w ' * (i % 9)}t{i}", "ab"[i % 2]) for i in range(300)] + [(None, "w " * i, None) for i in range(40)]
    df = make(rows)
    once = [sorted((tuple(r) for r in mixing.mix(df.repartition(n, "n_chars")).collect()), key=key) for n in (1, 3, 8)]
    assert once[0] == once[1] == once[2]


def test_mixed_documents(make):
    rows = [(i, f"  word{i}  b c\td ", "ab"[i % 10 == 0]) for i in range(200)] + [(900, None, None), (901, "", "a")]
    df = make(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({d: n for d, n in taken.items() if n})


# ------------------------------------------------------------------ packing


def test_packing(make):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(3)
    rows = ODD + [(20, "<|endoftext|>"), (24, "a <|endoftext|> b"), (25, "x\n \n  y \u00a0z \0 w"), (21, "word " * 5000), (22, "w " * 2047), (23, "w " * 2046)] + [(100 + i, "some text " * int(rng.paretovariate(0.6)))[:2] for i in range(150)]
    got = packing.pack(make(rows)).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        at, k = 0, 0
        while at < len(ids):
            n = first if k == 0 and len(ids) > 2048 else min(2048, len(ids) - at)
            want[doc_id, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_encoder_equals_tokenizers_on_any_spacing_and_code_point():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    bpe, rng = Tokenizer.from_file(path("byte_bpe_50k.json")), random.Random(8)
    pool = ["a", "word", "  ", " ", " ", "\n", "\t", "\r\n", "\x1c", "\u200b", "\u3000", "é", "'s", "1", "23", "!!", "<|endoftext|>", "\0", "\U0001f600"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(1, 0x3000)]
    got = packing.Encoder("byte_bpe_50k.json").encode(texts)
    assert [x.tolist() for x in got] == [x.ids for x in bpe.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(
    "bins",
    [
        [[400], [1600, 40], [2000]],  # a move
        [[500], [1148, 420, 400], [1628]],  # one for one, then a move
        [[900], [500, 380, 1100], [1548], [1668]],  # one for two
    ],
)
def test_local_search_empties_a_bin_by_each_exchange(bins):
    lengths = np.array([n for b in bins for n in b])
    at = iter(range(len(lengths)))
    assert len(packing.local_search([[next(at) for _ in b] for b in bins], lengths, 2048)) == len(bins) - 1


def test_local_search_only_improves():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 1400, 60)
        start = packing.best_fit(lengths, 2048)
        before = len(start)
        bins = packing.local_search([list(b) for b in start], lengths, 2048)
        assert len(bins) <= before and sorted(i for b in bins for i in b) == list(range(60))
        assert all(lengths[b].sum() <= 2048 for b in bins)


# ------------------------------------------------------------------ line dedup


def brute_lines(rows, least=40, docs=5):
    clean = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(clean(line)) >= least:
                holders[clean(line)].add(-(2**63) if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        here = -(2**63) if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(clean(x), ())) < docs or here == max(holders[clean(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_line_dedup(make):
    rng = random.Random(5)
    pool = [c * 45 + str(k) for k, c in enumerate("abcdefghij")] + ["é" * 40, "short", "", "  " + "Q" * 41 + "\r"]
    rows = ODD + [(100 + i, "\n".join(rng.choice(pool[: 3 + i % 12]) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(500, "Q" * 41), (500, "q" * 41 + "\nown")]
    got = rows_of(line_dedup.line_dedup(make(rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    same(got, brute_lines(rows))
    out = line_dedup.deduped_documents(make(rows))
    assert out.columns == make(rows).columns and sorted(sha(r.text) for r in out.collect()) == sorted(x[3] for x in brute_lines(rows))


def test_line_dedup_over_many_range_partitions(spark, make):
    """Runs of a line that cross several partitions, and texts of over 64 lines."""
    rng = random.Random(12)
    hot, rare = "H" * 50, ["r" * 40 + str(k) for k in range(3)]
    rows = [(i, "\n".join([*(f"own line {i} " + "z" * 40 + str(k) for k in range(rng.randint(0, 150))), hot, *rng.choices(rare, k=i % 3 == 0), hot, *[""] * rng.randint(0, 90), hot])) for i in range(400)]
    ranges, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows_of_hot = line_dedup.occurrences(make(rows), "doc_id", "text", 40).repartitionByRange("h1", "h2", F.col("did").desc())
        assert rows_of_hot.filter(F.col("h1") == rows_of_hot.groupBy("h1").count().orderBy(F.desc("count")).first().h1).select(F.spark_partition_id()).distinct().count() > 1
        same(rows_of(line_dedup.line_dedup(make(rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute_lines(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


# ------------------------------------------------------------------ n-gram Jaccard join


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rng, count, words, families):
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(words)] for _ in range(families)]
    out = []
    for i in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        out.append((1000 + i, " ".join(w[: rng.choice([words, words, words - 3, words // 2])])))
    return out


@pytest.mark.parametrize(("words", "families"), [(12, 6), (40, 4), (150, 3), (400, 5)])
def test_jaccard_join(make, words, families):
    rng = random.Random(words)
    rows = ODD + near_copies(rng, 260, words, families) + [(5000 + i, " ".join(f"u{rng.randint(0, 99999)}" for _ in range(30))) for i in range(40)]
    same(rows_of(jaccard_join.jaccard_join(make(rows)), "doc_id", "n_shingles", "component_id"), brute_components(rows))


def test_jaccard_join_of_very_long_texts(make):
    rng = random.Random(21)
    base = [[f"w{rng.randint(0, 9000)}" for _ in range(7000)] for _ in range(3)]
    rows = []
    for i in range(36):  # about 0.8 alike: single words changed in places of their own
        w = list(base[i % 3])
        for at in rng.sample(range(len(w)), rng.choice([0, 1, 40, 75, 80, 150])):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    same(rows_of(jaccard_join.jaccard_join(make(rows)), "doc_id", "n_shingles", "component_id"), brute_components(rows))


def test_jaccard_join_many_copies_and_a_common_passage(make):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = near_copies(rng, 700, 60, 1) + [(9000 + i, passage + " " + " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(400)]
    rows += [(20000 + i, passage) for i in range(300)]
    same(rows_of(jaccard_join.jaccard_join(make(rows)), "doc_id", "n_shingles", "component_id"), brute_components(rows))
    kept = jaccard_join.one_of_each(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})


def small_pairs(rng, count):
    """Pairs of texts of 4 to 12 shingles that share no word with other pairs: words added before or behind."""
    out = []
    while len(out) < count:
        n, k = rng.randint(4, 12), rng.randint(0, 3)
        w = [f"p{len(out)}w{i}" for i in range(n + k + 4)]
        pair = (" ".join(w[: n + 4]), " ".join(w)) if rng.random() < 0.5 else (" ".join(w[k:]), " ".join(w))
        out.append(pair)
    return out


def test_jaccard_candidates_hold_every_small_pair_in_a_table_of_its_own(spark):
    pairs, met, want = small_pairs(random.Random(1), 1500), [], set()
    for texts in pairs:
        a, b = map(shingles, texts)
        if a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        batch = pa.RecordBatch.from_pylist([{"text": t} for t in texts])
        data = next(iter(tokens.chunks(batch.column(0))))
        classes = jaccard_join.class_ids(*jaccard_join.shingle_sets(data[2], data[3], 5))
        want.add(tuple(sorted(classes.tolist())))
        sizes = [len(a), len(b)]
        counts = Counter(np.searchsorted(jaccard_join.band_limits(max(sizes), 80, 100), sizes).tolist())
        plan = jaccard_join.allocate(counts, max(sizes), 80, 100, jaccard_join.GROUP_ENTRIES)
        dealt = pa.Table.from_batches(jaccard_join.index(iter([batch]), 5, plan))
        for key in {tuple(r.values()) for r in dealt.select(["channel", "part"]).to_pylist()}:
            group = dealt.filter((pc.field("channel") == key[0]) & (pc.field("part") == key[1]))
            met += jaccard_join.meet(tuple(pa.scalar(k) for k in key), group).to_pylist()
    rare, stars = jaccard_join.candidate_edges(spark.createDataFrame(pa.Table.from_pylist(met).to_pandas(), jaccard_join.MET_SCHEMA))
    edges = rare.unionByName(stars)
    assert len(want) > 500 and want - {tuple(sorted((r.a, r.b))) for r in edges.collect()} == set()


def test_jaccard_join_links_a_pair_of_which_one_hides_its_empty_segments(make):
    words = [f"p444w{k}" for k in range(8)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "p444x0"]))]
    same(rows_of(jaccard_join.jaccard_join(make(rows)), "doc_id", "n_shingles", "component_id"), brute_components(rows))


def test_one_of_each_keeps_a_row_of_every_component_where_ids_are_null_or_repeated(make):
    rng = random.Random(11)
    blank = [(None, None), (None, ""), (None, " \n"), (7, ""), (7, ""), (7, None)]
    rows = [(rng.choice([None, None, 7, 8, i]), " ".join(f"{'uv'[i % 2]}{i // 3 if i % 3 else i}w{k}" for k in range(30 + i % 3))) for i in range(150)]
    rows += rows[:40] + [(None, "one two"), (7, "ONE two"), (7, "three"), (7, "four"), (None, "five"), (None, "five")]
    got = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(make(rows + blank)).collect()]
    same([r for r in got if not shingles(r[1])], blank)
    # Components named by numbered rows instead of ids; of each the smallest id stays, null ids last.
    components = defaultdict(list)
    for (doc_id, text), (_, _, c) in zip(rows, brute_components([(i, t) for i, (_, t) in enumerate(rows)]), strict=True):
        components[c].append((doc_id, text))
    kept = [r for r in got if shingles(r[1])]
    assert len(kept) == len(components) > 50
    for members in components.values():
        (one,) = [r for r in kept if r in members]
        assert one[0] == min((d for d, _ in members if d is not None), default=None)


# ------------------------------------------------------------------ personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    spans = sorted((m.start(), n, m.end()) for n, k in enumerate(BASE) for m in re.finditer(BASE[k], text) if good(k, m[0]))
    return spans, [sum(s[1] == n for s in spans) for n in range(4)], ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)


PII_TEXTS = [
    None, "", "no data", "a@b.c", "x.y+z@mail-1.example.org, a@b", "a@b.co@c.org d@e.f@", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.003.0004", "4111 1111 1111 1111", "4111-1111-1111-1111 5500-0000-0000-0004",
    "4111  1111", "+1 (415) 555-0100 +4930 1234567 +1 23", "++1 415 555 0100+1 415 555 0101", "\U0001f600 mail \U0001f600@x.de me@x.de \U0001f600", "9" * 30_000 + " a@b.de", "1." * 5000 + "4", "a" * 50_000 + "@" + "b." * 3000 + "com",
    "+1" + " " * 40_000 + "5", "call (415) 555-0100 or write john (at) mail (dot) com", "1-2 3-4 5 " * 400, "@" * 3000, "a.b@c-d.e-f.gh-", "٣.1.2.3", "5105 1051 0510 5100\n12",
]


def test_pii_base_spans(make):
    rng = random.Random(2)
    texts = PII_TEXTS + ["".join(rng.choice("12 .-+()@abé\U0001f600\n") for _ in range(rng.randint(5, 120))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.find_pii(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        spans, counts, spelled = brute_pii(text or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, text[:100]
        assert r.base_sha256 == sha(spelled), text[:100]
        assert set(filter(None, spelled.split(","))) <= set(r.spans.split(","))


def test_pii_finds_more_than_the_base_and_redacts(make):
    df = make([(1, "write to john (at) mail (dot) com now"), (2, "the meeting at noon dot product of 2024-05-06 and 12.05.2023"), (3, "mail a@b.de here"), (4, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", b'), (5, "see commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (6, "and 4785380592391138 went"), (7, "order 4785380592391138 went")])
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[1].spans.startswith("email:") and got[2].spans == ""
    assert got[4].spans == "secret:11:51" and got[4].n_secret == got[4].n_spans == 1 and got[5].spans == ""
    assert got[6].spans == "card:4:20" and got[6].n_card == 0 and got[7].spans == ""
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[3] == "mail [EMAIL] here"


def test_pii_held_out_precision_and_recall(spark):
    trees, cuts = pii.fit(spark)
    cases = pii.examples(1500, 77)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.find_pii(df).collect()}
    chosen = [(any(s.startswith(kind) for s in got[i]), bool(good)) for i, (_, kind, good) in enumerate(cases)]
    hits = sum(a and b for a, b in chosen)
    assert hits >= 0.97 * sum(a for a, _ in chosen) and hits >= 0.85 * sum(b for _, b in chosen)


def test_pii_choice_between_overlapping_spans(spark):
    """Running values and the choice rule against plain loops."""
    rng = random.Random(6)
    cases = []
    for i in range(60):
        spans = {True: [], False: []}
        for base in (True, False):
            for k in range(4):
                at = rng.randint(0, 30)
                for _ in range(rng.choice([0, 1, 5, 90])):
                    e = at + rng.randint(5, 60)
                    spans[base].append((at, k, e, "x", 1.0 if base else float(rng.randint(0, 3))))
                    at = e + rng.choice([0, 1, 40, 400])
        cases.append((i, sorted(spans[True]), sorted(spans[False])))
    kind = "array<struct<s:bigint,k:int,e:bigint,kind:string,score:double>>"
    df = spark.createDataFrame(cases, f"i int, base {kind}, wide {kind}")
    got = {r.i: [tuple(x) for x in r.out] for r in df.select("i", pii.best_of(pii.free_of_base(F.col("base"), F.col("wide"))).alias("out")).collect()}
    meet = lambda a, b: a[0] < b[2] and b[0] < a[2]
    for i, base, wide in cases:
        free = [x for x in wide if not any(meet(x, b) for b in base)]
        assert got[i] == [x for x in free if not any(meet(x, y) and (-y[4], y[:2]) < (-x[4], x[:2]) for y in free)]
    sums = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "v array<bigint>").select(pii.running(F.col("v"), pii.plus).alias("r"))
    assert [r.r for r in sums.collect()] == [np.cumsum(range(n)).tolist() for n in (0, 1, 127, 128, 129, 1000)]


def test_pii_many_matches_in_one_text(make):
    began, n = time.time(), 16_000
    (r,) = pii.find_pii(make([(1, "x@y.de 1.2.3.4 " * (n // 2))])).collect()
    assert (r.n_email, r.n_ip, r.n_spans) == (n // 2, n // 2, n) and time.time() - began < 60


# ------------------------------------------------------------------ license scan


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_spans(text):
    """label:start:end of all spans by counting words, from the rule alone."""
    words, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)), []
    for t, label, base in license_scan.templates():
        k = 2 if base else 3
        hits = defaultdict(list)
        for p in range(len(words) - k + 1):
            for q in range(len(t) - k + 1):
                if words[p : p + k] == t[q : q + k]:
                    hits[p - q].append((p, q))
        groups = []
        for d in sorted(hits):
            if base or not groups or d - groups[-1][0] > 2:
                groups.append([d, []])
            groups[-1][0] = d
            groups[-1][1] += hits[d]
        for _, found in groups:
            ps, qs = ({x + i for x in side for i in range(k)} for side in zip(*found, strict=True))
            start, end, part = min(ps), max(ps) + 1, max(qs) - min(qs) + 1
            same = min(len(ps), len(qs))
            if (base and same == len(t)) or (not base and same >= 0.7 * max(end - start, part) and part >= min(len(t), 8)):
                out.append((start, end, label))
    return ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in sorted(out))


def test_license_scan(make):
    rng = random.Random(4)
    pool = "gnu general public license apache cc by nc mit MIT License the é 7".split()
    notice = license_scan.NOTICES[0][0]
    rows = ODD + [(100 + i, " ".join(rng.choice(pool) + rng.choice(["", ".", "-"]) for _ in range(rng.randint(0, 25)))) for i in range(200)]
    rows += [(900, f"x {notice} y"), (901, notice.replace("obtaining a copy", "who is obtaining one copy")), (902, "permission is granted to no one"), (903, " ".join(notice.split()[:12])), (904, " ".join(notice.split()[:6]))]
    for i in range(150):  # notices with words dropped, changed and put in
        w = rng.choice(license_scan.NOTICES)[0].split()
        for _ in range(rng.randint(0, len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(["zz", "the", "of"])] * rng.randint(0, 2)
            w = w or ["x"]
        rows.append((1000 + i, "lead in " * rng.randint(0, 3) + " ".join(w[rng.randint(0, 3) :])))
    got = license_scan.license_scan(make(rows))
    same(rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), [(d, *brute_license(t)) for d, t in rows])
    same(rows_of(got, "doc_id", "spans"), [(d, brute_spans(t)) for d, t in rows])
    found = {r.doc_id: (r.labels, r.score, r.spans) for r in got.collect()}
    n = len(license_scan.templates()[4][0])
    assert found[900] == ("mit", 1.0, f"mit:1:{n + 1}") and found[901][0] == "mit" and 0.7 <= found[901][1] < 1
    assert found[902] == ("", 0.0, "") and found[903] == ("mit", 1.0, "mit:0:12") and found[904] == ("", 0.0, "")


# ------------------------------------------------------------------ top-k search


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_top_k(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]) for i in range(260)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [0.5] * 6), (7, rows[7][1]), (500, [0.0] * 6), (0, rows[3][1]), (0, rows[0][1]), (50, rows[50][1]), (550, [1e12] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = lambda x: max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x)))))
    ok = [(r, i, [held(x) for x in v]) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for r, q, v in ok:  # each row of an id is a query of its own
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for s, i, w in ok if s != r)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    same(rows_of(topk_search.top_k(df, block=block), "query_id", "rank", "vec_id", "score"), want)

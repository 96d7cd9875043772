"""The whole pipeline against plain Python written from the contracts, document by document."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.conftest import documents
from tests.llm.test_brute_force import LOW, brute_components, brute_mix

WORDS = {"en": "the house and garden with many old trees stands near that small river", "de": "das haus und der garten mit vielen alten baeumen steht nahe am kleinen fluss"}


def corpus(rng):
    """Rows (doc_id, text, source, lang): two languages, repeated lines, near copies, texts without letters."""
    rows = []
    boiler = "This line is repeated in very many documents of this corpus."
    for i in range(90):
        lang = "en" if i % 2 else "de"
        body = "\n".join(" ".join(rng.choice(WORDS[lang].split()) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 6)))
        rows.append((i, body + ("\n" + boiler if i % 3 == 0 else ""), rng.choice(["a", "b", "b", "c", None]), lang if i % 5 else None))
    for i in range(0, 40, 4):  # near copies and copies of long texts
        doc = rows[i]
        rows.append((200 + i, doc[1] + (" more" if i % 8 else ""), doc[2], doc[3]))
    return rows + [(900, "12 - 34", "a", None), (901, None, "b", "en"), (902, "", None, None)]


def without_repeated_lines(rows):
    clean = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for doc_id, text, _ in rows:
        for line in text.split("\n"):
            if len(clean(line)) >= 40:
                holders[clean(line)].add(doc_id)
    gone = lambda doc_id, line: len(holders.get(clean(line), ())) >= 5 and doc_id != max(holders[clean(line)])
    return [(d, "\n".join(x for x in t.split("\n") if not gone(d, x)), s) for d, t, s in rows]


def mixture(rows):
    """The mixture's texts: whole epochs, then the first words of the row at the cut."""
    _, target = brute_mix([(d, t, s) for d, t, s in rows])
    out = []
    for source in target:
        own = sorted((hashlib.md5(f"7:{d}".encode()).hexdigest(), d, t) for d, t, s in rows if s == source)
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, _, t in own]
        epochs = math.floor(target[source] / sum(sizes)) if sum(sizes) else 0
        rest = math.floor(target[source] - epochs * sum(sizes))
        for (_, d, t), n in zip(own, sizes, strict=True):
            out += [(d, t)] * (epochs if n else 0)
            part = min(n, max(0, rest))
            rest -= part
            if part:
                out.append((d, t if part == n else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part])))
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = corpus(random.Random(4))
    table = documents(spark, rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(d, t, s) for d, t, s, _ in rows if t and any(c.isalpha() for c in t)]
    lines = without_repeated_lines(kept)
    assert lines != kept
    one = {c for _, _, c in brute_components([(d, t) for d, t, _ in lines])}
    assert len(one) < len(lines)
    mixed = mixture([r for r in lines if r[0] in one])
    want = Counter()
    for doc_id, text in mixed:
        ids = [*bpe.encode(text, add_special_tokens=False).ids, 0]
        assert len(ids) <= 2048
        want[doc_id, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r.sequence_id for r in got}) <= math.ceil(sum(r.length for r in got) / 2048) + 1

"""Shortest edits against the plain table, patches by applying them."""

import random
import re
import time

import pytest

from tidemark.operators import differences as d


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def applied(old, patch):
    """``old`` after a unified patch."""
    out, at, lines = [], 0, re.findall(d.LINE, old)
    body = re.sub(r"\n\\ No newline at end of file\n", "\x00", patch.split("+++ after\n", 1)[1]) if patch else ""
    for line in re.findall(r"[^\n\x00]*[\n\x00]", body):
        text = line[1:-1] + ("\n" if line[-1] == "\n" else "")
        if m := re.match(r"@@ -(\d+),(\d+) ", line):
            start = int(m[1]) - (int(m[2]) > 0)
            out += lines[at:start]
            at = start
        elif line[0] in " -":
            assert lines[at] == text
            out += [text] * (line[0] == " ")
            at += 1
        else:
            out.append(text)
    return "".join(out + lines[at:])


def patched(spark, pairs, context=3):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, old string, new string")
    return [tuple(r)[1:] for r in sorted(d.text_changes(df, "k", "old", "new", context).collect())]


def test_edits_are_shortest_and_patches_apply(spark):
    rng = random.Random(4)
    text = lambda n, words: "".join(f"{rng.randrange(words)}\n" for _ in range(n)) + rng.choice(["", "end"])
    pairs = [(text(rng.randint(0, 30), w), text(rng.randint(0, 30), w)) for w in (1, 2, 3, 8, 40) for _ in range(60)]
    for context in (0, 1, 3):
        for (old, new), (added, removed, patch) in zip(pairs, patched(spark, pairs, context), strict=True):
            a, b = re.findall(d.LINE, old), re.findall(d.LINE, new)
            common = table_length(a, b)
            assert (added, removed) == (len(b) - common, len(a) - common)
            assert applied(old, patch) == new and (patch == "") == (old == new)
            assert sum(x.startswith("+") for x in patch.split("\n")[2:]) == added


@pytest.mark.parametrize("words", [3, 300, 5000])
def test_long_texts_have_no_other_rule(words):
    rng = random.Random(words)
    a, b = ([rng.randrange(words) for _ in range(2000)] for _ in range(2))
    kept = d.shortest_edit(a, b)
    assert len(kept) == table_length(a, b) and all(a[i] == b[j] for i, j in kept)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(kept, kept[1:], strict=False))


def test_frequent_lines_of_long_texts_match():
    a = ["x", "y", "z"] * 100
    assert len(d.shortest_edit(a, ["new", *a[:-1]])) == 299
    began = time.time()
    rng = random.Random(1)
    a = [rng.randrange(50) for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.1]
    assert len(d.shortest_edit(a, b)) == len(b) and time.time() - began < 60


def test_stated_patches(spark):
    pairs = [("line1\nline2\nline3\n", "line1\nlineTWO\nline3\nline4\n"), ("a\nb", "a\nb\nc"), (None, "x\n"), ("x", None), ("", ""), (None, ""), ("same\n", "same\n"), ("é\n\n", "é\n")]
    got = patched(spark, pairs)
    assert got[0] == (2, 1, "--- before\n+++ after\n@@ -1,3 +1,4 @@\n line1\n-line2\n+lineTWO\n line3\n+line4\n")
    assert got[1] == (2, 1, "--- before\n+++ after\n@@ -1,2 +1,3 @@\n a\n-b\n\\ No newline at end of file\n+b\n+c\n\\ No newline at end of file\n")
    assert [g[:2] for g in got[2:]] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0), (0, 1)]
    assert got[2][2].endswith("@@ -0,0 +1,1 @@\n+x\n") and got[4][2] == ""
    ten = "".join(f"line{i}\n" for i in range(10))
    wide, narrow = (patched(spark, [(ten, ten.replace("line5", "lineFIVE"))], c)[0][2] for c in (5, 0))
    assert len(wide) > len(narrow) and narrow.count("\n") == 5

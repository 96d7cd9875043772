"""Selectors: the pass with a stack, the structural joins and a naive walk up and back agree; stated cases of items."""

import random

import pytest

from tidemark.functions import selectors
from tidemark.sources import pages


def naive(rows, at, steps):
    """Whether element ``at`` matches, by trying every ancestor or sibling."""
    comb, tests = steps[-1]
    pre, _, _, parent, previous, path, nth, of_type, tag, attrs = rows[at]
    if not all(t.holds(tag, attrs, nth, of_type) for t in tests):
        return False
    back = []
    while previous >= 0:
        back.append(previous)
        previous = rows[previous][4]
    tried = {"": None, " ": path, ">": path[-1:], "+": back[:1], "~": back}[comb]
    return tried is None or any(naive(rows, x, steps[:-1]) for x in tried)


def random_page(rng, n):
    out, open_ = [], []
    for _ in range(n):
        tag = rng.choice("abi")
        if open_ and rng.random() < 0.4:
            out.append(f"</{open_.pop() if rng.random() < 0.8 else tag}>")
        else:
            cls = " ".join(rng.sample(["x", "y", "z-1"], rng.randint(0, 2)))
            out.append(rng.choice([f"<{tag}>", f'<{tag} class="{cls}" data-k={rng.randint(0, 3)}>', f"<{tag} ID='{rng.choice('pq')}'>", "<br>", "t"]))
            open_ += [tag] if out[-1].startswith(f"<{tag}") and out[-1] != "<br>" else []
    return "".join(out)


def random_selector(rng):
    compound = lambda: rng.choice(["a", "b", "*", "", "i"]) + rng.choice(["", "", ".x", "#p", "[data-k]", "[data-k='2']", "[class~=y]", "[class^=x]", "[class$='1' i]", "[class*='-']", "[class|=z]", ":nth-child(2n+1)", ":nth-child(-n+2)", ":nth-child(2)", ":first-child", ":nth-of-type(even)", ":first-of-type", ":not(.x)", ":not(a[data-k])"])
    one = lambda: "".join((rng.choice([" ", ">", " + ", "~ "]) if k else "") + (compound() or "*") for k in range(rng.randint(1, 4)))
    return ", ".join(one() for _ in range(rng.randint(1, 2)))


def test_three_ways_agree(spark):
    rng = random.Random(8)
    texts = [random_page(rng, rng.randint(0, 60)) for _ in range(40)] + ["", "<a", "<b><i><a class='x y'>"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, html string")
    found = pages.elements(df, "k", "html").cache()
    for n in range(150):
        selector = random_selector(rng)
        program = selectors.Program([selector])
        want = set()
        for k, text in enumerate(texts):
            rows = pages.Numbered(text).rows
            walk, seen = selectors.Walk(program), []
            walk.opened = lambda word, tag, attrs, seen=seen: seen.append(bool(word & program.finals[0]))
            walk.run(text)
            hits = {at for at in range(len(rows)) if any(naive(rows, at, steps) for steps in selectors.parsed(selector))}
            assert {at for at, hit in enumerate(seen) if hit} == hits, selector
            want |= {(k, at) for at in hits}
        if n < 12:
            assert {(r.k, r.pre) for r in pages.select_elements(found, "k", selector).collect()} == want, selector
    for text in texts:
        rows = pages.Numbered(text).rows
        assert all(x <= r[1] and r[0] in rows[x][5] for r in rows for x in range(r[0] + 1, r[1] + 1))


@pytest.mark.parametrize("bad", ["", " ", "a,,b", "a >", "> a", "a > > b", "[", "[[", "a:hover", ":nth-child(x)", ":not(a b)", ".a b.", "a*"])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError):
        selectors.parsed(bad)


def test_wide_and_deep_pages_take_no_search():
    program = selectors.Program(["a ~ a ~ a > i", "b b b b i"])
    wide, deep = selectors.Walk(program), selectors.Walk(program)
    wide.run("<p>" + "<a></a>" * 50_000 + "<a><i>")
    deep.run("<b>" * 20_000 + "<i>")


def items(spark, html, item, base="https://e.org/l/", **options):
    df = spark.createDataFrame([(1, html, base)], "k int, html string, base string")
    return [(r.url, r.title, [tuple(f) for f in r.fields]) for r in pages.items(df, "k", "html", "base", item, **options).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("html", "options", "want"),
    [
        ('<div class="i"><h2>One</h2><a href="/1">more</a></div><div class="i"><h2>None</h2></div>', {"title": "h2"}, [("https://e.org/1", "One", [])]),
        ('<div class="i"><a href="/o">out</a><div class="i"><a href="/n">in</a></div></div>', {}, [("https://e.org/o", "out", [])]),
        ('<div class="i"><div class="i"><a href="n">in</a></div></div>', {}, [("https://e.org/l/n", "in", [])]),
        ('<div class="i"><a href="mailto:a@b.c">m</a><a>no</a><a href="/w">w</a><a href="/x">x</a></div>', {}, [("https://e.org/w", "w", [])]),
        ('<p class="i"><a href="/d">A</a></p><p class="i"><a href="/d?utm_source=x">B</a></p><p class="i"><a href="/e"> </a></p>', {}, [("https://e.org/d", "A", []), ("https://e.org/e", None, [])]),
        ('<div class="i"><area href="/a"><a href="/b">b</a></div>', {"link": "area"}, [("https://e.org/a", None, [])]),
        ('<div class="i"><a href="/b?a=1&amp;b=2">x <b>y</b>&amp;</a></div>', {}, [("https://e.org/b?a=1&b=2", "x y&amp;", [])]),
        (f'<div class="i"><a href="/x">go</a><b class="v">{"v" * 300}</b><b class="v">2</b></div>', {"fields": (("p", ".v"), ("q", ".w"))}, [("https://e.org/x", "go", [("p", "v" * 200)])]),
        ('<div class="i"><a href="/x">go</a><dl><tr><dt>&nbsp;</dt><dd>no</dd><dt>S&nbsp;z</dt><dd>5 m<sup>2</sup></dd><dd>x</dd><dt>S z</dt><dd>6</dd></dl></div>', {"fields": (("size", None, "S z"), ("again", None, "S z"))}, [("https://e.org/x", "go", [("size", "5 m2"), ("again", "x")])]),
        ('<div class="i">never closed <a href="/x">go', {}, [("https://e.org/x", "go", [])]),
    ],
)
def test_items(spark, html, options, want):
    assert items(spark, html, ".i", **options) == want

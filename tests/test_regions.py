"""Ignored and included regions, and what they leave of the hashes."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html, regions
from tidemark.operators import relations

PAGE = '<body>\n<div id="a" class="X y">one <b>two</b></div><p data-k="v">three<br class="cut">four</p><div class="ad">five<div>six</div></div><ul><li>seven<li>eight</ul>\n</body>'


@pytest.mark.parametrize(
    ("ignore", "include", "want"),
    [
        ((), (), PAGE),
        ((".ad",), (), PAGE.replace('<div class="ad">five<div>six</div></div>', "")),
        (("div",), ("body",), '<body>\n<p data-k="v">three<br class="cut">four</p><ul><li>seven<li>eight</ul>\n</body>'),
        (("b", ".cut"), ("#a", "p[data-k=v]"), '<div id="a" class="X y">one </div><p data-k="v">threefour</p>'),
        ((), ("div", "div div"), '<div id="a" class="X y">one <b>two</b></div><div class="ad">five<div>six</div></div>'),
        ((), ("ul",), "<ul><li>seven<li>eight</ul>"),
        ((), ("ul li",), "<li>seven<li>eight"),
        ((), ("[data-k='v'] br",), '<br class="cut">'),
        ((), (".missing",), ""),
    ],
)
def test_cut_regions(ignore, include, want):
    assert regions.cut_regions(PAGE, ignore, include) == want


def test_changes_in_ignored_regions_and_outside_of_included_ones_are_none(spark):
    rows = [(1, "<main><p>a</p></main><i>x</i>"), (2, "<main><p>a</p></main><i>y</i>"), (3, "<main><p>b</p></main><i>x</i>"), (4, None)]
    df = spark.createDataFrame(rows, "k int, h string")
    for options in ({"ignore": ("i",)}, {"include": ("main",)}):
        got = {r.k: r.x for r in df.select("k", html.hashed(F.col("h"), F.lit("https://e.org/"), **options).alias("x")).collect()}
        assert got[1].normalized_hash == got[2].normalized_hash != got[3].normalized_hash and got[1].raw_hash != got[2].raw_hash and got[4].raw_hash is None


def test_broadest(spark):
    rows = [("d", 1, None, None), ("d", 1, 2, None), ("d", 1, 2, "new"), ("d", None, 2, "new"), ("d", 1, None, None), ("e", 1, 2, None), ("e", 1, 2, "new"), ("f", None, None, None), ("f", 3, 3, "new")]
    df = spark.createDataFrame(rows, "destination_id string, site_id int, monitor_id int, kind string")
    got = {tuple(r) for r in relations.broadest(df, "destination_id").collect()}
    assert got == {("d", 1, None, None), ("d", None, 2, "new"), ("e", 1, 2, None), ("f", None, None, None)}

"""Trained operators on held-out data, and every operator on empty tables and clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF
from tidemark.llm import exact_dedup, html_extract, jaccard_join, language_id, license_scan, line_dedup, mixing, packing, pii, queries, topk_search

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>";</script></head>
<body><header>My Site</header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your visit, accept them all.</p></div>
<article><h1>A  long
 headline &amp; more</h1><!-- x --><p>First paragraph has several words, and a <a href="/l">link</a> in it, as usual.
<p>Second &eacute;&#233; paragraph, which is also quite long and has commas, ends here.</p>
<div class="ad">Buy now, cheap!</div><ul><li>One list item of the article text here.</li></ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></aside>
<section id="comments"><div class="comment"><p>Nice article, thanks for it!</p></div></section>
<footer>&copy; 2024 My Site. All rights reserved.</footer></body></html>"""


def test_language_held_out_accuracy(spark, small):
    docs = small("documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = got.filter("held_out and lang is not null and lang_pred <> 'und' and length(text) > 50").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_language_windows_read_every_byte_once():
    """Texts read window by window, side by side, against one text and one byte after the other."""
    rng = np.random.default_rng(1)
    m = language_id.train(["abc def " * 40, "xyz é " * 50], ["a", "b"], steps=3)
    texts = ["", "a", "é" * 5, *("".join(rng.choice(list("ab é\n"), n)) for n in (255, 256, 257, 511, 512, 513, 700, 3000))]
    got = language_id.pooled(m, pa.array(texts))
    for k, text in enumerate(texts):
        d, total = np.frombuffer(text.encode(), np.uint8), np.zeros(2)
        for s in range(0, len(d), language_id.WINDOW):
            e = min(len(d), s + language_id.WINDOW)
            low, high = max(0, s - language_id.LEAD), min(len(d), e + language_id.LEAD)
            ahead, behind = m.forward.run(d[None, low:e])[0][s - low :, 0], m.back.run(d[None, s:high][:, ::-1])[0][high - e :, 0][::-1]
            z = np.concatenate([ahead, behind], axis=1) @ m.w + m.c
            total += (z - np.log(np.exp(z).sum(1, keepdims=True))).sum(0)
        assert np.allclose(got[k], total / max(1, len(d)), atol=1e-5)


def test_language_learns_from_whole_texts_and_rare_languages(make):
    """What tells two languages apart stands behind 5,000 equal characters; a rare language is learned beside a common one."""
    rows = [(i, "lorem ipsum " * 450 + "uvuv wuvu " * 60, "s", "x") for i in range(24)] + [(100 + i, "lorem ipsum " * 450 + "oko poko " * 60, "s", "y") for i in range(24)]
    rows += [(1000 + i, "lorem ipsum uvuv wuvu", "s", "x") for i in range(400)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(make(rows), sample_docs=40).collect()}
    assert all(got[i] == "x" and got[100 + i] == "y" for i in range(24))


def test_language_stage_without_labels_keeps_texts_with_letters(make):
    got = language_id.identified_documents(make([(1, "text", "s", None), (2, "12", "s", None), (3, None, "s", None)])).collect()
    assert [(r.doc_id, r.lang) for r in got] == [(1, None)]


def test_language_edges(make):
    rows = [(i, "the house and the garden " * 3, "s", "en") for i in range(30)] + [(100 + i, "das Haus und der Garten " * 3, "s", "de") for i in range(30)]
    rows += [(900, None, "s", "en"), (901, "", "s", "en"), (902, "12 -- !", "s", "en"), (None, "das Haus", "s", "de"), (903, "x" * 100_000, "s", None), (10, rows[10][1], "s", "en")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(make(rows)).collect()]
    assert len(got) == len(rows)
    assert {d: p for d, p, s in got if d in (900, 901, 902)} == dict.fromkeys((900, 901, 902), "und")
    assert all(p == ("en" if d < 100 else "de") for d, p, _ in got if d is not None and d < 200)
    alone = language_id.identify(make([(1, "text", "s", None)])).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_html_article(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>broken <b>page"), (5, "x", "<!-- open " + "a" * 50_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    want = (
        "A long headline & more First paragraph has several words, and a link in it, as usual. "
        "Second éé paragraph, which is also quite long and has commas, ends here. One list item of the article text here."
    )
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[None].text == got[5].text == "" and got[2].n_chars == 0 and "broken page" in got[4].text + "broken page"


@pytest.mark.parametrize(
    ("put", "shown"),
    [
        ('<svg width="9"/>', ""), ("<svg viewBox='0 0 1 1' /><SVG/>", ""), ("<svg-icon name=x></svg-icon>", ""), ("<title-block></title-block><select-menu></select-menu>", ""),
        ("<button-group></button-group>", ""), ("<script-loader></script-loader><style_x></style_x>", ""), ("<object data=x>", ""),
        ("<template>", ""), ("<svg>", ""), ("<math/>", ""), ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>", "x=1 "), ("<button>Share</button>", ""),
        ("<svg><title>Icon</title><style/><text>Label</text><svg><g>In</g></svg>Out</svg>", ""), ("<template><div><p>Row <li>x</div> y</template>", ""), ("<textarea><p>Draft</p></textarea>", ""),
    ],
)
def test_html_elements_that_are_no_text_end_where_they_end(put, shown):
    w, trans = html_extract.train()
    plain = html_extract.main_text(PAGE, w, trans)
    assert "First paragraph" in plain and "ends here. One list item" in plain
    assert html_extract.main_text(PAGE.replace("<p>First", f"<p>{put} First"), w, trans) == plain.replace("First", f"{shown}First")


@pytest.mark.parametrize("put", ["<button>Share", "<select><option>One<option>Two", "<object data=x>", "<button>Share</button>"])
def test_html_open_controls_end_with_the_next_block(put):
    w, trans = html_extract.train()
    assert html_extract.main_text(PAGE.replace("<p>First", f"{put}<p>First"), w, trans) == html_extract.main_text(PAGE, w, trans)


def test_html_open_raw_text_runs_to_the_end():
    assert [b[0] for b in html_extract.blocks("<p>a</p><script>if (x) <p>b</p></scripts>")] == ["a"]


def test_html_labelled_pages_held_out():
    w, trans = html_extract.train()
    right = total = 0
    for page, known in html_extract.labelled_pages(60, seed=99):
        found = [b for b in html_extract.blocks(page)]
        for b, label in zip(found, html_extract.decode(html_extract.features(found), w, trans), strict=True):
            if b[0] in known:
                right, total = right + (known[b[0]] == label), total + 1
    assert right >= 0.97 * total


OPERATORS = {
    "pii": (pii.find_pii, "documents"), "exact_dedup": (exact_dedup.exact_dedup, "documents"), "mixing": (mixing.mix, "documents"), "mixed": (mixing.mixed_documents, "documents"),
    "packing": (packing.pack, "documents"), "html": (html_extract.extract, "pages"), "license": (license_scan.license_scan, "documents"), "lines": (line_dedup.line_dedup, "documents"),
    "deduped": (line_dedup.deduped_documents, "documents"), "jaccard": (jaccard_join.jaccard_join, "documents"), "one_of_each": (jaccard_join.one_of_each, "documents"),
    "language": (language_id.identify, "documents"), "identified": (language_id.identified_documents, "documents"), "top_k": (topk_search.top_k, "embeddings"),
}
CLASHING = "rid digest key size slot bucket grp base spans t norm _did _th _row _k _id n k id w h1 class tkey text_2 v cb score lang_pred taken".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_clashing_columns(small, canonical, name):
    operator, table = OPERATORS[name]
    df = small(table)
    assert operator(df.limit(0)).count() == 0
    few = df.filter(F.col(df.columns[0]) % 7 == 1)
    more = few.withColumns({c: F.lit("odd") for c in CLASHING if c not in df.columns})
    plain, clash = operator(few), operator(more)
    assert canonical(plain.columns, [tuple(r) for r in plain.collect()]) == canonical(plain.columns, [tuple(r) for r in clash.select(*plain.columns).collect()])


def test_pipeline_stages(spark, small):
    """Each stage against what its operator's query says of the stage's own input."""
    docs = small("documents")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    told = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert {r.doc_id: r.lang for r in kept.collect()} == {d: p for d, p in told.items() if p != "und"}
    lines = corpus_pipeline.dedup_lines(spark, kept, SF)
    assert lines.columns == docs.columns and lines.count() == kept.count()
    near = corpus_pipeline.join_near_duplicates(spark, lines, SF)
    groups = jaccard_join.jaccard_join(lines).collect()
    assert sorted(r.doc_id for r in near.collect()) == sorted({r.component_id for r in groups})
    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix(near).agg(F.sum("taken")).first()[0]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_queries_have_the_contracts_columns(spark):
    want = {
        "op1_": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_": "doc_id keep_id group_size kept text_sha256", "op3_": "doc_id size source_size target taken",
        "op4_": "doc_id piece start length ids_crc32 sequence_id offset", "op5_": "page_id url text n_chars", "op6_": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op7_": "doc_id n_lines n_dropped kept_sha256", "op8_": "doc_id n_shingles component_id", "op9_": "doc_id held_out lang_pred score", "op10_": "query_id rank vec_id score",
    }
    found = queries.queries()
    for prefix, names in want.items():
        (name,) = [q for q in found if q.startswith(prefix)]
        assert found[name](spark, SF).columns[: len(names.split())] == names.split()

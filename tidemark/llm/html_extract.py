"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes its leaf blocks in order: stretches of text without a block-level tag between them, each
with its open ancestors. Features of ancestors, their class words and the text feed a chain with
two states, main text and the rest; weights and transitions are trained by maximum likelihood
(forward-backward, in numpy) on labelled pages, and each page is decoded by Viterbi. Pages are
independent, so the job is one map over the table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names of the HTML standard by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][\w:.-]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)>",
    re.I | re.S,
)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style noscript textarea iframe title".split()}  # their content is no markup
HIDDEN = set("svg template annotation annotation-xml".split())  # their content is markup that is not read as text
HIDDEN_END = re.compile(r"</(svg|template|annotation(?:-xml)?)(?=[\s/>])", re.I)
CONTROL = set("button select option".split())  # inline, but their text is a block of its own
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr", ("table",))}
WORD_KINDS = {
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip topnav subnav",
    "comment": "comment comments reply replies discussion discuss disqus respond commentlist thread",
    "side": "sidebar side widget widgets related recommend recommended rail popular trending more aside secondary",
    "notice": "cookie cookies consent notice gdpr newsletter subscribe popup modal alert signup banner overlay privacy paywall",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead logo topbar branding site-header top",
    "share": "share sharing social follow toolbar buttons tools print",
    "main": "content article post entry story main body text article-body post-content entry-content maincontent prose",
}
KIND_OF = {w: k for k, words in WORD_KINDS.items() for w in words.split()}
ANCESTORS = "nav header footer aside form article main section ul ol table dl figure blockquote pre details dialog button select".split()
OWN = "h1 h2 h3 h4 h5 h6 p li td th dt dd pre div body article section blockquote figcaption span summary caption".split()
NAMES = (
    ["bias"] + [f"in:{x}" for x in ANCESTORS] + [f"word:{x}" for x in WORD_KINDS] + [f"own:{x}" for x in OWN]
    + [f"link:{k}" for k in range(4)] + [f"len:{k}" for k in range(5)] + ["stop", "commas", "copyright", "seen_h1", "no_h1", "symbol", "in_content", "deep_bad"]
)
FEATURE = {n: i for i, n in enumerate(NAMES)}
BAD_KINDS = {"ad", "menu", "comment", "side", "notice", "foot", "share"}


@lru_cache(maxsize=4096)
def kinds_of(attrs: str) -> frozenset[str]:
    """Kinds of the words in an element's class, id and role."""
    found = set()
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            for word in (name, *re.split(r"[-_]+", name)):
                if word in KIND_OF:
                    found.add(KIND_OF[word])
    return frozenset(found)


def blocks(page: str) -> list[tuple[str, tuple, float]]:
    """(text, ancestors as (tag, kinds), share of link characters) of each leaf block with text, in page order."""
    out: list[tuple[str, tuple, float]] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    links = chars = at = 0
    closed: dict[str, int] | None = None  # where the last end tag of each hidden element stands

    def flush() -> None:
        nonlocal links, chars
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, tuple(stack), links / max(1, chars)))
            parts.clear()
        links = chars = 0

    def pop_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stops or stack[k][0] == "template":
                return

    def take(text: str) -> None:
        nonlocal links, chars
        if text and not any(t in HIDDEN for t, _ in stack):
            parts.append(text)
            n = len(text.strip())
            chars += n
            if n and any(t == "a" for t, _ in stack):
                links += n

    while m := TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW_END and not m["end"] and not (m["attrs"].endswith("/") and any(t in ("svg", "math") for t, _ in stack)):
            over = RAW_END[tag].search(page, at)
            at = over.end() if over else len(page)
            continue
        if tag in BLOCK or tag in CONTROL:
            flush()
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in BLOCK:
            pop_to(("p",), ("div", "td", "li", "section", "article", "body", "blockquote"))
            while stack and stack[-1][0] not in BLOCK and stack[-1][0] != "template":  # inline elements left open end with their block
                stack.pop()
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            pop_to(tuple(names.split()), stops)
        if tag in HIDDEN:
            if closed is None:
                closed = {e[1].lower(): e.start() for e in HIDDEN_END.finditer(page)}
            if closed.get(tag, -1) < at:  # never closed: it hides nothing
                continue
        if tag not in VOID and not m["attrs"].endswith("/"):
            stack.append((tag, kinds_of(m["attrs"])))
    take(page[at:])
    flush()
    return out


def features(found: list[tuple[str, tuple, float]]) -> list[list[int]]:
    """Active features of each block."""
    out, seen_h1 = [], False
    for text, path, link in found:
        tags = {t for t, _ in path}
        kinds = set().union(*(k for _, k in path)) if path else set()
        own = next((t for t, _ in reversed(path) if t in BLOCK), "body")
        on = [FEATURE["bias"]]
        on += [FEATURE[f"in:{t}"] for t in ANCESTORS if t in tags]
        on += [FEATURE[f"word:{k}"] for k in kinds]
        if own in OWN:
            on.append(FEATURE[f"own:{own}"])
        on.append(FEATURE["link:0"] + (0 if link == 0 else 1 if link <= 0.3 else 2 if link <= 0.7 else 3))
        n = len(text)
        on.append(FEATURE["len:0"] + (0 if n < 20 else 1 if n < 60 else 2 if n < 150 else 3 if n < 400 else 4))
        if text[-1] in ".!?…":
            on.append(FEATURE["stop"])
        if text.count(",") >= 2:
            on.append(FEATURE["commas"])
        if "©" in text or "copyright" in text.lower():
            on.append(FEATURE["copyright"])
        seen_h1 = seen_h1 or own == "h1"
        on.append(FEATURE["seen_h1" if seen_h1 else "no_h1"])
        if not any(c.isalpha() for c in text):
            on.append(FEATURE["symbol"])
        if tags & {"article", "main"} or "main" in kinds:
            on.append(FEATURE["in_content"])
        if kinds & BAD_KINDS or tags & {"nav", "footer", "aside", "form"}:
            on.append(FEATURE["deep_bad"])
        out.append(on)
    return out


def labelled_pages(count: int, seed: int) -> list[tuple[str, dict[str, int]]]:
    """Labelled pages made from layout rules: html, and for each of its texts whether it is main text."""
    rng = np.random.default_rng(seed)
    syllables = "an er in on re ti al en st la no ma ve so ri ka do lu mi pe".split()
    serial = iter(range(10**9))

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))

    def some(*options):
        return options[int(rng.integers(len(options)))]

    def maybe(p: float) -> bool:
        return bool(rng.random() < p)

    pages = []
    for _ in range(count):
        known: dict[str, int] = {}

        def text(n: int, main: int, stop: bool = True) -> str:
            t = words(n).capitalize() + f" {next(serial)}" + (", " + words(4) + ", " + words(3) if n > 12 else "") + ("." if stop else "")
            known[t] = main
            return t

        def para(main: int) -> str:
            n = int(some(2, 5, 15, 40, 90))
            body = text(n, main)
            if maybe(0.05):
                body += f" {control()} " + text(n, main)
            tag = some("p", "p", "p", "p", "div")
            return f"<{tag}>{body}" + ("" if tag == "p" and maybe(0.2) else f"</{tag}>")

        def control() -> str:
            if maybe(0.6):
                return f"<button{some('', ' type=button')}>{text(int(rng.integers(1, 5)), 0, maybe(0.2))}</button>"
            return "<select>" + "".join(f"<option>{text(int(rng.integers(1, 4)), 0, False)}</option>" for _ in range(int(rng.integers(1, 5)))) + "</select>"

        def menu(n: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/x">{text(int(rng.integers(1, 3)), 0, maybe(0.1))}</a></li>' for _ in range(n)) + "</ul>"

        def boiler(kind: str) -> str:
            if kind == "ad":
                return f'<div class="{some("ad", "ads", "advert top", "sponsored", "promo-box", "ad-slot", "banner")}">{text(int(some(3, 8, 25)), 0)}</div>'
            if kind == "notice":
                return f'<div {some("class", "id")}="{some("cookie-notice", "consent", "newsletter", "gdpr-popup", "alert notice")}">{para(0)}</div>'
            if kind == "share":
                return f'<div class="{some("share", "social-links", "share-bar")}">{menu(3)}</div>'
            if kind == "form":
                return f'<form action="/s">{text(3, 0, False)}<input name="q">{para(0) if maybe(0.5) else ""}</form>'
            if kind == "control":
                return control()
            if kind == "side":
                inner = f"<h3>{text(2, 0, False)}</h3>{some(menu(5), para(0), para(0) + para(0))}"
                return some(f"<aside>{inner}</aside>", f'<div class="{some("sidebar", "widget", "related-posts", "right-rail")}">{inner}</div>', f'<aside class="sidebar">{inner}</aside>')
            inner = f"<h3>{text(2, 0, False)}</h3>" + "".join(f'<div class="comment">{para(0)}</div>' for _ in range(int(rng.integers(1, 5))))
            return some(f'<section id="comments">{inner}</section>', f'<div class="{some("comments", "comment-list", "discussion")}">{inner}</div>', f'<ol class="commentlist"><li>{para(0)}</li><li>{para(0)}</li></ol>')

        def article() -> str:
            parts = []
            if maybe(0.85):
                h1 = f"<h1>{text(int(rng.integers(1, 14)), 1, maybe(0.3))}</h1>"
                parts.append(f"<header>{h1}</header>" if maybe(0.15) else h1)
            for _ in range(int(some(0, 1, 2, 4, 8, 12))):
                r = rng.random()
                if r < 0.7:
                    parts.append(para(1))
                elif r < 0.78:
                    parts.append(f"<h2>{text(4, 1, False)}</h2>{para(1)}")
                elif r < 0.84:
                    parts.append("<ul>" + "".join(f"<li>{text(int(some(3, 10)), 1)}</li>" for _ in range(3)) + "</ul>")
                elif r < 0.88:
                    parts.append(f"<blockquote><p>{text(15, 1)}</p></blockquote>")
                elif r < 0.91:
                    parts.append(f"<table><tr><td>{text(2, 1, False)}</td><td>{text(2, 1, False)}</td></tr></table>")
                elif r < 0.94:
                    parts.append(f'<figure><img src="x"><figcaption>{text(6, 1)}</figcaption></figure>')
                else:
                    parts.append(boiler(some("ad", "notice", "share", "form", "ad", "control", "control")))
            inner = "".join(parts)
            return some(
                f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
                f'<div class="{some("content", "post-content", "entry", "story-body", "article-text")}">{inner}</div>', f'<div id="main">{inner}</div>', f"<div>{inner}</div>",
            )

        top = [f"<nav>{menu(int(rng.integers(2, 8)))}</nav>" if maybe(0.7) else f'<div class="{some("menu", "navbar", "topnav")}">{menu(5)}</div>']
        if maybe(0.5):
            top.insert(0, f"<header>{text(2, 0, False)}{top.pop() if maybe(0.4) else ''}</header>")
        for kind, p in (("notice", 0.25), ("ad", 0.5), ("form", 0.15)):
            if maybe(p):
                top.append(boiler(kind))
        end = [boiler(k) for k, p in (("share", 0.2), ("comment", 0.35), ("side", 0.4), ("ad", 0.2), ("form", 0.15), ("notice", 0.1)) if maybe(p)]
        foot = f"&copy; {words(1)} {next(serial)} {words(int(some(2, 8, 20)))}."
        known[html.unescape(foot)] = 0
        end.append(some(f"<footer>{foot}</footer>", f"<footer>{foot}</footer>", f'<div class="footer">{foot}</div>', f"<footer><p>{foot}</p>{menu(3)}</footer>"))
        pages.append((f"<html><head><title>x</title></head><body>{''.join(top)}{article()}{''.join(end)}</body></html>", known))
    return pages


@lru_cache(maxsize=2)
def train(pages: int = 320, rounds: int = 220, rate: float = 0.12, decay: float = 2e-3, seed: int = 5) -> tuple[list[float], list[list[float]]]:
    """Weights per feature (main text against the rest) and transition scores, by gradient ascent on the likelihood."""
    data = []
    for page, known in labelled_pages(pages, seed):
        found = [b for b in blocks(page) if b[0] in known]
        if found:
            data.append((features(found), [known[b[0]] for b in found]))
    longest = max(len(y) for _, y in data)
    x = np.zeros((len(data), longest, len(NAMES)))
    y = np.zeros((len(data), longest), int)
    mask = np.zeros((len(data), longest), bool)
    for p, (f, labels) in enumerate(data):
        for t, on in enumerate(f):
            x[p, t, on] = 1
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    w, trans = np.zeros(len(NAMES)), np.zeros((2, 2))
    n = mask.sum()
    observed = (x * (y * mask)[..., None]).sum((0, 1))
    steps = mask[:, 1:]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:, :-1][steps], y[:, 1:][steps]), 1)
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        e = np.zeros((*y.shape, 2))
        e[..., 1] = x @ w
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(mask[:, t, None], np.logaddexp(a[:, t - 1, :1] + trans[0], a[:, t - 1, 1:] + trans[1]) + e[:, t], a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + b[:, t + 1]
            b[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:]), b[:, t + 1])
        p1 = np.exp(a[..., 1] + b[..., 1] - z[:, None]) * mask
        xi = np.exp(a[:, :-1, :, None] + trans + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * steps[..., None, None]
        grad = np.r_[observed - (x * p1[..., None]).sum((0, 1)), (pairs - xi.sum((0, 1))).ravel()] / n - decay * np.r_[w, trans.ravel()] / 10
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad * grad - m2)
        step = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
        w, trans = w + step[: len(w)], trans + step[len(w) :].reshape(2, 2)
    return w.tolist(), trans.tolist()


def decode(on: list[list[int]], w: list[float], trans: list[list[float]]) -> list[int]:
    """The most likely labels (Viterbi); ties go to main text."""
    (t00, t01), (t10, t11) = trans
    s0 = s1 = 0.0
    back = []
    for k, active in enumerate(on):
        e = sum(w[i] for i in active)
        if k:
            b0, b1 = s1 + t10 >= s0 + t00, s1 + t11 >= s0 + t01
            s0, s1 = (s1 + t10 if b0 else s0 + t00), (s1 + t11 if b1 else s0 + t01) + e
            back.append((b0, b1))
        else:
            s1 = e
    label = int(s1 >= s0)
    out = [label] if on else []
    for pair in reversed(back):
        label = int(pair[label])
        out.append(label)
    return out[::-1]


def main_text(page: str, w: list[float], trans: list[list[float]]) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, keep in zip(found, decode(features(found), w, trans), strict=True) if keep)


def extract_batches(batches: Iterator[pa.RecordBatch], w: list[float], trans: list[list[float]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "", w, trans) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    Null, empty and wholly non-textual pages have the empty text. Broken markup is read as far as it goes: an unclosed comment,
    script, style, noscript, textarea, iframe or title runs to the end of the page. The content of these, of svg, template and
    annotations of formulas is no text; buttons and selects are blocks that the model judges, objects and formulas belong to the text around them. Repeated rows give repeated results, null ids and urls are kept, an
    empty table gives an empty result, other columns are not read. A page must fit in a task's memory.
    """
    w, trans = train()
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        lambda it: extract_batches(it, w, trans), SCHEMA
    )

"""Captured pages: the charset of a header, links, and items by selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import urls
from tidemark.functions.selectors import PART, VOID, Program, Test, Walk, parsed
from tidemark.operators.keyed import first_wins
from tidemark.operators.tables import written

HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def charset_of(content_type: Column) -> Column:
    """The charset parameter of a content type, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(content_type, r"""(?i)charset\s*=\s*["']?([^"';\s]+)""", 1))


def links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """key, pos, href, url: the anchors of each page in order, absolute and without tracking parameters; url is null for other schemes."""
    found = df.select(key, F.col(base).alias("_b"), F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("pos", "href"))
    return found.select(key, F.col("pos").cast("long").alias("pos"), "href", urls.without_tracking(urls.resolve(urls.decode_entities(F.col("href")), F.col("_b"))).alias("url"))


BLANK = re.compile(r"(?i)&nbsp;|&#160;|&#xa0;|\u00a0")


def plain(text: str) -> str:
    return " ".join(text.split())


class Selected(Walk):
    """Items of one page: the outermost elements a selector names, with the first web link, a title and fields.

    ``fields`` are (name, selector, label): the text of the first element a selector names, or of the first dd whose nearest dt before it
    is the label. Without a title selector the title is the text of the link. Entities stay as written; non-breaking spaces of fields are white space.
    """

    def __init__(self, program: Program, fields: list[tuple[str, str | None, str | None]], titled: bool) -> None:
        super().__init__(program)
        self.fields, self.titled = fields, titled
        self.finals = program.finals  # item, link, dt, dd, title, then the fields' selectors
        self.items: list[dict] = []
        self.inside = 0
        self.gathering: list[tuple[int, list[str], str, object]] = []  # frames below, text, what for
        self.label: str | None = None

    def gather(self, kind: str, about: object = None) -> None:
        self.gathering.append((len(self.frames) - 1, [], kind, about))

    def opened(self, word, tag, attrs):
        item, link, dt, dd, title, *own = self.finals
        if not self.inside and word & item and tag not in VOID:
            self.inside = len(self.frames) - 1
            self.items.append({"href": None, "title": "", "fields": {}})
            self.label = None
        if not self.inside:
            return
        now = self.items[-1]
        if word & link and now["href"] is None and re.match(r"\s*(?:https?:|(?![A-Za-z][A-Za-z0-9+.-]*:))\s*\S", attrs.get("href", ""), re.I):
            now["href"] = attrs["href"].strip()
            if not self.titled and tag not in VOID:
                self.gather("title")
        if tag in VOID:
            return
        if self.titled and word & title and not any(g[2] == "title" for g in self.gathering):
            self.gather("title")
        if word & dt:
            self.label = None
            self.gather("dt")
        elif word & dd and self.label is not None:
            k = next((k for k, f in enumerate(self.fields) if f[2] == self.label and k not in now["fields"]), None)
            if k is not None:
                now["fields"][k] = ""
                self.gather("field", k)
        for k, final in zip([k for k, f in enumerate(self.fields) if f[1]], own, strict=True):
            if word & final and k not in now["fields"]:
                now["fields"][k] = ""
                self.gather("field", k)

    def closed(self, depth, tag, told):
        done = [g for g in self.gathering if g[0] >= depth]
        self.gathering = [g for g in self.gathering if g[0] < depth]
        for _, text, kind, about in done:
            if kind == "title":
                self.items[-1]["title"] += "".join(text)
            elif kind == "dt":
                self.label = plain(BLANK.sub(" ", "".join(text))) or None
            else:
                self.items[-1]["fields"][about] = plain(BLANK.sub(" ", "".join(text)))[:200]
        if depth == self.inside:
            self.inside = 0

    def handle_data(self, data):
        for _, text, _, _ in self.gathering:
            text.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


ITEM = "array<struct<href:string, title:string, fields:array<struct<name:string, value:string>>>>"


def below(outer: str, inner: str) -> str:
    """A selector list for what ``inner`` names inside what ``outer`` names."""
    return ", ".join(f"{o.strip()} {i.strip()}" for o in PART.findall(outer) for i in PART.findall(inner))


def selected_items(item: str, fields: tuple = (), link: str = "a", title: str | None = None):
    """A pandas UDF html -> items of the selector ``item``; ``fields`` are dt labels, (name, selector) or (name, None, label)."""
    wanted = [(f, None, f) if isinstance(f, str) else (*f, None)[:3] for f in fields]
    lists = [item, below(item, link), below(item, "dt"), below(item, "dd"), below(item, title or "title"), *[below(item, f[1]) for f in wanted if f[1]]]
    program = Program(lists)

    @F.pandas_udf(ITEM)
    def items(html: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[dict]:
            parser = Selected(program, wanted, title is not None).run(page or "")
            shown = lambda x: [{"name": f[0], "value": x["fields"][k]} for k, f in enumerate(wanted) if k in x["fields"]]
            return [{"href": x["href"], "title": plain(x["title"])[:256] or None, "fields": shown(x)} for x in parser.items if x["href"]]

        return html.map(one)

    return items


def items(df: DataFrame, key: str, html: str, base: str, item: str, fields: tuple = (), link: str = "a", title: str | None = None) -> DataFrame:
    """key, pos, url, title, fields: one row per item; of equal urls the first stays, items without a web link go."""
    found = df.select(key, F.col(base).alias("_b"), F.posexplode(selected_items(item, fields, link, title)(F.coalesce(html, F.lit("")))).alias("pos", "x"))
    rows = found.select(key, F.col("pos").cast("long").alias("pos"), urls.without_tracking(urls.resolve(urls.decode_entities(F.col("x.href")), F.col("_b"))).alias("url"), "x.title", "x.fields")
    return first_wins(rows.filter(F.col("url").isNotNull()), [key, "url"], ["pos"])


ELEMENT = {"pre": "int", "post": "int", "depth": "int", "parent": "int", "previous": "int", "path": "array<int>", "nth": "int", "nth_of_type": "int", "tag": "string", "attrs": "map<string,string>"}


class Numbered(Walk):
    """Every element as a row: its place, the last place inside it, its ancestors, its number among siblings."""

    def __init__(self, page: str) -> None:
        super().__init__(Program([]))
        self.rows: list[list] = []
        self.open: list[int] = []
        self.lasts: dict[int, int] = {}
        self.run(page)

    def opened(self, word, tag, attrs):
        pre, void = len(self.rows), tag in VOID
        up = self.frames[-1 if void else -2]
        parent = self.open[-1] if self.open else -1
        self.rows.append([pre, pre, len(self.open), parent, self.lasts.get(parent, -1), list(self.open), up.children, up.of_type[tag], tag, attrs])
        self.lasts[parent] = pre
        if not void:
            self.open.append(pre)

    def closed(self, depth, tag, told):
        self.rows[self.open.pop()][1] = len(self.rows) - 1


def elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """key and the elements of each page: pre and post bound the places of its descendants, path names its ancestors, previous its sibling before.

    Null pages have no elements. An element that is never closed ends with its parent.
    """

    @F.pandas_udf(f"array<struct<{','.join(f'{k}:{v}' for k, v in ELEMENT.items())}>>")
    def numbered(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [dict(zip(ELEMENT, r, strict=True)) for r in Numbered(p or "").rows])

    return df.select(key, F.explode(numbered(F.col(html))).alias("e")).select(key, "e.*")


def demand(t: Test) -> Column:
    """A test as a column over ``elements``."""
    if t.kind == "tag":
        return F.lit(True) if t.name == "*" else F.col("tag") == t.name
    if t.kind == "not":
        return ~reduce(lambda a, b: a & b, [demand(x) for x in t.inner])
    if t.kind == "attr":
        given, value = F.element_at("attrs", t.name), t.value
        if t.fold:
            given, value = F.lower(given), value.lower()
        word = F.array_contains(F.split(F.trim(F.regexp_replace(given, r"\s+", " ")), " "), value) if value else F.lit(False)
        said = {"": given.isNotNull(), "=": given == value, "~=": word, "|=": (given == value) | given.startswith(value + "-")}
        said |= {"^=": given.startswith(value), "$=": given.endswith(value), "*=": given.contains(value)}
        return F.coalesce(said[t.op] if value or t.op not in ("^=", "$=", "*=") else F.lit(False), F.lit(False))
    step, start = t.every
    away = F.col("nth_of_type" if t.kind == "of-type" else "nth") - start
    return away == 0 if step == 0 else (away % abs(step) == 0) & (away * step >= 0)


def select_elements(found: DataFrame, key: str, selector: str) -> DataFrame:
    """The rows of ``elements`` that a selector list names, as structural joins over the whole table.

    Each step is an equi-join with what the step before left: with the parent, with one of the ancestors on an element's path, with the
    sibling before, or with the first match among the siblings. No pair of elements of a page is formed beyond these. ``found`` is written
    first: every step reads it, and no page is parsed again for a step.
    """
    found = written(found)
    every = None
    for steps in parsed(selector):
        left = None
        for comb, tests in steps:
            here = found.filter(reduce(lambda a, b: a & b, [demand(t) for t in tests]))
            if comb == " ":
                above = here.select(key, "pre", F.explode("path").alias("_at")).join(left.select(key, F.col("pre").alias("_at")), [key, "_at"], "left_semi")
                here = here.join(above.select(key, "pre").distinct(), [key, "pre"], "left_semi")
            elif comb == "~":
                first = left.groupBy(key, "parent").agg(F.min("pre").alias("_at"))
                here = here.join(first, [key, "parent"]).filter("pre > _at").drop("_at")
            elif comb:
                here = here.join(left.select(key, F.col("pre").alias("parent" if comb == ">" else "previous")), [key, "parent" if comb == ">" else "previous"], "left_semi")
            left = here.select(*found.columns)
        every = left if every is None else every.unionByName(left)
    return first_wins(every, [key, "pre"], ["post"])

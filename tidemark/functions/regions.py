"""Regions of pages by selectors: what is ignored goes, what is included stays, the rest of the markup as it was written."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.selectors import VOID, Program, Walk

class Spans(Walk):
    """Start and end of the outermost elements that any selector names; an element that is never closed ends with its parent."""

    def __init__(self, page: str, program: Program) -> None:
        super().__init__(program)
        self.any = reduce(or_, program.finals)
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.page, self.spans = page, []
        self.since: tuple[int, int] | None = None  # frames below, and start, of the element at hand
        self.run(page)

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def opened(self, word, tag, attrs):
        if self.since or not word & self.any:
            return
        if tag in VOID:
            self.spans.append((self.at(), self.at() + len(self.get_starttag_text())))
        else:
            self.since = len(self.frames) - 1, self.at()

    def closed(self, depth, tag, told):
        if self.since and depth == self.since[0]:
            end = self.page.find(">", self.at()) + 1 or len(self.page) if told else self.at()
            self.spans.append((self.since[1], end))
            self.since = None

    def end(self, at, told):
        if at == 1 and not told:  # the page is over
            if self.since:
                self.spans.append((self.since[1], len(self.page)))
            self.since = None
        super().end(at, told)


def cut_regions(page: str, ignore: Sequence[str], include: Sequence[str]) -> str:
    """``page`` without ignored elements; with ``include``, only what stands inside included ones."""
    keep = Spans(page, Program(include)).spans if include else [(0, len(page))]
    drop = Spans(page, Program(ignore)).spans if ignore else []
    out = []
    for start, end in keep:
        for a, b in drop:
            if start < b and a < end:
                out.append(page[start : max(a, start)])
                start = max(start, min(b, end))
        out.append(page[start:end])
    return "".join(out)


def regions(html: Column, ignore: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """The regions of a page that count. Without selectors a page stays as it is and no Python runs; null stays null."""
    if not ignore and not include:
        return html

    @F.pandas_udf("string")
    def kept(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else cut_regions(page, ignore, include))

    return kept(html)

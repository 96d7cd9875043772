"""Selectors over markup: compiled once, matched in one pass with a stack of open elements.

Tag, *, #id, .class, [name] with =, ~=, |=, ^=, $=, *= (and i), :nth-child, :nth-of-type, :first-child, :first-of-type, :not of one
compound, the combinators white space, >, + and ~, and lists. An element carries a word of bits, one for each step of a selector that
ends at it; a step needs the bit before it at the parent, any ancestor, the sibling before or any earlier sibling, which parents and
elements hold as words too. Nothing is searched, so an element costs its steps, however deep or wide a page is. Names of tags and attributes
ignore case, values do not. An element that is never closed ends with its parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TOKEN = re.compile(r"""\s*([>+~])\s*|(\s+)|(\*|[\w\u0080-\U0010ffff-]+)|\#([\w\u0080-\U0010ffff-]+)|\.([\w\u0080-\U0010ffff-]+)|\[\s*([^\]\s~|^$*=]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*([iI])?\s*)?\]|:([a-z-]+)(?:\(([^()]*(?:\([^()]*\))?[^()]*)\))?""")
PART = re.compile(r"""(?:[^,"'\[(]|"[^"]*"|'[^']*'|\[(?:[^\]"']|"[^"]*"|'[^']*')*\]|\((?:[^()]|\([^()]*\))*\))+""")


@dataclass(frozen=True)
class Test:
    """One demand on an element: kind, name, operator and value."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    fold: bool = False
    every: tuple[int, int] = (0, 0)
    inner: tuple = ()

    def holds(self, tag: str, attrs: dict[str, str], nth: int, nth_of_type: int) -> bool:
        if self.kind == "tag":
            return self.name in ("*", tag)
        if self.kind == "attr":
            return self.name in attrs and compares(self.op, attrs[self.name], self.value, self.fold)
        if self.kind == "not":
            return not all(t.holds(tag, attrs, nth, nth_of_type) for t in self.inner)
        step, start = self.every
        away = (nth_of_type if self.kind == "of-type" else nth) - start
        return away == 0 if step == 0 else away % step == 0 and away // step >= 0


def compares(op: str, given: str, value: str, fold: bool) -> bool:
    if fold:
        given, value = given.lower(), value.lower()
    if op in ("^=", "$=", "*="):
        return value != "" and {"^=": given.startswith(value), "$=": given.endswith(value), "*=": value in given}[op]
    return {"": True, "=": given == value, "~=": value in given.split(), "|=": given == value or given.startswith(value + "-")}[op]


def counted(text: str) -> tuple[int, int]:
    """an+b, a number, odd or even as (a, b)."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), re.sub(r"\s+", "", text.lower()))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise ValueError(f"not a count: {text}")
    step = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return step, int(m[2] or 0)


def parsed(selector: str) -> list[list[tuple[str, tuple[Test, ...]]]]:
    """The selectors of a list, each as steps (combinator before it, tests)."""
    out = []
    parts = PART.findall(selector)
    if not parts or ",".join(parts) != selector:
        raise ValueError(f"not a selector: {selector}")
    for part in parts:
        steps, tests, comb, at = [], [], "", 0
        part = part.strip()
        while at < len(part):
            m = TOKEN.match(part, at)
            if not m:
                raise ValueError(f"not a selector: {part}")
            at = m.end()
            if m[1] or m[2]:
                if not tests:
                    raise ValueError(f"a step is missing: {part}")
                steps.append((comb, tuple(tests)))
                tests, comb = [], m[1] or " "
            elif m[3]:
                if tests:
                    raise ValueError(f"a tag stands first: {part}")
                tests.append(Test("tag", m[3].lower()))
            elif m[4] or m[5]:
                tests.append(Test("attr", "id", "=", m[4]) if m[4] else Test("attr", "class", "~=", m[5]))
            elif m[6]:
                tests.append(Test("attr", m[6].lower(), m[7] or "", next((v for v in m.group(8, 9, 10) if v is not None), ""), bool(m[11])))
            elif m[12] in ("first-child", "first-of-type") and m[13] is None:
                tests.append(Test("of-type" if "type" in m[12] else "child", every=(0, 1)))
            elif m[12] in ("nth-child", "nth-of-type") and m[13]:
                tests.append(Test("of-type" if "type" in m[12] else "child", every=counted(m[13])))
            elif m[12] == "not" and m[13] and len(inner := parsed(m[13])) == 1 and len(inner[0]) == 1:
                tests.append(Test("not", inner=inner[0][0][1]))
            else:
                raise ValueError(f"not supported: {m[0]}")
        if not tests:
            raise ValueError(f"a step is missing: {selector}")
        out.append([*steps, (comb, tuple(tests))])
    return out


class Program:
    """Selector lists compiled together: list i matches an element whose word has a bit of ``finals[i]``."""

    def __init__(self, lists: Sequence[str]) -> None:
        self.steps: list[tuple[str, tuple[Test, ...]]] = []
        self.finals = []
        for selector in lists:
            final = 0
            for steps in parsed(selector):
                self.steps += steps
                final |= 1 << (len(self.steps) - 1)
            self.finals.append(final)


@dataclass
class Frame:
    """An open element: its word, its ancestors' words together, and what its children have told so far."""

    tag: str
    word: int = 0
    above: int = 0
    children: int = 0
    of_type: dict[str, int] = field(default_factory=dict)
    last: int = 0
    before: int = 0


class Walk(HTMLParser):
    """One pass over a page; ``opened`` and ``closed`` are told what happens, in document order.

    opened(word, tag, attrs, frames) for every element, frames holding it unless it is void; closed(depth, tag, told) for those
    that end, the innermost first: depth is the number of frames that stay, ``told`` whether its own end tag ended it.
    """

    def __init__(self, program: Program) -> None:
        super().__init__(convert_charrefs=False)
        self.program = program
        self.frames = [Frame("")]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found: dict[str, str] = {}
        for name, value in attrs:
            found.setdefault(name, value or "")  # of repeated names the first counts
        up = self.frames[-1]
        up.children += 1
        up.of_type[tag] = of_type = up.of_type.get(tag, 0) + 1
        above = up.word | up.above
        word = 0
        for k, (comb, tests) in enumerate(self.program.steps):
            held = {"": -1, " ": above, ">": up.word, "+": up.last, "~": up.before}[comb]
            if (comb == "" or held >> (k - 1) & 1) and all(t.holds(tag, found, up.children, of_type) for t in tests):
                word |= 1 << k
        up.last, up.before = word, up.before | word
        if tag not in VOID:
            self.frames.append(Frame(tag, word, above))
        self.opened(word, tag, found)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.frames) - 1, 0, -1) if self.frames[i].tag == tag), 0)
        if at:
            self.end(at, True)

    def end(self, at: int, told: bool) -> None:
        while len(self.frames) > at:
            gone = self.frames.pop()
            self.closed(len(self.frames), gone.tag, told and len(self.frames) == at)

    def run(self, page: str) -> Walk:
        self.feed(page)
        self.close()
        self.end(1, False)
        return self

    opened: Callable = staticmethod(lambda word, tag, attrs: None)
    closed: Callable = staticmethod(lambda depth, tag, told: None)

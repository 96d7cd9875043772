"""Line differences: counts by multiset in the JVM, shortest edits and their hunks by an Arrow batch function.

A line is a token with its line break, so a last line without one differs from the same line with one; ``unified`` also takes
lines as what stands between breaks. The shortest edit is
the longest common subsequence read backwards. Lines at both ends that are equal, and lines that only one text has, are settled
first without loss; what remains is split again and again at the point where the two halves' common subsequences add up to
most (linear space), their lengths told by rows of bits, one machine word for 64 lines. No length switches to another rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATCH = "added_count long, removed_count long, patch string"
PIECE = 1 << 20  # characters of patches a worker gathers before it hands them on
LINE = r"[^\n]*\n|[^\n]+"


def lines_of(c: Column) -> Column:
    """The lines of a text, each with its break; none for an empty or null text."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LINE), F.lit(0))


def line_counts(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, added, removed: lines more often in ``new``, or in ``old``, counted as often as they are in surplus; moved lines count nothing."""
    lines = df.select(key, F.explode(F.split(F.coalesce(new, F.lit("")), "\n")).alias("line"), F.lit(1).alias("n")).unionByName(
        df.select(key, F.explode(F.split(F.coalesce(old, F.lit("")), "\n")).alias("line"), F.lit(-1).alias("n"))
    )
    net = lines.groupBy(key, "line").agg(F.sum("n").alias("n"))
    return net.groupBy(key).agg(F.sum(F.greatest("n", F.lit(0))).cast("long").alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("long").alias("removed"))


def common_lengths(a: Sequence, b: Sequence) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every prefix of ``b``, from one row of bits."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def matched(a: Sequence, b: Sequence, at: int = 0, bt: int = 0) -> Iterator[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order, in linear space."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            yield at + lo, bt + low
            lo, low = lo + 1, low + 1
        if lo >= hi or low >= high:
            continue
        if hi - lo == 1:
            found = next((j for j in range(low, high) if b[j] == a[lo]), None)
            if found is not None:
                yield at + lo, bt + found
            continue
        mid = (lo + hi) // 2
        ahead = common_lengths(a[lo:mid], b[low:high])
        behind = common_lengths(a[mid:hi][::-1], b[low:high][::-1])[::-1]
        cut = low + int((ahead + behind).argmax())
        todo += [(mid, hi, cut, high), (lo, mid, low, cut)]


def shortest_edit(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Pairs of places that stay in a shortest edit of ``old`` into ``new``."""
    start, end = 0, 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    while end < min(len(old), len(new)) - start and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = range(start, len(old) - end), range(start, len(new) - end)
    both = {old[i] for i in a} & {new[j] for j in b}  # lines of one text alone are in no common subsequence
    a, b = [i for i in a if old[i] in both], [j for j in b if new[j] in both]
    middle = [(a[i], b[j]) for i, j in matched([old[i] for i in a], [new[j] for j in b])]
    return [(i, i) for i in range(start)] + middle + [(len(old) - k, len(new) - k) for k in range(end, 0, -1)]


def hunks(old: Sequence[str], new: Sequence[str], kept: list[tuple[int, int]], context: int = 3) -> Iterator[str]:
    """Hunks of a unified patch, changes with ``context`` lines about them; without a break at the end where the last line has none."""
    blocks, i, j = [], 0, 0  # changed stretches (old from, to, new from, to)
    for x, y in [*kept, (len(old), len(new))]:
        if (x, y) != (i, j):
            blocks.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list] = []
    for block in blocks:
        if groups and block[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(block)
        else:
            groups.append([block])
    shown = lambda mark, line: mark + line if line.endswith("\n") else f"{mark}{line}\n\\ No newline at end of file\n"
    for group in groups:
        before, after = min(context, group[0][0]), min(context, len(old) - group[-1][1])
        a, z = group[0][0] - before, group[-1][1] + after
        c, y = group[0][2] - before, group[-1][3] + after
        out, at = [f"@@ -{a + (z > a)},{z - a} +{c + (y > c)},{y - c} @@\n"], a
        for lo, hi, low, high in group:
            out += [shown(" ", x) for x in old[at:lo]] + [shown("-", x) for x in old[lo:hi]] + [shown("+", x) for x in new[low:high]]
            at = hi
        yield "".join(out + [shown(" ", x) for x in old[at:z]])


def edit(old: str | None, new: str | None, context: int = 3, breaks: bool = False) -> tuple[int, int, str]:
    """(added, removed, patch) of one pair: the fewest added and removed lines; an empty patch where nothing changed.

    With ``breaks`` a line's break is part of it, else lines are what stands between breaks (an empty text is one empty line). Null texts are empty.
    """
    a, b = ((re.findall(LINE, t) if breaks else [x + "\n" for x in t.split("\n")]) for t in (old or "", new or ""))
    kept = shortest_edit(a, b)
    body = "".join(hunks(a, b, kept, context))
    return len(b) - len(kept), len(a) - len(kept), "--- before\n+++ after\n" + body if body else ""


def unified(context: int = 3, breaks: bool = False):
    """``edit`` as a pandas UDF (old, new) -> struct<added_count, removed_count, patch>, which holds a batch's texts and patches; large tables take ``edited``."""

    @F.pandas_udf(PATCH)
    def patch(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edit(a, b, context, breaks) for a, b in zip(old, new, strict=True)], columns=["added_count", "removed_count", "patch"])

    return patch


def edited(df: DataFrame, old: str, new: str, context: int = 3, breaks: bool = False) -> DataFrame:
    """``df`` with added_count, removed_count and patch in place of both texts, by ``edit``.

    One pair at a time is decoded, and patches leave whenever PIECE characters are gathered, so a worker holds the batch that Spark
    sent, one pair and one piece, however many rows there are.
    """
    rest = [c for c in df.columns if c not in (old, new)]
    rows = df.select(*rest, old, new)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, start, size = [], 0, 0
            for k, (a, b) in enumerate(zip(batch.column(len(rest)), batch.column(len(rest) + 1), strict=True), 1):
                told.append(edit(a.as_py(), b.as_py(), context, breaks))
                size += len(told[-1][2])
                if size > PIECE or k == batch.num_rows:
                    counts = [pa.array(x, t) for x, t in zip(zip(*told, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, k - start) for c in range(len(rest))), *counts], names=[*rest, "added_count", "removed_count", "patch"])
                    told, start, size = [], k, 0

    return rows.mapInArrow(edits, T.StructType([*rows.schema.fields[: len(rest)], *T.StructType.fromDDL(PATCH).fields]))


def text_changes(df: DataFrame, key: str, old: str, new: str, context: int = 3) -> DataFrame:
    """key, added_count, removed_count, patch of rows (key, old, new); equal texts, told in the JVM, never travel to Python."""
    same = F.col(old).eqNullSafe(F.col(new))
    equal = df.filter(same).select(key, F.lit(0).cast("long").alias("added_count"), F.lit(0).cast("long").alias("removed_count"), F.lit("").alias("patch"))
    return edited(df.filter(~same).select(key, old, new), old, new, context, breaks=True).unionByName(equal)

"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the 64-bit hashes of its distinct word shingles. The universe of hashes is split into
segments, their number fixed per size band. Two sets that reach the threshold differ in at most H elements, so
with segment budgets v (0: must be equal, 1: may differ by one element) that sum, as v + 1, to H + 1 + t, segments worth
at least t + 1 units agree within their budget. A set is indexed under its segment subsets and, for segments of budget 1, under
their one-deletion neighbourhoods too. How many segments get which budget is chosen per band from the corpus' own counts by cost.

The spare units t keep common index entries harmless without losing a pair: an entry
held by many sets is followed only for sets with more units of such entries than they need, as
any other pair also meets in a rare one; and a pair met in rare entries only is dropped
unless its units exceed the need of both. A set needs t units less those of its empty segments, which a set
with at most t of them leaves out of the index: a pair cannot meet there, even if the other set shows its own. What remains is grouped into clusters; inside a
small cluster sets are compared exactly as a product of 0/1 matrices. A large cluster is taken apart first: its rare pairs
are verified one by one, and only what common entries alone hold together is compared block by block.

Common entries never gather in one task: a task that holds more than RARE sets of an entry hands them on as holders of a
common one at once, spread by class, and sends the entry's own task no more than a mark.

Equal sets are one class from the start: all entries carry the class, never the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import cut, lean, text_or_empty, unwrapped, wrapped
from tidemark.llm.components import components

U64, U32 = np.uint64, np.uint64(32)
RARE = 8  # an entry held by at most so many classes is followed pair by pair
BLOCK = 256  # sets compared at once with as many others
SHARED, LEAST_SHARED = 256, 997  # classes, on average at most, of the small clusters that share a task; such tasks at least
GROUP_ENTRIES = 1 << 17  # index entries a task looks at
FLUSH = 1 << 19  # index entries a task gathers before it deals them out
MATRIX_COLS = 1 << 14
ENTRY_SCHEMA = "channel int, part int, sigs binary, classes binary, notes binary"
MARK = 255  # the note of an entry that a task has found to be common
STAR_PARTS = 64  # stars over the holders of one common entry
MET_SCHEMA = "kind int, channel int, sig long, a long, b long, units int, need_a int, need_b int"
PAIR, COMMON = 0, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct n-word shingles, sorted, and the set sizes; shorter rows are one shingle."""
    rows = len(offsets) - 1
    start, end, row = tokens.words(data, offsets)
    wh = tokens.span_hashes(data, start, end)
    count = np.bincount(row, minlength=rows)
    odd = [U64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for k in range(n)]
    at = np.arange(max(0, len(wh) - n + 1))
    at = at[row[at] == row[at + n - 1]]
    h = np.zeros(len(at), U64)
    for k in range(n):
        h += wh[at + k] * odd[k]
    r = row[at]
    if (few := np.flatnonzero((count > 0) & (count < n))).size:
        first = np.searchsorted(row, few)
        short = np.zeros(len(few), U64)
        for k in range(n - 1):
            has = count[few] > k
            short[has] += wh[first[has] + k] * odd[k]
        h, r = np.r_[h, short + count[few].astype(U64)], np.r_[r, few]
    h = tokens.mix(h)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return r, h, np.bincount(r, minlength=rows)


def class_ids(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One id per set, equal for equal sets (order-free sum of mixed hashes); 0 for the empty set."""
    total = np.zeros(len(size), U64)
    np.add.at(total, row, tokens.mix(h ^ U64(0xA0761D6478BD642F)))
    return np.where(size > 0, tokens.mix(total + size.astype(U64) * U64(0xE7037ED1A0B428DB)), U64(0)).view(np.int64)


def describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, tkey, text -> doc_id, tkey, n_shingles, class."""
    for batch in batches:
        size, cls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in tokens.chunks(batch.column(2)):
            r, h, k = shingle_sets(data, offsets, n)
            size.append(k)
            cls.append(class_ids(r, h, k))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.concatenate(size)), pa.array(np.concatenate(cls))], names=["doc_id", "tkey", "n_shingles", "class"]
        )


@dataclass(frozen=True)
class Plan:
    """Size bands and each channel's segments; a band's sets are indexed in its channel and the one below."""

    upper: np.ndarray  # largest set size of each band
    equal: np.ndarray  # segments of budget 0, they come first
    near: np.ndarray  # segments of budget 1
    spare: np.ndarray  # t
    parts: np.ndarray  # tasks a channel is dealt to

    @property
    def segments(self) -> np.ndarray:
        return self.equal + self.near


def band_limits(largest: int, num: int, den: int) -> list[int]:
    """Upper sizes: a set's partners at the threshold num/den lie in its own band or the next."""
    least = next(s for s in range(1, 10**6) if s * den // num > s)  # smaller sets have no other partner than equal ones
    upper = [least]
    while upper[-1] < largest:
        upper.append(max(upper[-1] + 1, upper[-1] * den // num))
    return upper


def allocate(counts: dict[int, int], largest: int, num: int, den: int, group_entries: int) -> Plan:
    """Choose budgets per channel by cost: index entries, plus meetings in empty segments where they exceed t.

    ``counts``: classes per band. A segment of budget 0 costs one entry, one of budget 1 its size and one more. Sets
    with more than t units of empty segments meet all others of that kind; a Poisson tail estimates them.
    """
    upper = band_limits(largest, num, den)
    equal, near, spare, parts = [], [], [], []
    for c, u in enumerate(upper):
        below = upper[c - 1] if c else 0
        h = (u + u * den // num) * (den - num) // (den + num)
        t = min(h, 2 + h // 6)
        sets = counts.get(c, 0) + counts.get(c + 1, 0)
        mean = max(1.0, (below + u) / 2)
        best = (math.inf, h + 1 + t, 0, 0.0)
        for near_n in sorted({round((h + 1 + t) / 2 * k / 8) for k in range(9)}):
            equal_n = h + 1 + t - 2 * near_n
            if equal_n < 0 or equal_n + near_n < 1:
                continue
            lam = mean / (equal_n + near_n)
            entries = equal_n + near_n * (lam + 1)
            weak = equal_n * math.exp(-lam) + 2 * near_n * math.exp(-lam) * (1 + lam)
            tail = max(0.0, 1 - sum(math.exp(-weak) * weak**k / math.factorial(k) for k in range(min(t, 80) + 1)))
            best = min(best, (entries + 0.05 * sets * tail * weak, equal_n, near_n, entries))
        equal.append(best[1])
        near.append(best[2])
        spare.append(t)
        parts.append(int(min(1 << 20, max(1, math.ceil(sets * (best[3] or best[1]) / group_entries)))))
    return Plan(np.array(upper), np.array(equal), np.array(near), np.array(spare), np.array(parts))


def entries_of(row: np.ndarray, h: np.ndarray, channel: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, note) of the sets of rows whose ``channel`` is not negative; note = need * 2 + units - 1."""
    own = channel[row] >= 0
    row, h = row[own], h[own]
    ch = np.maximum(channel, 0)
    seg_n = np.where(channel >= 0, plan.segments[ch], 0)
    base = np.cumsum(seg_n) - seg_n
    total = int(seg_n.sum())
    owner = np.repeat(np.arange(len(channel)), seg_n)
    seg = np.arange(total) - base[owner]
    is_near = seg >= plan.equal[ch[owner]]
    g = tokens.mix(h + (ch[row].astype(U64) + U64(1)) * U64(0x8EBC6AF09C88C6E3))
    gid = base[row] + (((g >> U32) * seg_n[row].astype(U64)) >> U32).astype(np.int64)
    value = tokens.mix(h ^ U64(0x589965CC75374CC3))
    sums = np.zeros(total, U64)
    np.add.at(sums, gid, value)
    size = np.bincount(gid, minlength=total)
    salt = tokens.mix((ch[owner].astype(U64) << U64(40)) + seg.astype(U64) + U64(1))
    unit = np.where(is_near, 2, 1)
    weak = size <= is_near  # its empty subset is among its entries
    weak_units = np.bincount(owner, weak * unit, minlength=len(channel)).astype(np.int64)
    spare = plan.spare[ch]
    shows_empty = weak_units > spare
    need = np.clip(spare - weak_units, 0, MARK // 2 - 1)  # 0 where empty segments show: a partner may hide as many as t units of them
    full = np.flatnonzero(size > 0)
    void = np.flatnonzero(weak & shows_empty[owner])
    cutable = is_near[gid] & (size[gid] > 1)
    ids = np.r_[full, void, gid[cutable]]
    raw = np.r_[sums[full], np.zeros(len(void), U64), sums[gid[cutable]] - value[cutable]]
    return owner[ids], tokens.mix(raw + salt[ids]), (need[owner[ids]] * 2 + unit[ids] - 1).astype(np.uint8)


def index(batches: Iterator[pa.RecordBatch], n: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Texts -> index entries, dealt out by channel and signature as packed arrays; holders of common ones in parts below zero."""
    held: list[tuple[np.ndarray, ...]] = []
    gathered = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ch, sig, cls, note = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (((sig >> U32) * plan.parts[ch].astype(U64)) >> U32).astype(np.int64)
        key = (ch.astype(np.int64) << 52) + (part << 32) + (sig & U64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((cls, key))
        key, cls, ch, part, note = key[order], cls[order], ch[order].astype(np.int64), part[order], note[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls, ch, part, note = key[new], cls[new], ch[new], part[new], note[new]
        first = np.r_[True, key[1:] != key[:-1]]
        count = np.diff(np.r_[np.flatnonzero(first), len(key)])
        common = np.repeat(count > RARE, count)
        mark = first & common
        stays = ~common | mark
        yield from packed(ch[stays], part[stays], (key[stays] & 0xFFFFFFFF).astype("<u4"), cls[stays], np.where(mark, MARK, note)[stays].astype(np.uint8))
        if common.any():  # holders of common entries, by class
            deal = -1 - ((tokens.mix(cls[common].view(U64)) >> U32) * plan.parts[ch[common]].astype(U64) >> U32).astype(np.int64)
            order = np.lexsort((deal, ch[common]))
            yield from packed(*(x[order] for x in (ch[common], deal, key[common].astype("<i8"), cls[common], note[common])))

    def packed(ch: np.ndarray, part: np.ndarray, sig: np.ndarray, cls: np.ndarray, note: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, (ch[1:] != ch[:-1]) | (part[1:] != part[:-1]), True]) if len(ch) else np.zeros(1, np.int64)
        for k in range(0, len(edge) - 1, 64):
            spans = list(zip(edge[k : k + 64], edge[k + 1 : k + 65], strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ch[edge[k : k + len(spans)]].astype(np.int32)),
                    pa.array(part[edge[k : k + len(spans)]].astype(np.int32)),
                    *[pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (sig, cls, note)],
                ],
                names=["channel", "part", "sigs", "classes", "notes"],
            )

    for batch in batches:
        for _, _, data, offsets in tokens.chunks(batch.column(0)):
            r, h, size = shingle_sets(data, offsets, n)
            cls = class_ids(r, h, size)
            band = np.searchsorted(plan.upper, size)
            linkable = size * 5 >= int(plan.upper[0]) * 4
            for lower in (0, 1):
                ch = np.where(linkable & (band < len(plan.upper)), band - lower, -1)
                row, sig, note = entries_of(r, h, ch, plan)
                held.append((ch[row], sig, cls[row], note))
                gathered += len(row)
            if gathered >= FLUSH:
                yield from flush()
                held, gathered = [], 0
    if gathered:
        yield from flush()


def meet(key: tuple, table: pa.Table) -> pa.Table:
    """One task's entries -> pairs of classes from rare entries, and the holders of common ones."""
    channel, part = (int(k.as_py()) for k in key)
    sig, cls, note = (
        np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(name)])
        for name, t in (("sigs", "<i8" if part < 0 else "<u4"), ("classes", np.int64), ("notes", np.uint8))
    )
    order = np.lexsort((note, cls, sig))  # a mark comes after its class's own entry
    sig, cls, note = sig[order], cls[order], note[order]
    start = np.r_[True, sig[1:] != sig[:-1]]
    entry = np.cumsum(start) - 1
    common = np.zeros(int(entry[-1]) + 1, bool)
    common[entry[note == MARK]] = True
    new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])] & (note != MARK)
    count = np.bincount(entry[new], minlength=len(common))
    common |= (count > RARE) | (part < 0)
    sig, cls, note, entry = sig[new], cls[new], note[new], entry[new]
    begin = np.cumsum(count) - count
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, RARE + 1):
        s = begin[(count == k) & ~common]
        for i in range(k - 1):
            for j in range(i + 1, k):
                left.append(s + i)
                right.append(s + j)
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((cls[b], cls[a]))
    a, b = a[order], b[order]
    edge = np.flatnonzero(np.r_[True, (cls[a][1:] != cls[a][:-1]) | (cls[b][1:] != cls[b][:-1])]) if len(a) else np.zeros(0, np.int64)
    units = np.add.reduceat((note[a] & 1) + 1, edge, dtype=np.int64) if len(a) else np.zeros(0, np.int64)
    a, b = a[edge], b[edge]
    held = np.flatnonzero(common[entry])
    where = sig[held].astype(np.int64) if part < 0 else (channel << 52) + (part << 32) + sig[held].astype(np.int64)
    cols = {
        "kind": np.r_[np.full(len(a), PAIR), np.full(len(held), COMMON)].astype(np.int32),
        "channel": np.full(len(a) + len(held), channel, np.int32),
        "sig": np.r_[np.zeros(len(a), np.int64), where],
        "a": np.r_[cls[a], cls[held]],
        "b": np.r_[cls[b], cls[held]],
        "units": np.r_[units, (note[held] & 1) + 1].astype(np.int32),
        "need_a": np.r_[note[a] >> 1, note[held] >> 1].astype(np.int32),
        "need_b": np.r_[note[b] >> 1, note[held] >> 1].astype(np.int32),
    }
    return pa.table({k: pa.array(v) for k, v in cols.items()})


def candidate_edges(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs met in rare entries whose units can exceed the spare, and stars over the common entries that must be followed.

    A star is made of ``STAR_PARTS`` smaller ones whose centres are joined, so that a very common entry is no single key.
    """
    held = met.filter(F.col("kind") == COMMON).select("channel", "sig", "a", "units", "need_a").distinct()  # tasks may have passed on the same
    common = cut(held.groupBy("channel", "a").agg(F.sum("units").alias("common"), F.min("need_a").alias("need")))
    followed = held.join(common.filter(F.col("common") > F.col("need")).select("channel", "a"), ["channel", "a"], "left_semi")
    followed = cut(followed.select("sig", "a", F.pmod(F.xxhash64("a"), F.lit(STAR_PARTS)).alias("salt")))
    centre = cut(followed.groupBy("sig", "salt").agg(F.min("a").alias("b")))
    top = centre.groupBy("sig").agg(F.min("b").alias("t"))
    stars = followed.join(centre, ["sig", "salt"]).select("a", "b").unionByName(centre.join(top, "sig").select(F.col("b").alias("a"), F.col("t").alias("b"))).filter("a <> b")
    rare = met.filter(F.col("kind") == PAIR).groupBy("channel", "a", "b").agg(F.sum("units").alias("units"), F.min("need_a").alias("need_a"), F.min("need_b").alias("need_b"))
    for side in ("a", "b"):
        extra = common.select("channel", F.col("a").alias(side), F.col("common").alias(f"common_{side}"))
        rare = rare.join(extra, ["channel", side], "left").filter(F.col("units") + F.coalesce(f"common_{side}", F.lit(0)) > F.col(f"need_{side}"))
    return cut(rare.select("a", "b").distinct()), cut(stars.distinct())


def emit_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Texts -> class and its set as packed 64-bit hashes."""
    for batch in batches:
        for _, _, data, offsets in tokens.chunks(batch.column(0)):
            r, h, size = shingle_sets(data, offsets, n)
            cls = class_ids(r, h, size)
            at = np.r_[0, np.cumsum(size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls), pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["class", "elements"]
            )


def linked_pairs(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """0/1 matrix of the pairs with Jaccard at least num/den, by exact intersection sizes."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # an element of one set alone intersects nothing
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(shared.sum()), MATRIX_COLS):
        lo, hi = np.searchsorted(column, (a, a + MATRIX_COLS))
        m = np.zeros((len(sets), MATRIX_COLS), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        common += m @ m.T
    both = np.rint(common).astype(np.int64)
    out = den * both >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def forest(link: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked set with the smallest member of its component here."""
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(ids)).min(1, initial=len(ids)))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def compare(table: pa.Table, num: int, den: int) -> pa.Table:
    """The clusters or block pair of one task -> links, enough of them to connect what is connected."""
    cluster, cls = table.column("cluster").to_numpy(), table.column("class").to_numpy()
    elements = table.column("elements")
    order = np.lexsort((cls, cluster))
    edge = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0, True])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(edge, edge[1:], strict=False):
        at = order[s:e]
        sets = [np.frombuffer(elements[int(i)].as_py(), U64) for i in at]
        a, b = forest(linked_pairs(sets, num, den), cls[at])
        left.append(a)
        right.append(b)
    return pa.table({"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))})


def linked_edges(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """a, b and their sets -> the pairs that are linked."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(den * both >= num * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])


def tasks(clusters: DataFrame, sizes: DataFrame, upper: list[int], classes: int) -> DataFrame:
    """class, cluster, task: small clusters share tasks, large ones are cut into blocks that meet pair by pair.

    The number of shared tasks grows with ``classes``, the number of all classes. Blocks hold sets of one size band; a block meets those of its own and the next band.
    """
    band = F.aggregate(F.array(*[F.lit(u) for u in upper]), F.lit(0), lambda acc, u: acc + (u < F.col("n")).cast("int"))
    members = clusters.join(sizes, "class").withColumn("band", band)
    # counts are written before they are joined: the join of a hot cluster can then be split, or needs no exchange at all
    per_cluster = cut(members.groupBy("cluster").agg(F.count("*").alias("members")))
    per_band = cut(members.groupBy("cluster", "band").agg(F.count("*").alias("in_band")))
    blocks = F.ceil(F.col("in_band") / BLOCK).cast("int")
    own = per_band.withColumn("blocks", blocks).drop("in_band")
    for step, name in ((1, "above"), (-1, "below")):
        other = per_band.select("cluster", (F.col("band") - step).alias("band"), blocks.alias(name))
        own = own.join(other, ["cluster", "band"], "left")
    own = cut(own)
    placed = members.join(per_cluster, "cluster")
    small = placed.filter(F.col("members") <= BLOCK).select("class", "cluster", F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(max(LEAST_SHARED, classes // SHARED + 1)))).alias("task"))
    large = placed.filter(F.col("members") > BLOCK).join(own, ["cluster", "band"]).withColumn("k", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def name(low_band: Column, low: Column, high_band: Column, high: Column) -> Column:
        return F.concat_ws(":", F.col("cluster"), low_band, low, high_band, high)

    def each(count: Column, f) -> Column:
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1), f)).otherwise(F.array().cast("array<string>"))

    b, k = F.col("band"), F.col("k")
    met = F.concat(
        each(F.col("blocks"), lambda j: name(b, F.least(k, j), b, F.greatest(k, j))),
        each(F.col("above"), lambda j: name(b, k, b + 1, j)),
        each(F.col("below"), lambda j: name(b - 1, j, b, k)),
    )
    return small.unionByName(large.select("class", "cluster", F.explode(met).alias("task")))


def labelled_classes(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, tkey, n_shingles, class of every row (tkey: a hash of its text), and class, first_id, member, label (of its component) of every class.

    ``member`` is the class's row of smallest id, then text hash; null ids come last.
    """
    t = text_or_empty(F.col(text_col))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("tkey"), t.alias("text"))
    described = cut(docs.mapInArrow(lambda it: lean(describe(it, words)), "doc_id long, tkey long, n_shingles long, class long"))
    classes = cut(
        described.filter("n_shingles > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("first_id"), F.min_by(F.struct("doc_id", "tkey"), F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("member"), F.max("n_shingles").alias("n"))
    )
    largest = classes.agg(F.max("n")).first()[0] or 1
    upper = band_limits(largest, num, den)
    band = F.aggregate(F.array(*[F.lit(u) for u in upper]), F.lit(0), lambda acc, u: acc + (u < F.col("n")).cast("int"))
    counts = {r.band: r["count"] for r in classes.groupBy(band.alias("band")).count().collect()}  # a row per band
    plan = allocate(counts, largest, num, den, GROUP_ENTRIES)
    met = cut(
        docs.select("text").mapInArrow(lambda it: lean(index(it, words, plan)), ENTRY_SCHEMA).groupBy("channel", "part").applyInArrow(meet, MET_SCHEMA)
    )
    rare, stars = candidate_edges(met)
    clusters = components(rare.unionByName(stars)).select(F.col("node").alias("class"), F.col("label").alias("cluster"))
    over = cut(clusters.groupBy("cluster").count().filter(F.col("count") > BLOCK).select("cluster"))
    large = cut(clusters.join(over, "cluster", "left_semi"))
    in_large = lambda edges: edges.join(large.select(F.col("class").alias("a")), "a", "left_semi")
    held_together = components(in_large(stars)).select(F.col("node").alias("class"), F.col("label").alias("cluster"))
    compared = clusters.join(large.select("class"), "class", "left_anti").unionByName(held_together)
    dealt = tasks(compared, classes.select("class", "n"), upper, sum(counts.values()))
    wanted = classes.join(clusters, "class").select(F.col("member.doc_id").alias("doc_id"), F.col("member.tkey").alias("tkey"))
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.tkey").eqNullSafe(F.col("w.tkey")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("text")
    sets = cut(texts.mapInArrow(lambda it: lean(emit_sets(it, words)), "class long, elements binary").dropDuplicates(["class"]))
    links = dealt.join(sets, "class").groupBy("task").applyInArrow(lambda x: compare(x, num, den), "a long, b long")
    apart = sets.join(large.select("class"), "class", "left_semi")  # both ends of a pair that is verified alone; the other sets stay where they are
    ends = [apart.select(F.col("class").alias(x), F.col("elements").alias(f"set_{x}")) for x in ("a", "b")]
    single = in_large(rare).join(ends[0], "a").join(ends[1], "b").select("a", "b", "set_a", "set_b").mapInArrow(lambda it: lean(linked_edges(it, num, den)), "a long, b long")
    links = links.unionByName(single)
    linked = components(links)
    labelled = classes.join(linked, F.col("class") == F.col("node"), "left").select("class", "first_id", "member", F.coalesce("label", "class").alias("label"))
    return described, labelled


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null, empty and blank texts have the empty set, are linked with nothing and are their own component. A text of fewer than
    ``words`` words is one shingle. Repeated rows fall into one class; null ids are never the
    smallest, a component of null ids alone has a null id. No rows give no rows; other columns are not read.
    """
    described, labelled = labelled_classes(df, id_col, text_col, words, num, den)
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "label").select("class", "component_id")
    return described.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``df`` with one row of each component: that of its smallest id, then smallest text hash; null ids come last.

    Rows without words all stay. Rows of one id, or without one, are kept or dropped by their own components.
    """
    _, labelled = labelled_classes(df, id_col, text_col, words, num, den)
    first = F.struct(F.col("member.doc_id").isNull(), "member.doc_id", "member.tkey")
    keep = labelled.groupBy("label").agg(F.min_by("member", first).alias("member")).select(F.col("member.doc_id").alias("_id"), F.col("member.tkey").alias("_tkey"))
    text = text_or_empty(F.col(text_col))
    rows = wrapped(df, id=F.col(id_col).cast("long"), k=F.xxhash64(text), worded=text.rlike(r"[^\x20\x09-\x0D]"))
    joined = rows.filter("worded").join(keep, F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_tkey")))
    return unwrapped(joined.select(*rows.columns).dropDuplicates(["id", "k"]).unionByName(rows.filter("not worded")), df)


ORACLE = r"""
WITH RECURSIVE
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
     m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

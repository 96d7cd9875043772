"""Packing documents into sequences: best fit, then a swap-based local search.

Tokenising is a map over record batches. Pieces (a few numbers each) are dealt at random to packing
groups of bounded size; each group is packed on its own, so every step is parallel and a group
costs at most one badly filled sequence. No task or driver sees more than a batch or a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
SEGMENTS, WORDS = 1 << 19, 1 << 20  # remembered by a task before it starts anew
KEPT_WORDS = 1 << 19  # remembered at most from one task of a worker to the next
TOGETHER = 1 << 20  # characters looked up together
_ENCODERS: dict[str, Encoder] = {}


def byte_alphabet() -> dict[int, int]:
    """Bytes to the characters that byte-level vocabularies write them as: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: b if b in plain else next(others) for b in range(256)}


class Remembered(dict):
    """Numbers keys in the order they are met, and has their ids in two flat arrays once they are learned."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = number = len(self)
        return number

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the fresh keys in a row, and how many each has."""
        self.ids = np.r_[self.ids, ids.astype(np.uint32)]
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)]
        self.fresh = []

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys at these numbers in a row, and where each key's end."""
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Ids of whole texts by the model of ``tokenizers``; every distinct word goes through it once and is remembered.

    The vocabulary's pattern cuts a text into words, and words are encoded each on its own. As the pattern starts a new
    word at the last space before a non-space, texts are first cut there into segments, which are remembered
    too. Texts in which other white space follows a space, or that hold the spelling of a special token, are encoded in one piece.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = ["\0", *(t.content for t in self.bpe.get_added_tokens_decoder().values())]
        self.split: Callable[[str], list[str]] = regex.compile(public_tokenizers.PATTERN).findall
        self.model, self.alphabet = self.bpe.model, byte_alphabet()
        self.segments, self.words = Remembered(), Remembered()
        self.spaced = np.zeros(0, bool)  # segments that are a space before white space

    def words_of(self, segment: str) -> list[str]:
        """A segment's words; letters alone, after a space or not, are one."""
        return [segment] if segment.isascii() and segment[1:].isalpha() and (segment[0] == " " or segment[0].isalpha()) else self.split(segment)

    def learn(self, segments: list[str]) -> None:
        if len(self.words) >= WORDS:
            self.words = Remembered()
        cut_up = [self.words_of(x) for x in segments]
        at = np.fromiter((self.words[w] for x in cut_up for w in x), np.int64)
        new = [self.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet)) for w in self.words.fresh]
        self.words.learn(np.fromiter((t.id for x in new for t in x), np.uint32), np.array([len(x) for x in new], np.int64))
        ids, ends = self.words.ids_of(at)
        self.spaced = np.r_[self.spaced, np.array([x == " " or (x[:1] == " " and x[1].isspace()) for x in segments], bool)]
        self.segments.learn(ids, np.diff(np.r_[0, ends][np.cumsum([0, *map(len, cut_up)])]))

    def rest(self) -> None:
        """Forget what would only burden the worker's next task."""
        self.segments, self.spaced = Remembered(), np.zeros(0, bool)
        if len(self.words) > KEPT_WORDS:
            self.words = Remembered()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= TOGETHER:
                size += len(texts[b])
                b += 1
            out += self.encode_some(texts[a:b])
            a = b
        return out

    def encode_some(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.segments) >= SEGMENTS:
            self.segments, self.spaced = Remembered(), np.zeros(0, bool)
        odd = {k for k, x in enumerate(texts) if any(t in x for t in self.special)}
        cut_up = [[] if k in odd else x.replace(" ", "\0 ").split("\0") for k, x in enumerate(texts)]
        at = np.fromiter(map(self.segments.__getitem__, chain.from_iterable(cut_up)), np.int64)
        if self.segments.fresh:
            self.learn(self.segments.fresh)
        owner = np.repeat(np.arange(len(texts)), list(map(len, cut_up)))
        odd.update(np.unique(owner[self.spaced[at]]).tolist())
        ids, ends = self.segments.ids_of(at)
        last = np.r_[0, ends][np.cumsum([0, *map(len, cut_up)])]
        found = [ids[s:e] for s, e in zip(last, last[1:], strict=False)]
        for k in odd:
            found[k] = np.array(self.bpe.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return found


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut_points(n: int, size: int) -> list[int]:
    """Piece borders of n tokens: all pieces have ``size`` tokens, the first may be shorter."""
    return [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]


def tokenise(batches: Iterator[pa.RecordBatch], vocabulary: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for batch in batches:
        out: list[tuple] = []
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
            ids = np.append(found, np.uint32(end_id)).astype("<u4")
            borders = cut_points(len(ids), size)
            for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )
    enc.rest()


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit decreasing: each item goes to the fullest bin that still takes it."""
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = mask >> n
        if room:
            free = n + (room & -room).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - n
        if left:
            by_free[left].append(b)
            mask |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empty the least filled bins by moves and swaps that raise the sum of squared fills.

    Bins are taken from the emptiest; as long as one applies, one of the bin's items moves to a bin with room, one item
    is swapped for a smaller one, two for one smaller in sum, or one for two smaller in sum of one bin. All items, pairs
    of items and partner bins are tried. The partner is never less filled and gains, so squared fill grows with every
    step. Ends at the lower bound of bins, or when a whole pass over all underfull bins applies nothing.
    """
    least = -(-int(lengths.sum()) // size)
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    open_bins = [b for b in range(len(bins)) if fill[b] < size]
    item = np.array([i for b in open_bins for i in bins[b]], dtype=np.int64)
    home = np.array([b for b in open_bins for _ in bins[b]], dtype=np.int64)
    where = {int(i): k for k, i in enumerate(item)}
    long = lengths[item].astype(np.int64) if len(item) else np.zeros(0, np.int64)
    alive = len(bins)
    pairs: dict[int, np.ndarray] = {}  # of each bin: sum and items of its pairs, one for each two lengths
    table: np.ndarray | None = None

    def shift(i: int, to: int) -> None:
        nonlocal table
        k = where[i]
        pairs.pop(int(home[k]), None)
        pairs.pop(to, None)
        table = None
        bins[home[k]].remove(i)
        fill[home[k]] -= lengths[i]
        bins[to].append(i)
        fill[to] += lengths[i]
        home[k] = to

    def by_length(b: int) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i in sorted(bins[b], key=lambda i: -int(lengths[i])):
            out.setdefault(int(lengths[i]), []).append(i)
        return out

    def pairs_of(b: int) -> np.ndarray:
        if b not in pairs:
            groups = list(by_length(b).values())
            two = [(g[0], g[1]) for g in groups if len(g) > 1] + [(g[0], h[0]) for k, g in enumerate(groups) for h in groups[k + 1 :]]
            pairs[b] = np.array([(b, lengths[i] + lengths[j], i, j) for i, j in two], np.int64).reshape(-1, 4)
        return pairs[b]

    def step(b: int) -> bool:
        nonlocal table
        own = [g[0] for g in by_length(b).values()]  # items of one length are alike
        room = size - fill[home]
        other = (home != b) & (fill[home] >= fill[b])
        for i in own:
            n = int(lengths[i])
            ok = other & (room >= n)
            if ok.any():
                shift(i, int(home[np.argmin(np.where(ok, room, size + 1))]))
                return True
        for out in [(i,) for i in own] + [(int(i), int(j)) for _, _, i, j in pairs_of(b)]:  # one or two for one
            gain = sum(int(lengths[i]) for i in out) - long
            ok = other & (gain > 0) & (gain <= room)
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, -1)))
                j, to = int(item[k]), int(home[k])
                shift(j, b)
                for i in out:
                    shift(i, to)
                return True
        if table is None:
            table = np.concatenate([pairs_of(x) for x in open_bins if bins[x]])
        rest = (table[:, 0] != b) & (fill[table[:, 0]] >= fill[b])
        for i in own:  # one for two
            gain = int(lengths[i]) - table[:, 1]
            ok = rest & (gain > 0) & (gain <= size - fill[table[:, 0]])
            if ok.any():
                to, _, j, k = table[int(np.argmax(np.where(ok, gain, -1)))].tolist()
                shift(j, b)
                shift(k, b)
                shift(i, to)
                return True
        return False

    moved = True
    while moved and alive > least:
        moved = False
        for b in sorted((b for b in open_bins if bins[b]), key=lambda b: (fill[b], b)):
            while bins[b] and step(b):
                moved = True
            alive -= not bins[b]
            if alive == least:
                break
    return [b for b in bins if b]


def pack_group(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "rid"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy(np.int64)
    bins = local_search(best_fit(lengths, size), lengths, size)
    seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    base = int(pdf["grp"].iloc[0]) << 32
    for s, b in enumerate(bins):
        at = 0
        for i in b:
            seq[i], off[i] = base + s, at
            at += int(lengths[i])
    return pdf.assign(sequence_id=seq, offset=off)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    size: int = 2048,
    end_id: int = 0,
    group_rows: int = 16384,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``df`` is a document: null and empty texts are the end id alone, repeated rows are
    packed once each, null ids stay null. Ids are those of ``tokenizers`` without added special tokens; the spelling of a
    special token inside a text is that token, as the vocabulary file has it. Texts are tokenised whole; one text must fit in a
    task's memory. Equal lengths are ordered by id, so a rerun packs alike. An empty table gives no
    rows; other columns are not read. Groups hold ``group_rows`` pieces on average, at random.
    """
    pieces = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: tokenise(it, vocabulary, size, end_id), PIECES
    )
    pieces = cut(pieces.withColumn("rid", F.monotonically_increasing_id()))
    groups = max(1, round(pieces.count() / group_rows))
    return (
        pieces.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(lambda pdf: pack_group(pdf, size), PACKED)
    )

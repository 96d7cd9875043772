"""Words of Arrow string columns as numpy arrays: spans, owners and 64-bit hashes, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_PRIME, -1, 1 << 64)
    out = []
    for p in (_PRIME, inverse):
        a = np.full(n, p, U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


@lru_cache(maxsize=2)
def _byte_values(fold_case: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold_case:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about ``most_bytes``; a longer row comes alone and whole."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside [\\x20\\x09-\\x0D]; runs end at row borders."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    text = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = text.copy()
    start[1:] &= ~text[:-1] | edge[1:-1]
    end = text.copy()
    end[:-1] &= ~text[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of every span's bytes (A-Z as a-z with ``fold_case``): prefix sums of a polynomial, shifted back."""
    if not len(start):
        return np.zeros(0, U64)
    size = 1 << max(20, int(len(data)).bit_length())
    power, inverse = _powers(size)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_byte_values(fold_case)[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))

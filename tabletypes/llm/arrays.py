"""Vectorised text helpers that run inside tasks on Arrow batches: bytes of a column, word and shingle hashes, span unions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C55)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, for n bytes at least."""
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] the polynomial value of data[i:j], shifted by BASE^i."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=s[1:])
    return s


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; a null counts as an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], all_bytes[at[0] : at[-1]]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` bytes each, or one longer row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words in order, and for each row the index of its first word (n + 1)."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)  # no word crosses from one row to the next
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    s = prefix_sums(data)
    h = mix((s[ends] - s[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; fewer words make one shingle, no word none."""
    if not len(words):
        return words
    size_here = min(size, len(words))
    n = len(words) - size_here + 1
    h = np.full(n, np.uint64(size_here))
    for i in range(size_here):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return h


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    for a, b in row_slices(offsets, 1 << 20):
        at = offsets[a : b + 1]
        words, first = word_hashes(at - at[0], data[at[0] : at[-1]])
        for i in range(b - a):
            yield np.unique(shingle_hashes(words[first[i] : first[i + 1]], size))


def union_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans of each key; spans that touch join."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(group * step + end) - group * step
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return key[first], start[first], np.maximum.reduceat(reach, first)

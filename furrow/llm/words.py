"""Vectorised words, word hashes and word n-grams of Arrow text columns.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes other than
space and 0x09-0x0D, so that words equal those of ``[^\\x20\\x09-\\x0D]+``.
Null texts have no words. Texts are never cut: a batch is worked off in slices
of whole rows, a row above the slice size in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = [9, 10, 11, 12, 13, 32]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

#: Class of each byte: 0 white space, 1 letters, digits and non-ASCII, else one class per symbol.
WORD_CLASS = np.ones(256, np.int16)
WORD_CLASS[_SPACE] = 0
TOKEN_CLASS = np.array([0 if b in _SPACE else 1 if b >= 128 or chr(b).isalnum() else b + 2 for b in range(256)], np.int16)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, p in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Words(NamedTuple):
    """Words of some rows; row r has the words first[r]:first[r + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, classes: np.ndarray = WORD_CLASS, strip: bool = False) -> Words:
    """Runs of one class, none of them across rows.

    lower folds A-Z in the hashes alone; strip takes ASCII punctuation off both
    ends of each run and leaves out runs of nothing else.
    """
    offsets = offsets - offsets[0]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    kind = classes[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets[(offsets > 0) & (offsets < n)]] = True
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    real = kind[start] != 0
    start, end = start[real], end[real]
    if strip and len(start):
        plain = ~_PUNCTUATION[data]
        here = np.arange(n)
        last = np.maximum.accumulate(np.where(plain, here, -1))[end - 1] + 1
        start = np.minimum.accumulate(np.where(plain, here, n)[::-1])[::-1][start]
        some = last > start
        start, end = start[some], last[some]
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    first = np.searchsorted(start, offsets)
    return Words(mix(value + (end - start).astype(np.uint64)), start, end, first, data)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole rows of up to about size bytes together."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1]
        at = to


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows in order, and first[r] as in Words (of windows)."""
    n = len(w.hash)
    per_row = np.maximum(w.counts - k + 1, 0)
    first = np.concatenate(([0], np.cumsum(per_row)))
    if n < k:
        return np.zeros(0, np.uint64), first
    value = w.hash[: n - k + 1].copy()
    for i in range(1, k):
        value = value * _P + w.hash[i : n - k + 1 + i]
    at = np.arange(first[-1]) - np.repeat(first[:-1], per_row) + np.repeat(w.first[:-1], per_row)
    return mix(value[at]), first


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row r is values[first[r]:first[r + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))

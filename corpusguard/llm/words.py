"""Vectorised word kernel shared by the corpus operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All separators
are ASCII, so the kernel works on the UTF-8 bytes of a whole Arrow column
without decoding them: word bounds, 64-bit word hashes and hashes of word
windows come out of a few numpy passes. Texts are taken whole; a column is cut
into slices of bounded size between rows, never inside one.

Nulls count as the empty text, which has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the byte polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text in one slice; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def _separators() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_SEPARATOR = _separators()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, made by doubling; what a slice needs is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), dtype=U64)
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        have = out
        if n <= SLICE_BYTES:
            _POWERS[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Words:
    """The words of some consecutive texts.

    ``data``: their bytes; ``start``/``end``: byte bounds of each word;
    ``first``: for each text the index of its first word, with the total last;
    ``text_start``/``text_end``: byte bounds of each text; ``row``: index of the
    first text in the column.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray
    text_end: np.ndarray
    row: int

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.n_texts), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        sums = np.empty(len(self.data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((self.data.astype(U64) + U64(1)) * _powers(_BASE, len(self.data)), out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, len(self.data))[self.start]
        return mix(raw + (self.end - self.start).astype(U64))

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` consecutive words of one text, and
        for each text the index of its first window, with the total last."""
        n = np.maximum(self.counts() - (size - 1), 0)
        first = np.concatenate([[0], np.cumsum(n)])
        if not first[-1]:
            return np.zeros(0, dtype=U64), first
        total = rolling(h, size)
        # The window that starts at word i is at total[i]; those across texts go.
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        return total[at], first


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours in ``h``."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    odd = 0xD6E8FEB86659FD93
    for j in range(size):
        total += h[j : j + n] * U64(odd)
        odd = (odd * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB * 2) & ((1 << 64) - 1) | 1
    return mix(total)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text bounds of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def slices(column: pa.Array, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, in slices of whole texts."""
    data, bounds = buffers(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + slice_bytes, side="right")) - 1)
        yield words(data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row], row, lower)
        row = stop


def words(data: np.ndarray, bounds: np.ndarray, row: int = 0, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SEPARATOR[data]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # A run that crosses from one text into the next is cut at the bound.
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        cuts = np.unique(cuts)
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            start, end = np.union1d(start, cuts), np.union1d(end, cuts)
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, first, bounds[:-1], bounds[1:], row)

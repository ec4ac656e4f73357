"""PartEnum signatures for sets of word shingles.

Two sets with Jaccard similarity of at least ``num/den`` differ in at most
``k = (den - num) * (|a| + |b|) / (den + num)`` elements. Sets are put in size
bands; within a band the 64-bit domain of shingle hashes is cut into ``n1``
parts and each part into ``n2`` pieces. A difference of at most ``k`` elements
leaves at least ``n1 - k // (k2 + 1)`` parts with at most ``k2`` differing
elements, and in each of those some ``n2 - k2`` of its ``n2`` pieces agree in
full. One signature is made for every part and every choice of ``n2 - k2``
pieces, so similar sets of a band share a signature: no pair is missed.

A choice of pieces that holds few elements says little and would put unrelated
sets into one bucket. ``n1`` has ``spare - 1`` parts more than the bound asks
for, so a similar pair agrees on at least ``spare`` parts. A set drops its
choices of fewer than ``least`` elements, where ``least`` is the largest number
that leaves it fewer than ``spare`` parts with a dropped choice. Of two similar
sets take the one with the larger ``least``: one of the agreed parts has none of
its choices dropped, the agreed choice is as large in the other set, and so both
keep it.

A band covers sizes ``low <= n <= high``. Partners just above ``high`` would be
in the next band, so sets up to ``high * den / num`` emit signatures for the
band too.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np

from corpusguard.llm.words import U64, Words, mix

#: Ratio of a band's largest to its smallest size; the least signatures per
#: element, counting the overlap, are made at about this ratio.
BAND_RATIO = 1.3


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    reach: int  # largest size that emits signatures for this band
    n1: int
    n2: int
    k2: int
    spare: int  # good parts that any similar pair has at least


def bands(largest: int, num: int = 4, den: int = 5, n2: int = 3, k2: int = 1, spare: float = 0.15) -> list[Band]:
    """Bands for all sizes from 1 to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        reach = high * den // num
        k = (den - num) * (high + reach) // (den + num)
        need = k // (k2 + 1) + 1
        n1 = need + max(1, round(spare * need)) if k else 1
        out.append(Band(low, high, reach, n1, n2 if k else 1, k2 if k else 0, n1 - need + 1))
        low = high + 1
    return out


def shingle_sets(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within a text, and the index of
    each text's first one. A text with fewer words than ``size`` has its whole
    sequence as the one shingle; a text without words has none."""
    h = w.hashes()
    n, (full, first) = w.counts(), w.windows(h, size)
    short = np.flatnonzero((n > 0) & (n < size))
    owner = np.repeat(np.arange(w.n_texts), np.diff(first))
    if len(short):
        made = np.zeros(len(short), dtype=U64)
        for j in range(size - 1):
            at = np.flatnonzero(n[short] > j)
            made[at] = mix(made[at] * U64(0x9E3779B97F4A7C15) + h[w.first[short[at]] + j])
        made = mix(made ^ n[short].astype(U64))
        full, owner = np.concatenate([full, made]), np.concatenate([owner, short])
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    new = np.ones(len(full), dtype=bool)
    new[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    full, owner = full[new], owner[new]
    return full, np.searchsorted(owner, np.arange(w.n_texts + 1))


def set_hashes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set, whatever the order of its elements."""
    out = np.zeros(len(first) - 1, dtype=U64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        a, b = mix(sets), mix(sets ^ U64(0x5851F42D4C957F2D))
        at = first[full]
        out[full] = mix(np.add.reduceat(a, at) ^ mix(np.add.reduceat(b, at)))
    return out


def signatures(sets: np.ndarray, first: np.ndarray, which: list[Band]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures and, for each, the index of its set."""
    sizes = np.diff(first)
    out_s, out_o = [], []
    for number, band in enumerate(which):
        own = np.flatnonzero((sizes >= band.low) & (sizes <= band.reach))
        if not len(own):
            continue
        n = sizes[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        x, local = sets[at], np.repeat(np.arange(len(own)), n)
        pieces = band.n1 * band.n2
        # The high half of a mixed hash picks the piece without modulo bias.
        piece = ((mix(x) >> U64(32)) * U64(pieces) >> U64(32)).astype(np.int64)
        cell = local * pieces + piece
        total = np.zeros(len(own) * pieces, dtype=U64)
        np.add.at(total, cell, mix(x ^ U64(0xA24BAED4963EE407)))
        count = np.bincount(cell, minlength=len(total)).reshape(len(own), band.n1, band.n2)
        total = total.reshape(len(own), band.n1, band.n2)
        picks = list(combinations(range(band.n2), band.n2 - band.k2))
        weakest = np.full((len(own), band.n1), 1 << 30)
        made = []
        for pick in picks:
            value = np.zeros((len(own), band.n1), dtype=U64)
            size = np.zeros((len(own), band.n1), dtype=np.int64)
            for p in pick:
                value = mix(value + total[:, :, p])
                size += count[:, :, p]
            made.append((value, size))
            weakest = np.minimum(weakest, size)
        # Fewer than ``spare`` parts hold a choice below this size.
        least = np.partition(weakest, band.spare - 1, axis=1)[:, band.spare - 1]
        part = np.arange(band.n1, dtype=np.uint64) * U64(1 << 20) + U64(number * 64 + 1)
        for pick, (value, size) in enumerate(made):
            keep = size >= least[:, None]
            sig = mix(value ^ mix(part + U64(pick * 7919))[None, :])
            out_s.append(sig[keep])
            out_o.append(np.broadcast_to(own[:, None], keep.shape)[keep])
    if not out_s:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_s), np.concatenate(out_o)

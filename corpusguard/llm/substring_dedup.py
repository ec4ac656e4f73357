"""Substring dedup with difference-cover anchors.

A word is removed when a window of ``window`` words that covers it also starts in
a document with a smaller doc_id.

Windows are not matched one by one. For a difference cover D modulo ``period``
any two positions have a shift below ``period`` that puts both on D. Hashing
``window - period + 1`` words at the positions on D only, any two equal windows
share such an anchor. So, with documents dealt into blocks by doc_id:

1. each block sends the hashes of its anchors, each once, to their hash ranges;
   a range answers each block with one bit per anchor: do two documents have it;
2. each block extends its shared anchors to the windows around them, and sends
   those windows' hashes with the smallest doc_id it has for each; the ranges
   answer with the smallest doc_id anywhere, where that is smaller;
3. each block removes the words of the windows that start in a smaller document.

A passage that a third of all documents hold is one entry per block and range.
The text is shuffled once; all three steps read that one exchange.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.blocks import BLOCK_BYTES, ROW_BYTES, deal, from_streams, with_given
from corpusguard.llm.memory import releasing
from corpusguard.llm.packed import first_of_runs, pack, range_bounds, unpack
from corpusguard.llm.store import parts, text_bytes
from corpusguard.llm.words import Words, buffers, slices

#: The period whose cover is sparsest for windows of 13 words, and that cover.
PERIOD, COVER = 7, (0, 1, 3)
RANGE_BYTES = 8 << 20
#: The doc_id of a row that has none: it removes nothing and nothing is removed from it.
NO_ID = np.iinfo(np.int64).max

_MESSAGE = "range int, block int, keys binary, extra binary"


class Block:
    """The documents of a block, and what the steps derive from them."""

    def __init__(self, streams: pa.Table, window: int):
        self.table = table = from_streams(streams.column("data"))
        ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = table.column("text").combine_chunks()
        self.window, self.anchor = window, window - PERIOD + 1
        self.slices = list(slices(self.text))
        self.hashes = [w.hashes() for w in self.slices]

    def windows(self, w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and place of each window of ``size`` words of the texts that
        are long enough for a whole window and have a doc_id."""
        value, first = w.windows(h, size)
        n = np.diff(first)
        text = np.repeat(np.arange(w.n_texts), n)
        place = np.arange(len(value)) - np.repeat(first[:-1], n)
        use = ((w.counts() >= self.window) & self.known[w.row : w.row + w.n_texts])[text]
        return value[use], text[use], place[use]

    def anchors(self) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """For each slice the anchors; all distinct anchors, ascending, and which
        of them two documents of this block have."""
        on = np.zeros(PERIOD, dtype=bool)
        on[list(COVER)] = True
        each = []
        for w, h in zip(self.slices, self.hashes, strict=True):
            value, text, place = self.windows(w, h, self.anchor)
            pick = on[place % PERIOD]
            each.append((value[pick], text[pick], place[pick]))
        keys, least, most = self.by_key([(v, self.ids[w.row + t]) for w, (v, t, _) in zip(self.slices, each, strict=True)])
        return each, keys, least != most

    @staticmethod
    def by_key(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, ascending, with the smallest and the largest id of each."""
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, own = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        first = first_of_runs(key)
        if not len(first):
            return key, own, own
        return key[first], np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)

    def candidates(self, bits: dict[int, bytes], n_ranges: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice the windows that hold a shared anchor."""
        each, keys, _ = self.anchors()
        at = range_bounds(keys, n_ranges)
        shared = np.zeros(len(keys), dtype=bool)
        for r, data in bits.items():
            shared[at[r] : at[r + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=at[r + 1] - at[r])
        out = []
        for w, h, (value, text, place) in zip(self.slices, self.hashes, each, strict=True):
            hit = shared[np.searchsorted(keys, value)] if len(keys) else np.zeros(0, dtype=bool)
            whole, first = w.windows(h, self.window)
            last = np.diff(first) - 1  # of each text, the last window's place
            text, place = text[hit], place[hit]
            lo = first[text] + np.maximum(place - PERIOD + 1, 0)
            hi = first[text] + np.minimum(place, last[text]) + 1
            mark = np.zeros(len(whole) + 1, dtype=np.int32)
            np.add.at(mark, lo[lo < hi], 1)
            np.add.at(mark, hi[lo < hi], -1)
            pick = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            owner = np.searchsorted(first, pick, side="right") - 1
            out.append((whole[pick], owner, pick - first[owner]))
        return out


def _message(block: int, keys: np.ndarray, extra, n_ranges: int) -> pa.Table:
    """One row for each range that has keys; ``extra(lo, hi)``: the bytes for them."""
    at = range_bounds(keys, n_ranges)
    rows = [(r, block, pack(keys[lo:hi]), extra(lo, hi)) for r, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["range", "block", "keys", "extra"])


def _answers(table: pa.Table, kind: int, extra: list[bytes | None]) -> pa.Table:
    some = [i for i, x in enumerate(extra) if x is not None]
    kept = table.take(pa.array(some, pa.int64()))
    return pa.table({"block": kept.column("block"), "kind": pa.array([kind] * len(some), pa.int32()), "range": kept.column("range"), "answer": pa.array([extra[i] for i in some], pa.binary())})


def _which_are_shared(table: pa.Table) -> pa.Table:
    """For each block's anchors of a range: does another document have them."""
    keys = [unpack(x.as_py()) for x in table.column("keys")]
    many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)) for x, k in zip(table.column("extra"), keys, strict=True)]
    every, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = count > 1
    np.logical_or.at(shared, at, np.concatenate(many) > 0)
    ends = np.cumsum([len(k) for k in keys])
    answer = [np.packbits(x).tobytes() if x.any() else None for x in np.split(shared[at], ends[:-1])]
    return _answers(table, 1, answer)


def _smaller_owners(table: pa.Table) -> pa.Table:
    """For each block's windows of a range: the smallest doc_id, where it is another block's."""
    keys = [unpack(x.as_py()) for x in table.column("keys")]
    owns = [unpack(x.as_py(), np.int64) for x in table.column("extra")]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    least = np.full(len(every), NO_ID)
    np.minimum.at(least, at, np.concatenate(owns))
    ends, out = np.cumsum([len(k) for k in keys]), []
    for own, value in zip(owns, np.split(least[at], ends[:-1]), strict=True):
        less = value < own
        out.append(np.packbits(less).tobytes() + pack(value[less]) if less.any() else None)
    return _answers(table, 2, out)


_ANSWER = "block int, kind int, range int, answer binary"


def substring_dedup(docs: DataFrame, window: int = 13, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, n_words, n_removed, kept, carried...)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. ``kept``: the words that stay,
    joined by one space. A null text is empty: no words, ``kept`` is ''. A text
    with fewer words than ``window`` loses nothing, and a row with a null doc_id
    neither loses words nor makes others lose any. Rows with the same doc_id are
    one document: they do not remove words from each other. ``carry`` names
    further columns of ``docs`` to return; others, whatever their names, are
    ignored. An empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    carry = carry or []
    n_rows, total = text_bytes(docs, "text")
    n_blocks, n_ranges = parts(total + ROW_BYTES * n_rows, BLOCK_BYTES), parts(total, RANGE_BYTES)
    given = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", given.alias("given"))
    blocks = deal(rows, n_blocks)

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, keys, many = Block(table, window).anchors()
        return _message(key[0].as_py(), keys, lambda lo, hi: np.packbits(many[lo:hi]).tobytes(), n_ranges)

    def answered(right: pa.Table, kind: int) -> dict[int, bytes]:
        return {r: x for k, r, x in zip(*(right.column(c).to_pylist() for c in ("kind", "range", "answer")), strict=True) if k == kind}

    def ask_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, window)
        found = b.candidates(answered(right, 1), n_ranges)
        keys, least, _ = b.by_key([(v, b.ids[w.row + t]) for w, (v, t, _) in zip(b.slices, found, strict=True)])
        return _message(key[0].as_py(), keys, lambda lo, hi: pack(least[lo:hi]), n_ranges)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, window)
        found = b.candidates(answered(right, 1), n_ranges)
        keys, least, _ = b.by_key([(v, b.ids[w.row + t]) for w, (v, t, _) in zip(b.slices, found, strict=True)])
        at, least = range_bounds(keys, n_ranges), least.copy()
        for r, data in answered(right, 2).items():
            n = int(at[r + 1] - at[r])
            less = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, count=-(-n // 8)), count=n))
            least[at[r] + less] = unpack(data[-(-n // 8) :], np.int64)
        data, bounds = buffers(b.text)
        words, gone, kept = [], [], []
        for w, (value, text, place) in zip(b.slices, found, strict=True):
            removed = np.zeros(len(w.start) + 1, dtype=np.int32)
            if len(value):
                hit = least[np.searchsorted(keys, value)] < b.ids[w.row + text]
                starts = w.first[text[hit]] + place[hit]
                np.add.at(removed, starts, 1)
                np.add.at(removed, starts + window, -1)
            stays = np.cumsum(removed[:-1]) <= 0
            for i in range(w.n_texts):
                each = data[bounds[w.row + i] : bounds[w.row + i + 1]].tobytes().split()
                mask = stays[w.first[i] : w.first[i + 1]]
                n_kept = int(mask.sum())
                words.append(len(each))
                gone.append(len(each) - n_kept)
                kept.append(b" ".join(each if n_kept == len(each) else compress(each, mask)))
        out = {"doc_id": b.table.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "given": b.table.column("given")}
        return pa.table(out)

    anchors = blocks.groupBy("block").applyInArrow(releasing(ask_anchors), _MESSAGE)
    shared = anchors.groupBy("range").applyInArrow(releasing(_which_are_shared), _ANSWER)
    windows = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(releasing(ask_windows), _MESSAGE)
    smaller = windows.groupBy("range").applyInArrow(releasing(_smaller_owners), _ANSWER)
    schema = with_given("doc_id long, n_words long, n_removed long, kept string", rows)
    out = blocks.groupBy("block").cogroup(shared.union(smaller).groupBy("block")).applyInArrow(releasing(remove), schema)
    return out.select("doc_id", "n_words", "n_removed", "kept", *[F.col("given")[c].alias(c) for c in carry])

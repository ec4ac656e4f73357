"""Quality rules: text statistics, and a classifier trained on labelled rows.

The classifier is a logistic regression over hashed n-grams: words and pairs of
words, and byte 3- and 4-grams. A text's input is the mean weight of its words'
buckets plus the mean weight of its bytes' buckets. It is trained in numpy on a
bounded sample of labelled rows (``SAMPLE``, the first by a hash of doc_id); one
fifth of them is kept back to calibrate the probability (Platt). Texts are scored
in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.blocks import with_given
from corpusguard.llm.memory import release
from corpusguard.llm.packed import first_of_runs
from corpusguard.llm.words import U64, Words, mix, slices

SAMPLE = 2500
BUCKET_BITS = 16
STEPS = 100
#: Texts whose probability of being good is below this are rejected.
KEEP_AT = 0.5
#: The rule on words and the one on repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _per_text(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from ``start`` to ``end`` for each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[end] - sums[start]


def statistics(w: Words) -> dict[str, np.ndarray]:
    """The texts' counts that the rules look at."""
    lead = (w.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    word_chars = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    out = {
        "n_words": w.counts(),
        "word_chars": word_chars[w.first[1:]] - word_chars[w.first[:-1]],
        "n_symbols": _per_text(_SYMBOL[w.data], w.text_start, w.text_end),
    }
    # Lines with a word: cut at \n and at texts' bounds.
    cuts = np.flatnonzero(w.data == 0x0A)
    start = np.unique(np.concatenate([w.text_start, cuts + 1]))
    start = start[start < len(w.data)]
    owner = np.searchsorted(w.text_start, start, side="right") - 1
    end = np.minimum(np.concatenate([start[1:], [len(w.data)]]), w.text_end[owner])
    end = end - (w.data[np.maximum(end - 1, 0)] == 0x0A) * (end > start)
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    lines = Words(w.data, start[full], end[full], w.first, w.text_start, w.text_end, w.row)
    mine = mix(lines.hashes() ^ mix(owner[full].astype(U64) + U64(1)))
    _, first = np.unique(mine, return_index=True)
    out["n_dup_lines"] = np.bincount(owner[full], minlength=w.n_texts) - np.bincount(owner[full][first], minlength=w.n_texts)
    # Words in windows that the text has twice or more.
    value, first_window = w.windows(w.hashes(), WINDOW)
    n = np.diff(first_window)
    text = np.repeat(np.arange(w.n_texts), n)
    value = value ^ mix(text.astype(U64) + U64(1))
    order = np.argsort(value, kind="stable")
    runs = first_of_runs(value[order])
    often = np.repeat(np.diff(np.concatenate([runs, [len(value)]])) > 1, np.diff(np.concatenate([runs, [len(value)]])))
    hit = order[often]
    starts = w.first[text[hit]] + hit - first_window[text[hit]]
    mark = np.bincount(starts, minlength=len(w.start) + WINDOW + 1) - np.bincount(starts + WINDOW, minlength=len(w.start) + WINDOW + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(mark)[: len(w.start)] > 0)])
    out["n_repeat_words"] = covered[w.first[1:]] - covered[w.first[:-1]]
    return out


def _features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, buckets and the index of each text's first one."""
    shift = U64(64 - BUCKET_BITS)
    h = w.hashes()
    yield (h >> shift).astype(np.int64), w.first
    if len(h):
        pairs, first = w.windows(h, 2)
        yield (pairs >> shift).astype(np.int64), first
    wide = w.data.astype(np.uint32)
    for size in (3, 4):
        n = len(wide) - size + 1
        if n <= 0:
            continue
        code = wide[:n].copy()
        for j in range(1, size):
            code |= wide[j : j + n] << np.uint32(8 * j)
        code = code * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        bucket = (code * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        length = np.maximum(w.text_end - w.text_start - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(length)])
        inside = np.arange(first[-1]) + np.repeat(w.text_start - first[:-1], length)
        yield bucket[inside], first


class Model:
    """Weights by kind of n-gram, their bias, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, w: Words) -> np.ndarray:
        out = np.full(w.n_texts, self.bias)
        for kind, (bucket, first) in enumerate(_features(w)):
            sums = np.concatenate([[0], np.cumsum(self.weights[kind][bucket])])
            out += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
        return out

    def probability(self, w: Words) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(w) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(texts: list[str], labels: list[int]) -> Model | None:
    """None without labelled rows; rows of one label give that label's probability."""
    if not texts:
        return None
    y = np.array(labels, dtype=float)
    kinds, size = 4, 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        odds = (y.sum() + 1) / (len(y) - y.sum() + 1)
        return Model(np.zeros((kinds, size)), 0.0, 1.0, float(np.log(odds)))
    # Each text's share of each bucket, a piece per kind and slice of texts; sums go
    # over the pieces one by one, so no array is as long as all of them.
    pieces = []
    for w in slices(pa.array(texts, pa.large_string())):
        for kind, (bucket, first) in enumerate(_features(w)):
            n = np.diff(first)
            text = np.repeat(np.arange(w.n_texts), n)
            key, count = np.unique(text * size + bucket, return_counts=True)
            text = key // size
            pieces.append(((key % size + kind * size).astype(np.int32), (count / np.maximum(n, 1)[text]).astype(np.float32), (text + w.row).astype(np.int32)))

    def margins(weight: np.ndarray, bias: float) -> np.ndarray:
        z = np.full(len(y), bias)
        for column, value, owner in pieces:
            z += np.bincount(owner, weights=value * weight[column], minlength=len(y))
        return z

    back = np.random.default_rng(0).permutation(len(y)) < len(y) // 5
    used = ~back
    balance = np.where(y > 0, 0.5 / max(1, (y[used] > 0).sum()), 0.5 / max(1, (y[used] == 0).sum())) * used
    weight, bias = np.zeros(kinds * size), 0.0
    m, v, mb, vb = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        gap = (_sigmoid(margins(weight, bias)) - y) * balance
        g = 1e-7 * weight
        for column, value, owner in pieces:
            g += np.bincount(column, weights=value * gap[owner], minlength=len(weight))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gap.sum(), 0.999 * vb + 0.001 * gap.sum() ** 2
        rate = 0.2
        weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    z = margins(weight, bias)
    slope, offset = _platt(z[back], y[back]) if back.any() and len(set(y[back])) == 2 else (1.0, 0.0)
    return Model(weight.reshape(kinds, size), bias, slope, offset)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make ``sigmoid(slope * z + offset)`` a probability."""
    scale = max(float(np.std(z)), 1e-6)
    x, a, b = z / scale, 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(2000):
        gap = _sigmoid(a * x + b) - target
        a -= 0.5 * float((gap * x).mean())
        b -= 0.5 * float(gap.mean())
    return max(a, 1e-6) / scale, b


def training_rows(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` labelled rows with whole texts, the first by a hash of doc_id.
    A doc_id with several labels takes the smallest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label")).limit(limit)


def quality_rules(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` → per row ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, probability, kept`` and the columns
    that ``carry`` names.

    A null or empty text has no words and fails the base rules. ``probability`` is
    the calibrated probability of a good text; without a model it is null and the
    base rules decide alone. Rows repeat as given; an empty table gives no rows.
    """
    carry = carry or []
    given = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", given.alias("given"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1)):
                found = statistics(w)
                n = found["n_words"]
                failed = (n < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * n)
                p = model.probability(w) if model is not None else None
                kept = ~failed if p is None else ~failed & (p >= keep_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.row, w.n_texts),
                        *(pa.array(found[c].astype(np.int64)) for c in names),
                        pa.array(failed),
                        pa.nulls(w.n_texts, pa.float64()) if p is None else pa.array(p),
                        pa.array(kept),
                        batch.column(2).slice(w.row, w.n_texts),
                    ],
                    ["doc_id", *names, "base_failed", "probability", "kept", "given"],
                )
            release()

    columns = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, probability double, kept boolean"
    out = rows.mapInArrow(judge, with_given(columns, rows))
    return out.select("doc_id", *names, "base_failed", "probability", "kept", *[F.col("given")[c].alias(c) for c in carry])


def learn_quality(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = training_rows(docs, labels).collect()
    return train([r.text for r in sample], [r.label for r in sample])

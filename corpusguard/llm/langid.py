"""Language identification from averaged hashed subword embeddings.

A text's subwords are the byte 3- and 4-grams inside its words, word bounds
included, of the text with A-Z lower-cased and ASCII digits and punctuation blank.
Each hashes to a row of an embedding table; the mean of the rows goes through a
linear softmax. Table and softmax are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows (``SAMPLE`` rows, the first by a hash
of doc_id). One fifth of the sample is kept back to fit a temperature, so that
scores are probabilities, and the score below which a prediction is rejected.

As softmax inputs are means, ``embedding @ softmax`` is one table of logits per
bucket; whole texts are scored by summing its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.blocks import with_given
from corpusguard.llm.words import buffers

SAMPLE = 3000
BUCKET_BITS = 16
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
BATCH = 16
GRAMS = (3, 4)
#: Share of accepted predictions on the kept-back rows that must be right.
PRECISION = 0.99
UNKNOWN = "und"
SLICE_BYTES = 1 << 20


def _letters() -> np.ndarray:
    table = np.full(256, 0x20, dtype=np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    lower = np.arange(ord("a"), ord("z") + 1)
    table[lower], table[lower - 32] = lower, lower
    return table


_LETTER = _letters()


def subwords(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size, bucket of each subword and the place of its first byte."""
    letters = _LETTER[data]
    blank = letters == 0x20
    wide = letters.astype(np.uint32)
    for size in GRAMS:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code, good = wide[:n].copy(), np.ones(n, dtype=bool)
        for j in range(1, size):
            code |= wide[j : j + n] << np.uint32(8 * j)
            if j < size - 1:
                good &= ~blank[j : j + n]
        for j in range(1, size):  # grams that reach into the next text
            at = bounds[1:] - j
            good[at[(at >= 0) & (at < n)]] = False
        place = np.flatnonzero(good)
        code = code[place] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        yield (code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS), place


def _sums(rows: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by text; ``place`` ascending."""
    first = np.searchsorted(place, bounds)
    out = np.zeros((len(bounds) - 1, rows.shape[1]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(rows, first[full], axis=0)
    return out


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.languages, self.table, self.bias = languages, table.astype(np.float32), bias
        self.temperature, self.reject_below = temperature, reject_below

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        count = np.zeros(len(bounds) - 1)
        for bucket, place in subwords(data, bounds):
            total += _sums(self.table[bucket], place, bounds)
            count += np.diff(np.searchsorted(place, bounds))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(data, bounds) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str]) -> Model | None:
    """A model of the languages that occur; None if there are none."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(0)
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        found = [b for b, _ in subwords(data, np.array([0, len(data)]))]
        bucket, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
        bags.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    label = np.array([names.index(x) for x in languages])
    order = rng.permutation(len(texts))
    kept_back, used = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps = max(1, EPOCHS * -(-len(used) // BATCH))
    for step in range(steps if len(used) else 0):
        pick = used[rng.integers(0, len(used), BATCH)]
        rate = RATE * (1 - step / steps)
        h = np.stack([bags[i][1] @ embed[bags[i][0]] for i in pick])
        gap = _softmax(h @ soft + bias)
        gap[np.arange(len(pick)), label[pick]] -= 1
        back = gap @ soft.T
        soft -= rate * h.T @ gap / len(pick)
        bias -= rate * gap.mean(axis=0) * 0.1
        # A row's share of the mean is small: rows learn at the size of a text's bag.
        for i, g in zip(pick, back, strict=True):
            bucket, weight = bags[i]
            embed[bucket] -= rate * 30 * weight[:, None] * g[None, :]
    model = Model(names, embed @ soft, bias, 1.0, 0.0)
    if len(kept_back):
        logits = np.stack([(bags[i][1] @ model.table[bags[i][0]]) + bias for i in kept_back])
        truth = label[kept_back]

        def loss(t: float) -> float:
            return -float(np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())

        model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        p = _softmax(logits / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        rank = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[rank]) >= PRECISION * np.arange(1, len(rank) + 1))
        model.reject_below = float(best[rank[good[-1]]]) if len(good) else 1.0
    return model


def training_rows(docs: DataFrame, modulus: int, held_out: int, limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` labelled rows with whole texts, the first by a hash of doc_id."""
    used = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(modulus) != held_out))
    ids = used.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return used.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang").limit(limit)


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def identify(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` → per row ``doc_id, lang_pred, score, accepted``
    and the columns that ``carry`` names.

    Only the text is looked at. A null text or one without a letter is ``und``
    with score 0, as is every text if there was nothing to learn from. ``score``:
    the calibrated probability; ``accepted``: it reaches the rejection threshold.
    """
    carry = carry or []
    given = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), given.alias("given"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            letters = np.asarray(batch.column(2))
            names, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            row = 0
            while model is not None and row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1)
                p = model.probabilities(data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row])
                best = p.argmax(axis=1)
                own = np.flatnonzero(letters[row:stop])
                names[row + own] = np.array(model.languages, dtype=object)[best[own]]
                scores[row + own] = np.clip(p[own, best[own]], 0, 1)
                row = stop
            accepted = (names != UNKNOWN) & (scores >= (model.reject_below if model is not None else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted.astype(bool)), batch.column(3)], ["doc_id", "lang_pred", "score", "accepted", "given"])

    out = rows.mapInArrow(predict, with_given(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean", rows))
    return out.select("doc_id", "lang_pred", "score", "accepted", *[F.col("given")[c].alias(c) for c in carry])


def language_id(docs: DataFrame, modulus: int = 3, held_out: int = 1, carry: list[str] | None = None) -> DataFrame:
    """Trains on rows whose ``crc32(doc_id) % modulus`` is not ``held_out`` and
    predicts all rows; a row with a null doc_id is not learned from."""
    sample = training_rows(docs, modulus, held_out).collect()
    return identify(docs, train([r.text for r in sample], [r.lang for r in sample]), carry)

"""Hidden Markov language model over words.

A hidden state emits words; every word of the training text has an emission of its
own from every state, learned from its expected counts. To a word's
expected counts comes one unit, dealt to the states as its class is, and each
suffix class has one more unit for unknown words, so the words'
probabilities sum to one. The state tables so grow with the vocabulary: they lie in
hash ranges, never in one place, and a block asks for its distinct words' rows.

Word classes make the start, before any pass, and deal those units: words with a share of at least
``1/FREQUENT`` of the training tokens are their own, all others share ``SUFFIXES``
classes by their last bytes. At the start a word's share of its class is by its count.

Training: exact counts of all training words (by hash range, each block asking
for its distinct words); a start from a mixture of bags of words, fitted by
``MIXTURE_PASSES`` passes over all training text (the first deals the documents
to the parts by random directions around the corpus's mean, so no document is a
seed); then Baum-Welch passes over all training text, whose expected counts by
word and state are summed by hash range. They travel as a
word's exact count and each state's share of it, a 16-bit float (3 digits).
Passes and scoring run the scaled recursions over each whole text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.blocks import BLOCK_BYTES, ROW_BYTES, as_stream, deal, from_streams, with_given
from corpusguard.llm.memory import release, releasing
from corpusguard.llm.packed import first_of_runs, pack, range_bounds, unpack
from corpusguard.llm.store import parts, remove, stored, text_bytes
from corpusguard.llm.words import U64, Words, mix, slices

STATES = 8
FREQUENT = 20_000
SUFFIX_BITS = 13
SUFFIXES = 1 << SUFFIX_BITS
#: The end of a text, as a key; its low bits are like any word's.
END = U64(0xE4D0E4D0E4D0E000)
#: Passes over all training text of the mixture that the states start from. All but
#: the last count by ``FOLD`` buckets of classes, the last by classes.
MIXTURE_PASSES = 5
FOLD = 2048
PASSES = 2
#: Tokens of whole texts that a pass holds at a time (a longer text is held alone).
PIECE = 400_000
#: Length of the runs that ``expected_counts`` cuts; no query uses it.
RUN = 256
#: Tokens worth of class prior that every state's emissions are smoothed with.
PRIOR = 200.0
RANGE_BYTES = 8 << 20


def word_keys(w: Words) -> np.ndarray:
    """A 64-bit key for each word: its hash, with the suffix class in the low bits."""
    h = w.hashes()
    if not len(h):
        return h
    tail = np.zeros(len(h), dtype=U64)
    for back in range(1, 4):
        at = w.end - back
        tail = tail * U64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(U64) + U64(1)
    return (h & ~U64(SUFFIXES - 1)) | (mix(tail) & U64(SUFFIXES - 1))


@dataclass
class Model:
    frequent: np.ndarray  # keys of the frequent words, ascending
    emit: np.ndarray  # classes x states
    start: np.ndarray
    move: np.ndarray
    #: Once words emit by their own counts: what each state holds of tokens and
    #: units. ``emit`` then says how a class deals a word's one unit to the states.
    held: np.ndarray | None = None

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """Class of each key: frequent words first, then suffixes."""
        n = len(self.frequent)
        out = (keys & U64(SUFFIXES - 1)).astype(np.int64) + n
        if n:
            at = np.minimum(np.searchsorted(self.frequent, keys), n - 1)
            hit = self.frequent[at] == keys
            out[hit] = at[hit]
        return out


def _sequences(w: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts with an end after each, and where each text begins."""
    first = w.first[:-1] + np.arange(w.n_texts)
    out = np.empty(len(keys) + w.n_texts, dtype=U64)
    out[first + w.counts()] = END
    out[np.arange(len(keys)) + w.owner()] = keys
    return out, np.concatenate([first, [len(out)]])


def expected_counts(model: Model, tokens: np.ndarray, first: np.ndarray, total: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
    """Adds the expected emissions, moves and starts of the sequences of classes
    ``tokens[first[i]:first[i + 1]]``, cut into runs."""
    begin = np.concatenate([np.arange(a, b, RUN) for a, b in zip(first[:-1], first[1:], strict=True)])
    head = np.isin(begin, first[:-1])
    length = np.minimum(RUN, np.repeat(first[1:], -(-np.diff(first) // RUN)) - begin)
    order = np.argsort(-length, kind="stable")
    begin, head, length = begin[order], head[order], length[order]
    steps, k = int(length.max()), model.emit.shape[1]
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # runs longer than t
    seen = [model.emit[tokens[begin[: active[t]] + t]] for t in range(steps)]
    inner = np.linalg.matrix_power(model.move, 64)[0]  # a run inside a text starts anywhere
    forward, scale = [], []
    a = np.where(head[:, None], model.start, inner) * seen[0]
    for t in range(steps):
        if t:
            a = (a[: active[t]] @ model.move) * seen[t]
        s = a.sum(axis=1, keepdims=True)
        a = a / s
        forward.append(a)
        scale.append(s)
    beta = np.ones((int(active[-1]), k))
    for t in range(steps - 1, -1, -1):
        gamma = forward[t].copy()
        gamma[: len(beta)] *= beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        if t:
            ahead = seen[t] / scale[t]
            ahead[: len(beta)] *= beta
            moves += model.move * (forward[t - 1][: active[t]].T @ ahead)
            beta = ahead @ model.move.T
        seen[t] = gamma
    flat = np.concatenate(seen)
    where = np.concatenate([tokens[begin[: active[t]] + t] for t in range(steps)])
    for j in range(k):
        total[:, j] += np.bincount(where, weights=flat[:, j], minlength=len(total))
    starts += seen[0][head].sum(axis=0)


def text_counts(model: Model, tokens: np.ndarray, first: np.ndarray, total: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
    """Adds the expected emissions, moves and starts of the whole sequences
    ``tokens[first[i]:first[i + 1]]``, all of a piece in step, the longest first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    ends, at = np.cumsum(length), 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(ends, PIECE + (ends[at - 1] if at else 0), side="right")))
        _piece_counts(model, tokens, begin[at:stop], length[at:stop], total, moves, starts)
        at = stop


def _piece_counts(model: Model, tokens: np.ndarray, begin: np.ndarray, length: np.ndarray, total: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    off = np.concatenate([[0], np.cumsum(active)])
    rank = np.arange(off[-1]) - np.repeat(off[:-1], active)
    where, before = tokens[begin[rank] + np.repeat(np.arange(steps), active)], np.repeat(off[:-2], active[1:]) + rank[active[0] :]
    del rank
    ahead = model.emit[where]
    forward, back = np.empty_like(ahead), np.ones_like(ahead)
    forward[: active[0]] = model.start * ahead[: active[0]]
    at, move_back = off.tolist(), np.ascontiguousarray(model.move.T)
    for t in range(1, steps):
        last, a, b = at[t - 1], at[t], at[t + 1]
        now = forward[a:b]
        np.matmul(forward[last : last + b - a], model.move, out=now)
        now *= ahead[a:b]
        if t % SCALE_EVERY == 0:
            now /= now.sum(axis=1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        last, a, b = at[t - 1], at[t], at[t + 1]
        now = ahead[a:b]
        now *= back[a:b]
        if t % SCALE_EVERY == 0:
            now /= now.sum(axis=1, keepdims=True)
        np.matmul(now, move_back, out=back[last : last + b - a])
    back *= forward
    whole = back.sum(axis=1, keepdims=True)
    back /= whole
    forward /= whole
    moves += model.move * (forward[before].T @ ahead[active[0] :])
    for j in range(back.shape[1]):
        total[:, j] += np.bincount(where, weights=back[:, j], minlength=len(total))
    starts += back[: active[0]].sum(axis=0)


#: Steps of the forward recursion between two scalings.
SCALE_EVERY = 8


def log_likelihood(model: Model, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the probability of each whole sequence of classes, all sequences
    in step, the longest first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, sorted_length = first[:-1][order], length[order]
    steps = int(sorted_length[0]) if len(order) else 0
    active = np.searchsorted(-sorted_length, -np.arange(steps + 1), side="left").tolist()
    sums, scaled = np.empty(len(order)), np.zeros(len(order))
    a = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t in range(steps):
        n, after = active[t], active[t + 1]
        a = a if t == 0 else a[:n] @ model.move
        a = a * model.emit[tokens[begin[:n] + t]]
        if after < n:
            sums[after:n] = scaled[after:n] + np.log10(a[after:].sum(axis=1))
        if t % SCALE_EVERY == SCALE_EVERY - 1 and after:
            s = a[:after].sum(axis=1)
            a = a[:after] / s[:, None]
            scaled[:after] += np.log10(s)
    result = np.empty(len(order))
    result[order] = sums
    return result


def _held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def mixture_shares(level: np.ndarray, weight: np.ndarray, tokens: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Documents x parts: how much of each document, ``length`` consecutive ``tokens``,
    is of each part. ``level``: log of a token's probability in a part, up to a
    constant by token; ``weight``: log of the parts' shares. No document is empty."""
    begin = np.cumsum(length) - length
    fit = np.stack([np.add.reduceat(np.ascontiguousarray(x)[tokens], begin) for x in level.T], axis=1) + weight
    fit = np.exp(fit - fit.max(axis=1, keepdims=True))
    return fit / fit.sum(axis=1, keepdims=True)


def hmm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, states: int = STATES, passes: int = PASSES, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` → per row ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score`` and the columns that ``carry`` names.

    Tokens are the words of the lower-cased (A-Z) text and one end. The model
    learns from rows with ``crc32(doc_id) % modulus != remainder``; a row with a
    null doc_id is scored, not learned from, and not held out. A null or empty
    text is its end alone. ``base_score``: log10 of the add-one unigram
    probability; ``score``: log10 of the model's. An empty table gives no rows;
    with nothing to learn from all words are unknown.
    """
    carry, spark = carry or [], docs.sparkSession
    n_rows, size = text_bytes(docs, "text")
    n_blocks, n_ranges = parts(size + ROW_BYTES * n_rows, BLOCK_BYTES), parts(size, RANGE_BYTES)
    given = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _held_out(modulus, remainder).alias("held_out"), given.alias("given"))

    def ask(key: tuple, streams: pa.Table) -> pa.Table:
        """The block's words for each range; and, as range -1, its rows without
        texts, its distinct keys, and each token's."""
        table = from_streams(streams.column("data"))
        each, lengths = [], []
        for w in slices(table.column("text").combine_chunks(), lower=True):
            k, own = _sequences(w, word_keys(w))
            each.append(k)
            lengths.append(np.diff(own))
        keys, word = np.unique(np.concatenate(each), return_inverse=True)
        del each
        length = np.concatenate(lengths)
        learn = ~np.asarray(table.column("held_out")) & ~np.asarray(table.column("doc_id").is_null())
        count = np.bincount(word[np.repeat(learn, length)], minlength=len(keys))
        at = range_bounds(keys, n_ranges)
        out = [(r, key[0].as_py(), pack(keys[a:b]), pack(count[a:b]), None, None, None, None) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        kept = table.drop_columns(["text"]).append_column("n", pa.array(length, pa.int64())).append_column("learn", pa.array(learn)).combine_chunks()
        out.append((-1, key[0].as_py(), None, None, as_stream(kept), pack(keys), pack(word.astype(np.int32)), int(count.sum())))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64()))], names=["range", "block", "keys", "counts", "data", "all_keys", "words", "learned"])

    def block_words(tokens: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, where each row's tokens begin, all distinct keys, and each token's."""
        table = from_streams(tokens.column("data"))
        first = np.concatenate([[0], np.cumsum(np.asarray(table.column("n")))])
        return table, first, unpack(tokens.column("all_keys")[0].as_py()), unpack(tokens.column("words")[0].as_py(), np.int32)

    def count(table: pa.Table) -> pa.Table:
        """Answers to the blocks; with block -1 the range's frequent words, and
        with block -2 its tokens and types by suffix class."""
        keys = [unpack(x.as_py()) for x in table.column("keys")]
        counts = [unpack(x.as_py(), np.int64) for x in table.column("counts")]
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(all_keys, kind="stable")
        first = first_of_runs(all_keys[order])
        distinct, total = all_keys[order][first], np.add.reduceat(all_counts[order], first)
        blocks = table.column("block").to_pylist()
        answers = [pack(total[np.searchsorted(distinct, k)]) for k in keys]
        known = np.flatnonzero(total)
        top = known[total[known] * FREQUENT >= n_total]
        suffix = (distinct[known] & U64(SUFFIXES - 1)).astype(np.int64)
        tokens = np.bincount(suffix, weights=total[known], minlength=SUFFIXES).astype(np.int64)
        types = np.bincount(suffix, minlength=SUFFIXES).astype(np.int64)
        r = table.column("range")[0].as_py()
        return pa.table(
            {
                "block": pa.array([*blocks, -1, -2], pa.int32()),
                "range": pa.array([r] * (len(blocks) + 2), pa.int32()),
                "answer": pa.array([*answers, pack(distinct[top]), pack(tokens)], pa.binary()),
                "more": pa.array([None] * len(blocks) + [pack(total[top]), pack(types)], pa.binary()),
            }
        )

    blocks = deal(rows, n_blocks)
    asked = stored(blocks.groupBy("block").applyInArrow(releasing(ask), "range int, block int, keys binary, counts binary, data binary, all_keys binary, words binary, learned long"), "words")
    n_total = asked.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    dealt = asked.where("range = -1").select("block", "data", "all_keys", "words")
    asked = asked.where("range >= 0").select("range", "block", "keys", "counts")
    answers = stored(asked.groupBy("range").applyInArrow(releasing(count), "block int, range int, answer binary, more binary"), "counts")

    # Bounded by FREQUENT and SUFFIXES, whatever the corpus.
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                tokens += unpack(a.as_py(), np.int64)
                types += unpack(b.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES), pa.int32()), pa.array(tokens), pa.array(types)], ["class", "tokens", "types"])

    stats = answers.where("block = -2").select("answer", "more").mapInArrow(summed, "class int, tokens long, types long")
    tokens, types = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for c, n, v in stats.groupBy("class").agg(F.sum("tokens"), F.sum("types")).collect():
        tokens[c], types[c] = n, v
    n_types = int(types.sum())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(a.as_py(), np.int64)), pa.array(unpack(b.as_py(), np.int64))], ["key", "n"])

    top = answers.where("block = -1").select("answer", "more").mapInArrow(listed, "key long, n long").collect()
    top_keys = np.array([r.key for r in top], dtype=np.int64).view(U64)
    order = np.argsort(top_keys)
    frequent, often = top_keys[order], np.array([r.n for r in top], dtype=np.int64)[order]
    own = (frequent & U64(SUFFIXES - 1)).astype(np.int64)
    np.subtract.at(tokens, own, often)
    np.subtract.at(types, own, 1)
    # A frequent word's class is that word; a suffix class has a unit for unknown words.
    weight = np.concatenate([often + 1, tokens + types + 1]).astype(float)
    prior = weight / weight.sum()

    def learned_words(table: pa.Table, first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the rows that are learned from, and their number by row."""
        learn, n = np.asarray(table.column("learn")), np.diff(first)
        return word[np.repeat(learn, n)], n[learn]

    def as_rows(every: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(every.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(every[some, j]) for j in range(states))], ["row", *(f"s{j}" for j in range(states))])

    def added_up(df: DataFrame, each, n: int) -> np.ndarray:
        """The sum of the tables of ``n`` rows that ``each`` makes in the tasks."""
        every = np.zeros((n, states))
        tables = df.mapInArrow(each, "row int, " + ", ".join(f"s{j} double" for j in range(states)))
        for r in tables.groupBy("row").agg(*[F.sum(f"s{j}") for j in range(states)]).collect():
            every[r[0]] = r[1:]
        return every

    model = Model(frequent, np.repeat(prior[:, None], states, axis=1), np.full(states, 1 / states), np.full((states, states), 1 / states))
    fold = np.arange(len(prior)) % FOLD
    few = np.bincount(fold, weights=prior)

    def mixing(level: np.ndarray, weight: np.ndarray, last: bool):
        n_sums = len(prior) if last else FOLD

        def mix_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Tokens by bucket (at last by class) and part, and in the last row documents by part."""
            every = np.zeros((n_sums + 1, states))
            for batch in batches:
                for i in range(batch.num_rows):
                    table, first, keys, word = block_words(pa.Table.from_batches([batch.slice(i, 1)]))
                    word, n = learned_words(table, first, word)
                    if not len(n):
                        continue
                    tokens = model.classes(keys)[word]
                    bucket = fold[tokens]
                    of = mixture_shares(level, weight, bucket, n)
                    where = tokens if last else bucket
                    for j in range(states):
                        every[:-1, j] += np.bincount(where, weights=np.repeat(of[:, j], n), minlength=n_sums)
                    every[-1] += of.sum(axis=0)
                    del table, first, keys, word, tokens, bucket, where
                    release()
            yield as_rows(every)

        return mix_in, n_sums + 1

    # Random directions with the corpus at their middle deal the documents evenly.
    level, weight = np.random.default_rng(0).standard_normal((FOLD, states)), np.zeros(states)
    level -= few @ level
    for left in range(MIXTURE_PASSES if n_total else 0, 0, -1):
        every = added_up(dealt, *mixing(level, weight, left == 1))
        own = every[:-1] + (prior if left == 1 else few)[:, None] * PRIOR
        own /= own.sum(axis=0)
        part = np.maximum(every[-1] / every[-1].sum(), 1e-3)
        part /= part.sum()
        if left > 1:
            level, weight = np.log(own / few[:, None]), np.log(part)
        else:
            model = Model(frequent, own, part, np.full((states, states), 0.02 / states) + np.eye(states) * 0.98)

    share = (tokens + types + 1).astype(float)
    n_frequent = len(frequent)
    units = np.concatenate([np.ones(n_frequent), types + 1])  # one for each word, and one in each class for unknown ones

    def emissions(now: Model, keys: np.ndarray, count: np.ndarray, sums: np.ndarray | None) -> np.ndarray:
        """Words x states: from the classes before the first pass, then from each
        word's own expected counts and one unit dealt as its class is."""
        classes = now.classes(keys)
        if now.held is not None:
            return (sums + now.emit[classes]) / now.held
        rare, part = classes >= n_frequent, np.ones(len(keys))
        part[rare] = (count[rare] + 1) / share[classes[rare] - n_frequent]
        return now.emit[classes] * part[:, None]

    def answered(now: Model, keys: np.ndarray, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Each key's count in the training text, and its emissions."""
        at, count = range_bounds(keys, n_ranges), np.zeros(len(keys), dtype=np.int64)
        sums = np.zeros((len(keys), states), dtype=np.float32) if now.held is not None else None
        for r, n, more in zip(right.column("range").to_pylist(), right.column("answer"), right.column("more"), strict=True):
            count[at[r] : at[r + 1]] = unpack(n.as_py(), np.int64)
            if sums is not None:
                sums[at[r] : at[r + 1]] = unpack(more.as_py(), np.float16).reshape(-1, states)
        if sums is not None:
            sums *= count[:, None]
        return count, emissions(now, keys, count, sums)

    def gather(table: pa.Table) -> pa.Table:
        """Expected counts of a range's words summed over all blocks, as answers to
        the blocks; and with block -1 the sums of classes, moves and starts."""
        own = table.filter(pc.greater_equal(table.column("block"), 0))
        rest = table.filter(pc.less(table.column("block"), 0))
        r, out = table.column("range")[0].as_py(), []
        if own.num_rows:
            keys = [unpack(x.as_py()) for x in own.column("keys")]
            all_keys = np.concatenate(keys)
            order = np.argsort(all_keys, kind="stable")
            first = first_of_runs(all_keys[order])
            distinct = all_keys[order][first]
            counts = np.concatenate([unpack(x.as_py(), np.int64) for x in own.column("counts")])
            total = np.add.reduceat(counts[order], first)
            sums = np.concatenate([unpack(x.as_py(), np.float16).reshape(-1, states) for x in own.column("sums")]).astype(float) * counts[:, None]
            sums = (np.add.reduceat(sums[order], first, axis=0) / np.maximum(total, 1)[:, None]).astype(np.float16)
            for block, k in zip(own.column("block").to_pylist(), keys, strict=True):
                at = np.searchsorted(distinct, k)
                out.append((block, r, pack(total[at]), pack(sums[at].reshape(-1))))
        if rest.num_rows:
            every = np.sum([np.frombuffer(x.as_py(), np.float32) for x in rest.column("sums")], axis=0, dtype=float)
            out.append((-1, r, None, every.astype(np.float32).tobytes()))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "range", "answer", "more"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros((len(prior) + states + 1, states))
        for batch in batches:
            for x in batch.column(0):
                every += np.frombuffer(x.as_py(), np.float32).reshape(every.shape)
        yield as_rows(every)

    def expecting(now: Model):
        def expect(left: pa.Table, right: pa.Table) -> pa.Table:
            """Expected counts of the block's words for each range, with the moves,
            starts and states of the block as block -1 of some range.
            Classes, moves and starts are a table of fixed size."""
            table, first, keys, word = block_words(left)
            count, emit = answered(now, keys, right)
            word, n = learned_words(table, first, word)
            first = np.concatenate([[0], np.cumsum(n)])
            total, moves, starts = np.zeros_like(emit), np.zeros_like(now.move), np.zeros_like(now.start)
            text_counts(Model(now.frequent, emit, now.start, now.move), word, first, total, moves, starts)
            local = np.bincount(word, minlength=len(keys))
            sums, block, at = (total / np.maximum(local, 1)[:, None]).astype(np.float16), left.column("block")[0].as_py(), range_bounds(keys, n_ranges)
            out = [(r, block, pack(keys[a:b]), pack(local[a:b]), pack(sums[a:b].reshape(-1))) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            classes = now.classes(keys)
            by_class = np.stack([np.bincount(classes, weights=total[:, j], minlength=len(now.emit)) for j in range(states)], axis=1)
            every = np.concatenate([by_class, moves, starts[None, :]])
            out.append((block % n_ranges, -1, None, None, every.astype(np.float32).tobytes()))
            return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["range", "block", "keys", "counts", "sums"])

        return releasing(expect)

    per_block = answers.where("block >= 0").select("block", "range", "answer", "more")
    for _ in range(passes if n_total else 0):
        counted = dealt.groupBy("block").cogroup(per_block.groupBy("block")).applyInArrow(expecting(model), "range int, block int, keys binary, counts binary, sums binary")
        done = answers
        answers = stored(counted.groupBy("range").applyInArrow(releasing(gather), "block int, range int, answer binary, more binary"), "expected")
        per_block = answers.where("block >= 0").select("block", "range", "answer", "more")
        every = added_up(answers.where("block = -1").select("more"), totals, len(prior) + states + 1)
        by_class = every[: len(prior)] + prior[:, None] * PRIOR
        dealt_as = by_class / by_class.sum(axis=1, keepdims=True)
        held = every[: len(prior)].sum(axis=0) + units @ dealt_as
        move, start = every[len(prior) : -1] + 0.01, every[-1] + 0.01
        # What the pass has read and shuffled goes before the next one writes as much.
        remove(spark, done.inputFiles()[0].rsplit("/", 1)[0])
        del counted, done
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        model = Model(frequent, dealt_as, start / start.sum(), move / move.sum(axis=1, keepdims=True), held)

    final = model

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        table, first, keys, word = block_words(left)
        count, emit = answered(final, keys, right)
        base = np.log10((count + 1) / (n_total + n_types + 1))
        n, begin = np.diff(first), first[:-1]
        known = np.add.reduceat((count[word] > 0).astype(np.int64), begin)
        b = np.add.reduceat(base[word], begin)
        s = log_likelihood(Model(final.frequent, emit, final.start, final.move), word, first)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(b), "score": pa.array(s), "given": table.column("given")})

    schema = with_given("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", rows)
    scored = (
        dealt.groupBy("block")
        .cogroup(per_block.groupBy("block"))
        .applyInArrow(releasing(score), schema)
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", "score", *[F.col("given")[c].alias(c) for c in carry])

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpusguard.llm.hmm as hmm
from corpusguard.llm.hmm import RUN, Model, expected_counts, hmm_scores, log_likelihood, text_counts
from corpusguard.llm.packed import ranges
from corpusguard.llm.words import slices
from tests.llm.fixtures import SCHEMA, rows, words


def model(k=3, classes=7, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((classes, k))
    move = rng.random((k, k)) + np.eye(k) * 3
    start = rng.random(k)
    return Model(np.zeros(0, np.uint64), emit / emit.sum(axis=0), start / start.sum(), move / move.sum(axis=1, keepdims=True))


def test_forward_recursion_sums_over_all_paths():
    m, rng = model(), np.random.default_rng(1)
    lengths = [1, 4, 2, 6]
    tokens, first = rng.integers(0, 7, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    got = log_likelihood(m, tokens, first)
    for i in range(len(lengths)):
        x, total = tokens[first[i] : first[i + 1]], 0.0
        for path in np.ndindex(*[3] * len(x)):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            total += p
        assert got[i] == pytest.approx(math.log10(total))


def test_expected_counts_sum_over_all_paths():
    m, rng = model(), np.random.default_rng(2)
    lengths = [1, 3, 5]
    tokens, first = rng.integers(0, 7, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    total, moves, starts = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros(3)
    expected_counts(m, tokens, first, total, moves, starts)
    want_total, want_moves, want_starts = np.zeros_like(total), np.zeros_like(moves), np.zeros(3)
    for i in range(len(lengths)):
        x, paths = tokens[first[i] : first[i + 1]], []
        for path in np.ndindex(*[3] * len(x)):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            paths.append((path, p))
        whole = sum(p for _, p in paths)
        for path, p in paths:
            want_starts[path[0]] += p / whole
            for t, s in enumerate(path):
                want_total[x[t], s] += p / whole
                if t:
                    want_moves[path[t - 1], s] += p / whole
    np.testing.assert_allclose(total, want_total)
    np.testing.assert_allclose(moves, want_moves)
    np.testing.assert_allclose(starts, want_starts)


def test_long_texts_are_counted_in_runs():
    m, n = model(), 3 * RUN + 5
    total, moves, starts = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros(3)
    expected_counts(m, np.arange(n) % 7, np.array([0, n]), total, moves, starts)
    assert total.sum() == pytest.approx(n) and starts.sum() == pytest.approx(1) and moves.sum() == pytest.approx(n - 4)


def test_long_texts_are_counted_whole(monkeypatch):
    """Against the plain recursions over each whole text, whatever the pieces."""
    m, rng = model(), np.random.default_rng(3)
    lengths = [1, 3 * RUN + 5, 2, RUN, 700]
    tokens, first = rng.integers(0, 7, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    want_total, want_moves, want_starts = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros(3)
    for a, b in zip(first[:-1], first[1:], strict=True):
        x, forward, back = tokens[a:b], [m.start * m.emit[tokens[a]]], [np.ones(3)]
        for t in x[1:]:
            f = forward[-1] @ m.move * m.emit[t]
            forward.append(f / f.sum())
        for t in x[:0:-1]:
            f = m.move @ (m.emit[t] * back[0])
            back.insert(0, f / f.sum())
        for t in range(len(x)):
            gamma = forward[t] * back[t]
            want_total[x[t]] += gamma / gamma.sum()
            if t:
                xi = forward[t - 1][:, None] * m.move * (m.emit[x[t]] * back[t])
                want_moves += xi / xi.sum()
        want_starts += forward[0] * back[0] / (forward[0] * back[0]).sum()
    for piece in (10, 1000, 1_000_000):
        monkeypatch.setattr("corpusguard.llm.hmm.PIECE", piece)
        total, moves, starts = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros(3)
        text_counts(m, tokens, first, total, moves, starts)
        np.testing.assert_allclose(total, want_total)
        np.testing.assert_allclose(moves, want_moves)
        np.testing.assert_allclose(starts, want_starts)
        assert moves.sum() == pytest.approx(sum(lengths) - len(lengths))


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def test_base_score_against_brute_force(spark):
    data = rows(7)
    counts = Counter()
    for doc, text, *_ in data:
        if doc is not None and not held_out(doc):
            counts.update([*words(text, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    got = hmm_scores(spark.createDataFrame(data, SCHEMA), carry=["kind"]).collect()
    expected = []
    for doc, text, *_ in data:
        tokens = [*words(text, lower=True), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        expected.append((str(doc), held_out(doc), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_nothing_to_learn_from(spark):
    assert hmm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    got = hmm_scores(spark.createDataFrame([(None, "a b", "en", "s", 1, 1, "x")], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]


def test_words_probabilities_sum_to_at_most_one(spark):
    """One-word texts over all training words: their probabilities, with the end, stay below one."""
    data = [(i, f"w{i % 50} w{i % 7}", "en", "s", 1, 1, "x") for i in range(400)]
    probe = [(100_000 + i, w, "en", "s", 1, 1, "x") for i, w in enumerate([f"w{i}" for i in range(50)] + [f"unseen{i}" for i in range(3)])]
    probe = [r for r in probe if held_out(r[0])]
    got = hmm_scores(spark.createDataFrame(data + probe, SCHEMA))
    total = got.where("doc_id >= 100000").agg(F.sum(F.expr("pow(10, score)"))).first()[0]
    assert total is None or total < 1


def test_better_than_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hmm_scores(docs).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert out[0] > out[1] + 0.1


def test_rare_words_of_one_suffix_have_emissions_of_their_own(spark):
    """Two words of one suffix class and count, each among other words: the context
    tells them apart, which shared classes cannot."""
    rng = np.random.default_rng(5)
    sides = [[f"{side}{i}" for i in range(40)] for side in ("left", "right")]
    data = []
    for i in range(600):
        text = [sides[i % 2][j] for j in rng.integers(0, 40, 60)]
        text[30] = ("one_xyz", "two_xyz")[i % 2] if i < 60 else text[30]
        data.append((i, " ".join(text), "en", "s", 1, 1, "x"))
    probes = [d for d in range(10_000, 10_100) if held_out(d)][:2]
    data += [(d, " ".join([*sides[0][:20], word, *sides[0][20:]]), "en", "s", 1, 1, "x") for d, word in zip(probes, ("one_xyz", "two_xyz"), strict=True)]
    # So few frequent words that both are rare.
    import corpusguard.llm.hmm as module

    before, module.FREQUENT = module.FREQUENT, 150
    try:
        got = {r.doc_id: r for r in hmm_scores(spark.createDataFrame(data, SCHEMA)).where("doc_id >= 10000").collect()}
    finally:
        module.FREQUENT = before
    apart = got[probes[0]].score - got[probes[1]].score
    assert apart - (got[probes[0]].base_score - got[probes[1]].base_score) > 0.5


def test_states_start_from_all_training_text(spark):
    """Two kinds of text that none of the 1500 training documents with the smallest
    hashes has: the states tell them apart all the same."""
    rng = np.random.default_rng(6)
    ids = [r.id for r in spark.range(3000).orderBy(F.xxhash64("id"), "id").collect()]
    first = set([d for d in ids if not held_out(d)][:1500])
    kinds = [[f"{kind}{i}" for i in range(40)] for kind in ("common", "left", "right")]
    kind_of = {d: 0 if d in first else 1 + d % 2 for d in ids}
    data = [(d, " ".join(kinds[kind_of[d]][j] for j in rng.integers(0, 40, 30)), "en", "s", 1, 1, "x") for d in ids]
    got = [r for r in hmm_scores(spark.createDataFrame(data, SCHEMA)).collect() if r.held_out]
    assert len(got) > 300 and {kind_of[r.doc_id] for r in got} == {1, 2}
    # A state that both kinds share loses log10(2) a token.
    apart = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    shares = Counter(kind_of[d] for d in ids if not held_out(d))
    assert apart > math.log10(sum(shares.values()) / max(shares[1], shares[2])) - 0.15


def test_mixture_shares_against_brute_force():
    rng = np.random.default_rng(7)
    level, weight, length = np.log(rng.random((9, 3))), np.log(rng.random(3)), np.array([1, 4, 2])
    tokens = rng.integers(0, 9, 7)
    got = hmm.mixture_shares(level, weight, tokens, length)
    for i, (a, n) in enumerate(zip(np.cumsum(length) - length, length, strict=True)):
        p = np.array([math.exp(weight[j] + sum(level[t, j] for t in tokens[a : a + n])) for j in range(3)])
        np.testing.assert_allclose(got[i], p / p.sum())


def test_no_frequent_word_is_left_out(spark, monkeypatch):
    """However many of them have their hashes in one range."""
    many = [f"w{i}" for i in range(120_000)]
    where = np.concatenate([ranges(hmm.word_keys(w), 64) for w in slices(pa.array([" ".join(many)], pa.large_string()))])
    chosen = [many[i] for i in np.flatnonzero(where == 0)[:1500]]
    assert len(chosen) == 1500 and not held_out(2)
    seen = []
    monkeypatch.setattr(hmm, "Model", lambda frequent, *rest: seen.append(len(frequent)) or Model(frequent, *rest))
    hmm_scores(spark.createDataFrame([(2, " ".join(chosen), "en", "s", 1, 1, "x")], SCHEMA)).collect()
    assert seen[0] == 1501  # and the end

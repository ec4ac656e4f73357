from collections import defaultdict

import numpy as np
import pytest

from corpusguard.llm import jaccard_join as module
from corpusguard.llm.jaccard_join import jaccard_join
from corpusguard.llm.partenum import bands, signatures
from tests.llm.fixtures import SCHEMA, rows, words


def brute(data, size=5):
    sets = []
    for doc, text, *_ in data:
        w = words(text, lower=True)
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((doc, s))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if a is not None and a == b:
                parent[root(i)] = root(j)
            elif a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)] = min(least[root(i)], a)
    return sorted((a, len(x), None if a is None else least[root(i)]) for i, (a, x) in enumerate(sets) if a is not None), [len(x) for a, x in sets if a is None]


@pytest.mark.parametrize("seed", [7, 8])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "CELL", 3)  # groups are verified in many cells
    data = rows(seed)
    got = jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()
    expected, unnamed = brute(data)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == expected
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(n, None) for n in unnamed]


def test_repeated_ids_with_other_texts(spark):
    """Each row of a doc_id signs, and all of them are in one component."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    pairs = [(1, a), (5, a), (5, b), (7, b + " more"), (9, a), (9, c), (10, c + " more"), (20, d), (20, d), (21, ""), (21, d + " more"), (30, None), (30, "x y"), (31, "x y"), (40, "")]
    data = [(i, t, "en", "s", 1, 1, "x") for i, t in pairs]
    got = jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)[0]
    assert {r.component_id for r in got if r.doc_id <= 10} == {1} and {r.component_id for r in got if r.doc_id in (20, 21)} == {20}
    # By texts alone, 7 goes with the other text of 5, not with 1.
    assert {(r.doc_id, r.text_component_id) for r in got if r.n_shingles and r.doc_id <= 10} == {(1, 1), (5, 1), (5, 5), (7, 5), (9, 1), (9, 9), (10, 9)}
    # Without the first two rows nothing holds 5 and 1 together.
    alone = jaccard_join(spark.createDataFrame(data[2:4], SCHEMA)).collect()
    assert {r.component_id for r in alone} == {5}


def test_random_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL", 3)
    data = [(r[0] if r[0] is None else r[0] % 97, *r[1:]) for r in rows(11)]
    got = jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()
    expected, unnamed = brute(data)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == expected
    assert len(unnamed) == sum(r.doc_id is None for r in got)


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    which = bands(4000)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        out = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not both or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        sig, owner = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), which)
        assert set(sig[owner == 0]) & set(sig[owner == 1])

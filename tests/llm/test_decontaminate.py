import random

import pytest

from corpusguard.llm import decontaminate as module
from corpusguard.llm.decontaminate import clean_documents, contained_items
from tests.llm.fixtures import SCHEMA, rows, words

ITEMS = "item_id long, text string, doc_id long, id long, h string"


def shingles(text, size=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def items(data, seed=1):
    rng = random.Random(seed)
    out = [(1, None, 0, 0, "x"), (2, "", 0, 0, "x"), (3, "end", 0, 0, "x"), (4, "End\t", 0, 0, "x"), (None, "end", 0, 0, "x")]
    for i in range(10, 60):
        w = words(rng.choice(data)[1])
        if w:
            at = rng.randrange(len(w))
            w = w[at : at + rng.choice([1, 5, 8, 20, 45])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w).upper(), 0, 0, "x"))
    return out


def brute(data, wanted):
    held = {}
    for doc, text, *_ in data:
        if doc is not None:
            held[doc] = held.get(doc, set()) | shingles(text)
    out = []
    for item, text, *_ in wanted:
        s = shingles(text)
        if item is not None and s:
            out += [(doc, item, len(s), len(s & x)) for doc, x in held.items() if 5 * len(s & x) >= 4 * len(s)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "limit"), [(7, None), (8, 0)])
def test_against_all_pairs(spark, seed, limit, monkeypatch):
    if limit is not None:  # the way without broadcasts
        monkeypatch.setattr(module, "BROADCAST_KEYS", limit)
    data = rows(seed)
    wanted = items(data, seed)
    docs, frame = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(wanted, ITEMS)
    expected = brute(data, wanted)
    assert expected
    assert sorted(tuple(r) for r in contained_items(docs, frame).collect()) == expected
    leaked = {d for d, *_ in expected}
    assert sorted(str(r.doc_id) for r in clean_documents(docs, frame).collect()) == sorted(str(d[0]) for d in data if d[0] not in leaked)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(rows(7), SCHEMA), spark.createDataFrame([], ITEMS)
    assert contained_items(docs, none).collect() == []
    assert contained_items(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert clean_documents(docs, none).count() == docs.count()


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = contained_items(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

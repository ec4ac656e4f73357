import re

import pytest

from corpusguard.llm.quality import learn_quality, quality_rules, train
from tests.llm.fixtures import SCHEMA, rows, words

LINES = ["a b\na b\n\n \na b", "x\r\nx\r\n", "\n\n", "a\nb\na\n a\na", "k " * 40 + "\n" + "k " * 40, "one two three four five six\none two three four five"]


def brute(text):
    w = words(text)
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeated = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


@pytest.mark.parametrize("seed", [7, 8])
def test_statistics(spark, seed):
    data = rows(seed) + [(50_000 + i, t, "en", "s", 1, 1, "x") for i, t in enumerate(LINES)]
    got = quality_rules(spark.createDataFrame(data, SCHEMA), None, carry=["kind", "block"]).collect()
    expected = sorted((str(d), *brute(t), not brute(t)[-1]) for d, t, *_ in data)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == expected
    assert all(r.kind == "x" and r.probability is None for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert learn_quality(docs, labels) is None
    assert quality_rules(docs, None).collect() == []


def test_one_label_only():
    model = train(["a b", "c d"], [1, 1])
    assert model is not None and model.offset > 0


def test_labelled_rows_that_training_did_not_see(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality_rules(docs, learn_quality(docs, seen)).join(unseen, "doc_id").where("not base_failed").select("kept", "quality", "probability").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)
    assert all(0 <= r.probability <= 1 for r in out)

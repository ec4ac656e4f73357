import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from corpusguard.llm.quality import learn_quality, quality_rules
from corpusguard.llm.queries import byte_bpe
from tests.llm.fixtures import SCHEMA, rows, words
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as similar
from tests.llm.test_substring_dedup import brute as repeated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    data = [r for r in rows(7, 160) if r[0] is None or r[0] < 10_000 or r[1] is None or len(r[1]) < 5000]
    docs = spark.createDataFrame(data, SCHEMA).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted({r[0] for r in data if r[0] is not None})
    labels = [(i, int(n % 5 != 0), 0) for n, i in enumerate(ids)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    picked = [words(r[1]) for r in data if len(words(r[1])) > 40]
    items = [(i, " ".join(w[5:30])) for i, w in enumerate(picked[::4])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, [tuple(r) for r in docs.collect()]
        if name != "bpe_encoding":
            assert docs.columns == COLUMNS

    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = quality_rules(first, learn_quality(first, spark.read.parquet(f"{tmp_path}/labels.parquet"))).where("kept").collect()
    before, after = seen["quality_rules"]
    assert 0 < len(after) < len(before) and sorted(str(r[0]) for r in after) == sorted(str(r.doc_id) for r in kept)
    assert set(after) <= set(before)

    before, after = seen["ngram_jaccard_join"]
    group = {doc: component for doc, _, component in similar(before)[0]}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] is None or group[r[0]] == r[0])

    before, after = seen["substring_dedup"]
    want = {(str(d), n, kept if gone else None) for d, n, gone, kept in repeated(before)}
    original = {str(r[0]): r[1] for r in before}
    got = {(str(r[0]), len(words(original[str(r[0])])), r[1] if r[1] != original[str(r[0])] else None) for r in after}
    assert got == want and all(r[4] == len(r[1]) for r in after)

    before, after = seen["benchmark_decontamination"]
    gone = {d for d, *_ in leaks(before, items)}
    assert gone and sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in gone)

    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(byte_bpe())
    before, after = seen["bpe_encoding"]
    want = []
    for doc, text, *_ in before:
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        want.append((str(doc), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), r[3], r[5], r[6]) for r in after) == sorted(want)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in whole) == sorted(str(r) for r in after)


def test_texts_of_repeated_ids_stay(spark):
    """A doc_id with two texts loses the one that a smaller document has, and no other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    data = [(1, a), (5, a), (5, b), (7, b + " more"), (8, c), (8, c), (9, a), (None, a), (10, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (5, b), (8, c), (8, c), (None, a), (10, ""), (5, None)]))


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choice("abcdefghijklmnop") * 4 for _ in range(60)), "en", "s", 240) for i in range(40)]
    tables = {
        "documents": (data, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, data[3][1])], "item_id long, text string"),
    }
    for name, (given, schema) in tables.items():
        spark.createDataFrame([] if name == empty else given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty == "documents":
        assert got == []
    elif empty == "labels":  # nothing to learn from: the rules alone decide
        assert {r.doc_id for r in got} == {i for i in range(40) if i != 3}
    else:
        assert got

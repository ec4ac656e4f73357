from collections import defaultdict

import pytest

from corpusguard.llm.substring_dedup import COVER, PERIOD, substring_dedup
from tests.llm.fixtures import SCHEMA, rows, words


def brute(data, window=13):
    first = defaultdict(lambda: 1 << 60)
    for doc, text, *_ in data:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                first[tuple(w[i : i + window])] = min(first[tuple(w[i : i + window])], doc)
    out = []
    for doc, text, *_ in data:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_the_cover_meets_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize(("seed", "window"), [(7, 13), (8, 13), (7, 7), (9, 20)])
def test_against_all_windows(spark, seed, window):
    data = rows(seed)
    got = substring_dedup(spark.createDataFrame(data, SCHEMA), window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data, window)


def test_carried_columns_and_empty_table(spark):
    data = rows(7)
    got = substring_dedup(spark.createDataFrame(data, SCHEMA), carry=["block", "kind", "lang"]).collect()
    assert sorted((str(r.doc_id), r.block, r.kind, str(r.lang)) for r in got) == sorted((str(r[0]), r[5], r[6], str(r[2])) for r in data)
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([], SCHEMA), 6)

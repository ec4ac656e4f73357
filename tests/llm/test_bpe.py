import hashlib
import random

import numpy as np
import pytest

from corpusguard.llm import bpe as module
from corpusguard.llm.bpe import bpe_decode, bpe_encode
from corpusguard.llm.queries import byte_bpe
from tests.llm.fixtures import SCHEMA, rows

ODD = [
    "<|endoftext|>",
    "a<|endoftext|>b <|endoftext|>",
    "it's we'll  I'd\t\tx\n\n\ny   ",
    "    a\u0085b",
    "日本語 テキスト 😀😀 é́ ՘౜ xᲀ",
    "''s''t '",
    "123abc456 ½ ٣",
    "\x1c\x1f x​﻿y",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(byte_bpe())


def test_against_the_library(spark, library):
    rng = random.Random(3)
    data = rows(7) + [(20_000 + i, t, "en", "s", 1, 1, "x") for i, t in enumerate(ODD)]
    data += [(30_000 + i, "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), 32, 39, 10])) for _ in range(60)), "en", "s", 1, 1, "x") for i in range(60)]
    encoded = bpe_encode(spark.createDataFrame(data, SCHEMA), byte_bpe(), carry=["block", "kind"], decode=True)
    got = encoded.collect()
    again = bpe_decode(encoded.drop("decoded"), byte_bpe()).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(r.doc_id), r.decoded) for r in got)
    assert all(np.array(r.ids, "<u4").tobytes() == bytes(r.ids_bytes) for r in got)
    expected = []
    for doc, text, *_ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((str(doc), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, hashlib.sha256(r.ids_bytes).hexdigest(), r.decoded) for r in got) == sorted(expected)
    assert all(r.kind == "x" for r in got)


def test_empty_table_and_unknown_ids(spark):
    assert bpe_encode(spark.createDataFrame([], SCHEMA), byte_bpe()).collect() == []
    given = spark.createDataFrame([([1 << 20, -1, None, 64], 1), (None, 2), ([], 3)], "ids array<int>, decoded int")
    assert [r.decoded for r in bpe_decode(given, byte_bpe()).collect()] == ["a", "", ""]


def test_bytes_that_are_no_utf8_decode_as_in_the_library(spark, library):
    rng = random.Random(5)
    runs = [[rng.randrange(256) for _ in range(rng.randrange(1, 8))] for _ in range(300)]  # ids below 256 are single bytes
    got = bpe_decode(spark.createDataFrame([(r,) for r in runs], "ids array<int>"), byte_bpe()).collect()
    assert [r.decoded for r in got] == [library.decode(r, skip_special_tokens=False) for r in runs]


@pytest.mark.parametrize(("size", "most"), [(1, 50_000), (300, 50_000), (1 << 20, 7)])
def test_small_blocks(spark, library, monkeypatch, size, most):
    monkeypatch.setattr(module, "BLOCK_BYTES", size)
    monkeypatch.setattr(module, "BLOCK_ROWS", most)
    data = rows(9, 60)
    got = bpe_encode(spark.createDataFrame(data, SCHEMA).repartition(3), byte_bpe(), decode=True).collect()
    want = [(str(d), library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, *_ in data]
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted(want)


def test_many_rows_without_text(spark):
    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, null, '') as text", "id as kind")
    out = bpe_encode(docs, byte_bpe(), carry=["kind"])
    assert out.count() == 5000 and out.select("kind").distinct().count() == 5000 and out.where("n_tokens > 0").count() == 0

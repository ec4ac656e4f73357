import gzip
import hashlib
import os
from base64 import b32encode

import pytest

from corpusguard.llm import warc as module
from corpusguard.llm.store import new_path
from corpusguard.llm.warc import read_warc, round_trip, write_warc

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
HTML = [None, "", "a", "a", "é😀", RECORD, RECORD * 3 + "WARC/1.1\r\n", "x\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "\r\n\r\n", "y" * 3000, "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", "a\n"]
SCHEMA = "page_id long, url string, html string, n int, digest string, first int"


def pages():
    out = [((i * 7) % 40, f"http://h/{i}", HTML[i % len(HTML)], 1, "x", 2) for i in range(40)]
    odd = [None, "u\r\nX: y", "http://" + "u" * 200_000, "http://h/" + "\n" * 60_000, " a%20b\t", "http://h/WARC/1.1", "a%0Ab", "", "\x0b", "é\u2028"]
    return out + [out[3], (None, None, "a", 1, "x", 2), (None, "u", "only nulls", 1, "x", 2)] + [(500 + i, u, f"z{i}", 1, "x", 2) for i, u in enumerate(odd)]


def brute(data):
    first = {}
    for page, _, html, *_ in data:
        if page is not None:
            first[html or ""] = min(first.get(html or "", 1 << 60), page)
    out = []
    for page, _, html, *_ in data:
        raw = (html or "").encode()
        again = (html or "") in first and first[html or ""] != page
        out.append((page, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("file_bytes", "split_bytes", "broadcast"), [(1 << 24, 1 << 22, 9), (1 << 24, 700, 1 << 20), (4000, 300, 9), (1, 61, 0)])
def test_round_trip(spark, file_bytes, split_bytes, broadcast, monkeypatch):
    """Also where splits end inside records, headers and magic strings."""
    monkeypatch.setattr(module, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(module, "BROADCAST_SPLITS", broadcast)
    data = pages() if split_bytes > 61 else pages()[:43]
    frame = spark.createDataFrame(data, SCHEMA).coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = round_trip(frame, new_path(spark, "warc"), payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(data)
    by_id = {p: h or "" for p, _, h, *_ in data}
    assert all(r.payload == by_id[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert sorted(str((r.page_id, r.url)) for r in got) == sorted(str((p, u)) for p, u, *_ in data)


def test_archives_are_whole_records(spark):
    path = new_path(spark, "warc")
    n = write_warc(spark.createDataFrame(pages(), SCHEMA).coalesce(1), path)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert n == len(pages()) and all(bytes(r.content).startswith(b"WARC/1.1\r\n") and bytes(r.content).endswith(b"\r\n\r\n") for r in rows)


def test_broken_archives_are_refused(spark):
    path = new_path(spark, "warc")
    spark.createDataFrame([("WARC/1.1\r\nContent-Length: 100\r\n\r\nshort",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError):
        read_warc(spark, path)


def test_splits_at_every_place(spark, monkeypatch, tmp_path):
    """A file whose splits begin at each byte in turn, with starts of the magic before it."""
    monkeypatch.setattr(module, "BROADCAST_SPLITS", 1 << 20)
    data = [(i, "u", h, 1, "x", 2) for i, h in enumerate(["WWARC/1.1\r\nWARC/1.1\r", "WARC/1.WARC/1.1\r\n", "W", ""])]
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame(data, SCHEMA).coalesce(1), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        for size in (89, 97, 113, 211):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_warc(spark, path, payload=True).collect()
            assert sorted((r.page_id, r.payload) for r in got) == [(i, h) for i, _, h, *_ in data]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_compressed_archives(spark):
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame(pages(), SCHEMA).coalesce(1), path)
    packed = new_path(spark, "warc")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    os.makedirs(packed.removeprefix("file://"))
    for i, r in enumerate(files):
        with gzip.open(f"{packed.removeprefix('file://')}/part-{i}.gz", "wb") as out:
            out.write(bytes(r.content))
    assert sorted(map(str, read_warc(spark, packed).collect())) == sorted(map(str, read_warc(spark, path).collect()))


def test_no_pages(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA), new_path(spark, "warc")).collect() == []

import json

from pyspark.sql import functions as F

from corpusguard.operators.detect import detect
from corpusguard.sources import files, sinks
from corpusguard.streaming import streams
from tests.test_scan import TOKEN


def test_text_files(spark, tmp_path):
    for name, data in (("a.txt", b"text"), ("b.bin", b"x\0y"), ("tests/c.txt", b"no"), ("d/e.txt", "é".encode()), ("big.txt", b"x" * 50)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    folder = f"file:{tmp_path}/in"
    got = {r.path.rpartition("/in/")[2]: r.text for r in files.text_files(spark, folder, most_bytes=20).collect()}
    assert got == {"a.txt": "text", "d/e.txt": "é"}
    assert files.listed(spark, folder, "*.txt").count() == 4


def test_log_records(spark):
    text = "noise\ncommit abc\nline 1\nline 2\ncommit def\ncommit 123\nx"
    rows = files.log_records(spark.createDataFrame([("l", text), ("m", None), ("n", "none")], "name string, text string"), r"commit ([0-9a-f]+)")
    assert sorted((r.record_no, r.record_id, r.body) for r in rows.collect()) == [(1, "abc", "line 1\nline 2\n"), (2, "def", ""), (3, "123", "x")]


def test_named_events(spark):
    lines = [
        {"type": "PushEvent", "repo": {"id": 5, "name": "o/n/m"}},
        {"type": "PushEvent", "repo": {"id": "6", "name": "o/x"}},
        {"type": "PushEvent", "repo": {"id": 7, "name": "plain"}},
        {"type": "PushEvent", "repo": {"id": None, "name": "o/y"}},
        {"type": "PushEvent", "repo": {"id": 8, "name": 9}},
        {"type": "Other", "repo": {"id": 5, "name": "o/n"}},
        {"type": "PushEvent"},
        [1],
    ]
    rows = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{broken",), (None,)], "value string")
    assert sorted(tuple(r) for r in files.named_events(rows).collect()) == [(5, "o", "n/m"), (6, "o", "x")]


def test_replay(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "id string, line int, value string")
    assert sorted(tuple(r) for r in files.replayed(rows, "id", "line").collect()) == [("a", 2, None), ("b", 1, "y")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    sinks.write_partitions(rows, f"{tmp_path}/t", ["k"])
    sinks.write_partitions(rows.where("k = 'b'").withColumn("v", F.lit(9)), f"{tmp_path}/t", ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1), ("b", 9)]
    for value in ({"b": 1, "a": "é"}, {"a": 2}):
        sinks.write_json_file(spark, value, f"file:{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 2} and (tmp_path / "m.json").stat().st_mode & 0o077 == 0


def test_scan_stream(spark, tmp_path):
    schema = "doc_id long, source string, text string"

    def put(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        docs = streams.arriving(spark, f"{tmp_path}/in", schema)
        write = lambda found, number: found.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        streams.scan_stream(docs, lambda d: detect(d, b"k", "2024-01-01"), write, f"{tmp_path}/checkpoint").awaitTermination(120)
        return sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put([(1, "s", f"key = {TOKEN}"), (2, "s", "nothing")])
    assert run() == [1]
    put([(3, "s", TOKEN)])
    assert run() == [1, 3] and run() == [1, 3]


def test_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/e")
    batch = spark.read.parquet(f"{tmp_path}/e")
    want = streams.windowed_counts(batch).agg(F.sum("n")).first()[0]
    stream = streams.windowed_counts(streams.arriving(spark, f"{tmp_path}/e", batch.schema.simpleString()[7:-1].replace(":", " ")))
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == want == batch.count()

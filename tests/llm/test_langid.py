from pyspark.sql import functions as F

from corpusguard.llm.langid import identify, language_id, remainder, train
from tests.llm.fixtures import SCHEMA, rows


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where(remainder(3) == 1)
    n, right, sure, sure_right = out.agg(
        F.count(F.lit(1)), F.count_if(F.expr("lang = lang_pred")), F.count_if("accepted"), F.count_if(F.expr("accepted and lang = lang_pred"))
    ).first()
    assert right >= 0.97 * n
    assert sure >= 0.8 * n and sure_right >= 0.98 * sure
    assert out.where("score < 0 or score > 1").count() == 0


def test_awkward_rows(spark):
    data = [*rows(7), (60_000, "12 34 !!", "en", "s", 1, 1, "x")]
    model = train(["the cat sat on the mat", "der hund ist nicht hier"] * 20, ["en", "de"] * 20)
    got = identify(spark.createDataFrame(data, SCHEMA), model, carry=["kind", "lang"]).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    for i in (10_000, 10_001, 10_002, 60_000):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) == ("und", 0.0, False)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words", None, "s", 1, 1, "x")], SCHEMA)
    assert [r.lang_pred for r in language_id(unlabelled).collect()] == ["und"]

"""The queries of this package, by name; their SQL is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm import decontaminate, url_filter
from corpusguard.llm.bpe import bpe_encode
from corpusguard.llm.hmm import hmm_scores
from corpusguard.llm.html_extract import extract_text
from corpusguard.llm.jaccard_join import jaccard_join
from corpusguard.llm.langid import language_id, remainder
from corpusguard.llm.quality import learn_quality, quality_rules
from corpusguard.llm.store import new_path
from corpusguard.llm.substring_dedup import substring_dedup
from corpusguard.llm.warc import round_trip


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(documents(spark, sf_dir))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def byte_bpe() -> str:
    """The JSON of the public tokenizer that the queries use."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(documents(spark, sf_dir), byte_bpe(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")).drop("url")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_extract": op4_html_extract,
    "op5_hmm": op5_hmm,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
}

"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
works on every row that the one before it left. All but the last return the
columns of ``documents``. Between stages the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm.bpe import bpe_encode
from corpusguard.llm.decontaminate import clean_documents
from corpusguard.llm.jaccard_join import jaccard_join, set_table
from corpusguard.llm.quality import learn_quality, quality_rules
from corpusguard.llm.queries import byte_bpe
from corpusguard.llm.store import BROADCAST_KEYS, stored
from corpusguard.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the classifier reject go. The classifier
    learns from the labelled rows among ``docs``."""
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = [c for c in docs.columns if c != "doc_id"]
    return quality_rules(docs, model, carry=rest).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts those of the smallest doc_id stay. A doc_id
    that repeats with other texts loses only the texts that a smaller one has."""
    linked = stored(jaccard_join(docs).where("set_hash is not null and text_component_id is not null"), "linked")
    goes = F.col("doc_id") != F.col("text_component_id")
    by_id = stored(linked.groupBy("doc_id").agg(F.max(goes).alias("some"), F.min(goes).alias("every")).where("some"), "gone")
    gone, mixed = by_id.where("every").select("doc_id"), by_id.where("not every").select("doc_id")
    small, n_mixed = gone.count() <= BROADCAST_KEYS, mixed.count()
    left = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    if not n_mixed:
        return left.select(*docs.columns)
    mixed = F.broadcast(mixed) if n_mixed <= BROADCAST_KEYS else mixed
    parts = set_table(left.join(mixed, "doc_id", "left_semi"), carry=docs.columns)
    parts = parts.join(linked.where(goes).select("doc_id", "set_hash").distinct(), ["doc_id", "set_hash"], "left_anti")
    return left.join(mixed, "doc_id", "left_anti").select(*docs.columns).unionAll(parts.select(*[F.col("given")[c].alias(c) for c in docs.columns]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has go. A text that loses words is
    its other words joined by a space; all others stay as they are. A document
    that loses every word stays, with an empty text."""
    rest = [c for c in docs.columns if c != "doc_id"]
    out = substring_dedup(docs, carry=rest)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids (as little-endian 32-bit
    integers) and of the text that they decode to."""
    out = bpe_encode(docs, byte_bpe(), carry=["lang", "source"], decode=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe_encoding", tokens),
]

#: The first stage's classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

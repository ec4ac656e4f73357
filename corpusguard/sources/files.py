"""Files that the operator holds, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.operators.paths import is_excluded

# Sizes beyond which a file, or a commit log, is not read.
MOST_FILE_BYTES = 100 << 20
MOST_MAIL_BYTES = 256_000


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, length, modificationTime)`` of all files below a folder, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).drop("content")


def text_files(spark: SparkSession, folder: str, glob: str = "*", most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """``(path, text)`` of the text files below a folder, without excluded paths,
    larger files, and binary ones, which hold a zero byte. Bytes that are no UTF-8
    are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    inside = F.when(F.startswith("path", F.lit(folder)), F.substring("path", len(folder) + 1, 1 << 30)).otherwise(F.col("path"))
    kept = files.where((F.col("length") <= most_bytes) & ~is_excluded(inside))
    text = kept.where(F.expr("position(X'00', content) = 0"))
    return text.select("path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def log_records(logs: DataFrame, header: str, text: str = "text") -> DataFrame:
    """One row per record of a log: a line that the header pattern matches begins a
    record, and the lines to the next one belong to it. Lines before the first
    header go. ``header`` must have one group, the record's id."""
    parts = F.split(F.col(text), f"(?m)(?=^{header}$)")
    cut = logs.where(F.col(text).isNotNull()).select(*[c for c in logs.columns if c != text], F.posexplode(parts).alias("record_no", "_part"))
    head = F.regexp_extract("_part", f"(?m)\\A{header}$", 1)
    out = cut.where(F.col("_part").rlike(f"(?m)\\A{header}$"))
    return out.withColumn("record_id", head).withColumn("body", F.regexp_replace("_part", r"\A[^\n]*\n?", "")).drop("_part")


def named_events(lines: DataFrame, kind: str = "PushEvent", column: str = "value") -> DataFrame:
    """``(source_id, owner, name)`` of JSON lines of one type whose ``repo`` has a name
    with a slash and an id. Lines that are no such objects are passed over."""
    value = F.expr(f"try_parse_json(`{column}`)")

    def part(path: str, as_type: str) -> Column:
        return F.try_variant_get(F.col("_json"), path, as_type)

    kinds = [F.schema_of_variant(part(p, "variant")) for p in ("$.repo.name", "$.repo.id")]
    rows = lines.withColumn("_json", value).where(F.col("_json").isNotNull())
    rows = rows.where((part("$.type", "string") == kind) & (kinds[0] == "STRING") & kinds[1].rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"))
    named = rows.select(part("$.repo.id", "string").alias("id"), part("$.repo.name", "string").alias("full")).where(F.contains("full", F.lit("/")))
    at = F.instr("full", "/")
    return named.select(F.expr("try_cast(id as bigint)").alias("source_id"), F.substring(F.col("full"), F.lit(1), at - 1).alias("owner"), F.substring(F.col("full"), at + 1, F.length("full")).alias("name"))


def replayed(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in lines.columns if c != key]
    best = lines.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*lines.columns)

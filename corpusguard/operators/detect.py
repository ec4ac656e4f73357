"""Detection and redaction as table operators.

Rows that cannot hold any token are told apart in the JVM, by one native pattern
that every rule's matches contain; only the others reach Python, in Arrow
batches. A matched value never becomes a column: findings carry a keyed
fingerprint of it (HMAC-SHA256 with the operator's key), which groups equal
values and cannot be turned back.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.operators import findings
from corpusguard.operators.rules import chosen, ruleset_version
from corpusguard.operators.scan import redact, scan_text

FINDING = (
    "doc_id long, source string, rule_id string, span_start int, span_end int, line_no int, context_name string, "
    "fingerprint string, value_len int, origin string, seen_in array<string>, triage string, first_seen timestamp, ruleset_version string"
)
#: Every token of every rule holds a run of this or one of the markers: of the rules
#: whose shortest tokens are shorter (Slack's, signed JSON), of the key headers, and
#: of key files. A test makes the shortest match of each rule.
POSSIBLE = r"[A-Za-z0-9_+/%=.:-]{17,}|xox[baprs]-|eyJ|PRIVATE KEY|service_account"


def may_hold_tokens(text: Column) -> Column:
    return F.coalesce(text.rlike(POSSIBLE), F.lit(False))


def fingerprint(value: str, key: bytes) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()


def detect(docs: DataFrame, key: bytes, as_of: str, origin: str = "path", rule_ids: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` → findings, one row per span.

    ``as_of``: the time that findings are first seen. Null and empty texts have
    none. Columns beside the three are ignored.
    """
    chosen(rule_ids)
    version = ruleset_version()
    rows = docs.where(may_hold_tokens(F.col("text"))).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    names = [("doc_id", pa.int64()), ("source", pa.string()), ("rule_id", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())]
    names += [("line_no", pa.int32()), ("context_name", pa.string()), ("fingerprint", pa.string()), ("value_len", pa.int32())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in scan_text(text, rule_ids):
                    out.append((doc, source, s.rule_id, s.start, s.end, s.line, s.context, fingerprint(text[s.start : s.end], key), s.end - s.start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), names, strict=True)], [n for n, _ in names])

    found = rows.mapInArrow(find, ", ".join(f.strip() for f in FINDING.split(",")[: len(names)]))
    return found.select(
        "*",
        F.lit(origin).alias("origin"),
        F.array(F.col("doc_id").cast("string")).alias("seen_in"),
        F.lit("unknown").alias("triage"),
        F.lit(as_of).cast("timestamp").alias("first_seen"),
        F.lit(version).alias("ruleset_version"),
    )


def _redacting(rule_ids: list[str] | None):
    def replaced(texts: pd.Series) -> pd.DataFrame:
        found = [scan_text(text, rule_ids) if text is not None else [] for text in texts]
        return pd.DataFrame({"text": [redact(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)], "n": [len(spans) for spans in found]})

    return F.pandas_udf(replaced, "struct<text: string, n: int>")


def redact_texts(docs: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """``docs`` with ``text`` redacted and ``n_redacted``, the number of spans.
    Texts without tokens, null ones too, stay as they are: only texts that may hold
    a token are sent to Python, of the other rows nothing."""
    chosen(rule_ids)
    kept = [c for c in docs.columns if c not in ("text", "n_redacted")]
    rows = docs.select(*kept, "text", F.when(may_hold_tokens(F.col("text")), F.col("text")).alias("_possible"))
    rows = rows.withColumn("_redacted", _redacting(rule_ids)("_possible"))
    return rows.select(*kept, F.coalesce(F.col("_redacted.text"), F.col("text")).alias("text"), F.coalesce(F.col("_redacted.n"), F.lit(0)).alias("n_redacted"))


def paired(rule_id: str) -> list[str]:
    """The rules that a rescan for one rule evaluates: the halves of a pair together."""
    pair = ["aws_access_key_id", "aws_secret_access_key"]
    return pair if rule_id in pair else [rule_id]


def rescan(existing: DataFrame, rows: DataFrame, source_id: int, rule_id: str, key: bytes, as_of: str) -> DataFrame:
    """Findings after one source was scanned anew for one rule, from its start and
    whatever the ledger says: new places are merged and the triage of the rule's
    findings is reset. The ledger stays as it is: this is no coverage of the source.

    ``rows(source_id, path, origin, seq_id, arrival, text)``; ``existing`` has the
    columns that ``findings.merge`` takes, and keeps its other sources.
    """
    rule_ids = paired(rule_id)
    own = rows.where(F.col("source_id") == source_id)
    found = detect(own.select(F.col("arrival").alias("doc_id"), F.col("source_id").alias("source"), "text"), key, as_of, rule_ids=rule_ids)
    found = found.select(F.col("doc_id").alias("arrival"), "rule_id", "fingerprint", "line_no", "context_name", "triage")
    found = own.select("source_id", "path", "origin", "seq_id", "arrival").join(found, "arrival")
    hit = (F.col("source_id") == source_id) & F.col("rule_id").isin(rule_ids)
    merged = findings.merge(existing, found)
    return merged.withColumn("triage", F.when(hit, "unknown").otherwise(F.col("triage")))

"""Functions for SQL: ``register(spark)``, then ``SELECT redact(text) ...``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusguard.functions.fingerprints import normalized, simhash64
from corpusguard.operators.scan import redact, scan_text

SPANS = "array<struct<rule_id: string, start: int, end: int, line_no: int, context_name: string>>"


def _detect_spans(texts: pd.Series) -> pd.Series:
    """Spans of sensitive tokens, without their values; null for null."""
    return pd.Series([[(s.rule_id, s.start, s.end, s.line, s.context) for s in scan_text(t)] if t is not None else None for t in texts])


def _redact(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t, scan_text(t)) if t is not None else None for t in texts])


def _simhash64(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash64(normalized("", t)) if t is not None else None for t in texts], dtype="Int64")


def register(spark: SparkSession) -> None:
    """``detect_spans(text)``, ``redact(text)`` and ``simhash64(text)``."""
    for name, function, kind in (("detect_spans", _detect_spans, SPANS), ("redact", _redact, "string"), ("simhash64", _simhash64, "long")):
        spark.udf.register(name, F.pandas_udf(function, kind))

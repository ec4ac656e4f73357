"""Paths that are not scanned, and labels of diff sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tests and fixtures, build output, vendored code and lock files.
EXCLUDED_PATHS = [
    r"(^|/)(tests?|__tests__|specs?|e2e|fixtures?|__fixtures__|__mocks__|testdata)(/|$)",
    r"\.(test|spec|e2e)\.[cm]?[jt]sx?$",
    r"(^|/)test_[^/]+\.py$",
    r"(^|/)[^/]+_test\.(go|py)$",
    r"(^|/)(dist|build|out|\.next|vendor|node_modules)(/|$)",
    r"\.min\.[cm]?[jt]sx?$",
    r"(^|/)swagger-ui[^/]*\.(js|css)$",
    r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|npm-shrinkwrap\.json|composer\.lock|Gemfile\.lock|Cargo\.lock|poetry\.lock|Pipfile\.lock|go\.sum)$",
]
# The label of a diff, and what stands before a file's path in it.
DIFF, DIFF_PREFIX = "<commit-diff>", "<commit-diff>:"


def is_excluded(path: Column) -> Column:
    return path.rlike("(?i)" + "|".join(f"(?:{p})" for p in EXCLUDED_PATHS))


def is_diff_sourced(path: Column) -> Column:
    return (path == DIFF) | F.startswith(path, F.lit(DIFF_PREFIX))


def diff_path(path: Column) -> Column:
    """The file's path of a diff label; null for other paths and for the bare label."""
    return F.when(F.startswith(path, F.lit(DIFF_PREFIX)), F.substring(path, len(DIFF_PREFIX) + 1, F.length(path)))


def split_diff(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per file of a unified diff, with ``path`` and ``part``, the file's
    text after its header line. What stands before the first header goes; a diff
    without headers is one part under the bare label. Null texts give no rows."""
    parts = F.split(F.col(text), r"(?m)(?=^diff --git a/.+? b/.+$)")
    headed = r"^diff --git a/.+? b/(.+)"
    cut = df.where(F.col(text).isNotNull()).select("*", F.posexplode(parts).alias("part_no", "_part"), F.col(text).rlike("(?m)^diff --git a/.+? b/.+$").alias("_headed"))
    cut = cut.where(~F.col("_headed") | F.col("_part").rlike(headed))
    line = F.regexp_extract("_part", headed, 1)
    path = F.when(F.col("_headed"), F.concat(F.lit(DIFF_PREFIX), line)).otherwise(F.lit(DIFF))
    body = F.when(F.col("_headed"), F.regexp_replace("_part", r"^diff --git [^\n]*", "")).otherwise(F.col("_part"))
    return cut.select(*df.columns, F.when(F.col("_headed"), F.col("part_no")).otherwise(0).alias("part_no"), path.alias("path"), body.alias("part"))

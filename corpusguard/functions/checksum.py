"""Pinned tables: one value for a table's rows, whatever their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(n, part0, part1)``: the rows' number and sums of parts of their digests;
    a null counts as the empty text."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0)).alias(f"part{i}") for i in range(2)]
    return df.agg(F.count(F.lit(1)).alias("n"), *parts)


def require_checksum(df: DataFrame, columns: list[str], expected: tuple[int, int, int]) -> DataFrame:
    """The table, if it is the one that was pinned; else an error."""
    if (found := tuple(checksum(df, columns).first())) != tuple(expected):
        raise ValueError(f"the table has another checksum: {found}, not {tuple(expected)}")
    return df

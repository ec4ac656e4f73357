"""Fingerprints of messages: an exact one and a 64-bit simhash.

Case folding, compatibility normalisation and BLAKE2 have no built-in function, so
these run in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a shingle, and shingles that are looked at.
SHINGLE, MOST_SHINGLES = 3, 256


def normalized(subject: str | None, text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", f"{subject or ''}\n{text or ''}").casefold().split())


def shingles(content: str) -> list[str]:
    """Runs of three words, evenly thinned to 256; fewer words are one run."""
    words = re.findall(r"\w+", content)
    runs = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []
    if len(runs) > MOST_SHINGLES:
        step = (len(runs) - 1) / (MOST_SHINGLES - 1)
        runs = [runs[round(i * step)] for i in range(MOST_SHINGLES)]
    return runs


def simhash64(content: str) -> int:
    """A signed 64-bit simhash: each bit by majority over the distinct shingles'
    digests, ties to 0; 0 for a text without words."""
    runs = set(shingles(content))
    if not runs:
        return 0
    digests = b"".join(hashlib.blake2b(run.encode(), digest_size=8).digest() for run in runs)
    ones = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(runs), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(runs)).tobytes(), "big", signed=True)


def _fingerprints(subject: pd.Series, text: pd.Series) -> pd.DataFrame:
    content = [normalized(a, b) for a, b in zip(subject, text, strict=True)]
    return pd.DataFrame({"id": [hashlib.sha256(c.encode()).hexdigest() for c in content], "simhash": pd.Series([simhash64(c) for c in content], dtype="int64")})


def fingerprints(subject: Column, text: Column) -> Column:
    """A struct of ``id``, the exact fingerprint, and ``simhash``."""
    return F.pandas_udf(_fingerprints, "struct<id: string, simhash: long>")(subject, text)


def near(a: Column, b: Column, most: int = 3) -> Column:
    """Do two simhashes differ in at most ``most`` bits?"""
    return F.bit_count(a.bitwiseXOR(b)) <= most


def bands(simhash: Column) -> Column:
    """The four 16-bit bands: hashes that differ in at most 3 bits share one."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(simhash, 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(4)])

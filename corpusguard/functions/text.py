"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.operators.rules import ENTROPY_ABOVE, GENERIC_TOKEN, LEAST_DIGITS


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty text, null for null."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    bits = F.aggregate(parts, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(bits)


def generic_tokens(text: Column) -> Column:
    """Long alphanumeric runs with enough digits, as an array; entropy not looked at."""
    found = F.regexp_extract_all(text, F.lit(f"({GENERIC_TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")) >= LEAST_DIGITS)


def is_high_entropy(token: Column) -> Column:
    return entropy(token) > ENTROPY_ABOVE


def collapsed(text: Column, longest: int | None = None) -> Column:
    """White space (any Unicode) as single spaces, trimmed, cut to ``longest``."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return out if longest is None else F.substring(out, 1, longest)


def unicode_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?U)\w+)"), F.lit(1))


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""(https?://[^\s<>'"]+)"""), F.lit(1))


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL; null if there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_host_or_subdomain(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def json_strings(text: Column) -> Column:
    """The strings of a JSON array; anything that is no array is an empty one."""
    items = F.from_json(text, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def contains_text(column: Column, search: str) -> Column:
    """Case-insensitive contains, for ASCII letters only; ``%`` and ``_`` are plain."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(column, upper, lower), F.lit(search.translate(str.maketrans(upper, lower))))

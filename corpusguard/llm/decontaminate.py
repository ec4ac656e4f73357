"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document that contains at least ``num/den`` of the item's
distinct shingles, however long the document is. Items are partitioned by size
(powers of two). All items of a partition with at most ``u`` shingles are sketched
by their ``floor((1 - num/den) * u) + 1`` smallest shingle hashes: a document that
contains ``num/den`` of an item lacks at most ``floor((1 - num/den) * u)`` of its
shingles, so it holds one of the sketch. Documents are sketched by the hashes that
are no larger than the largest sketched one, and a match on a hash fetches the
(document, item) pair. No containing document is missed. Pairs are then verified
by exact containment on the shingles themselves.

Everything is built-in functions: documents are cut into words, their shingles
generated and hashed, and matched, within one stage of generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.llm.store import BROADCAST_KEYS, keep_keys, stored

#: Fixed value: the white space between words.
SPACE = "[\\x20\\x09-\\x0D]+"
ENDS = " \t\n\u000b\f\r"


def _shingles(df: DataFrame, size: int) -> DataFrame:
    """``df(id, text)`` → one row ``(id, shingle, h)`` per window of ``size`` words;
    with fewer words, one row for the whole sequence; without words, none."""
    text = F.trim(F.lower("text"), F.lit(ENDS))
    cut = df.where("id is not null").select("id", F.split(text, SPACE).alias("words"), text.alias("trimmed")).where("trimmed <> ''").drop("trimmed")
    place = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(size), F.lit(0)))).alias("place")
    shingle = F.array_join(F.slice("words", F.col("place") + 1, size), " ")
    return cut.select("id", "words", place).select("id", shingle.alias("shingle")).withColumn("h", F.xxhash64("shingle"))


def _sent(df: DataFrame, n: int) -> DataFrame:
    """Broadcast up to ``BROADCAST_KEYS`` rows; beyond that the join is shuffled."""
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)`` →
    ``(doc_id, item_id, n_item, n_shared)`` for each document that contains at
    least ``num/den`` of the item's ``n_item`` distinct shingles.

    Texts are lower-cased. An item with fewer words than ``size`` is one shingle
    of its whole sequence, and so is such a document; they meet only each other.
    Null, empty or wordless texts, and null ids, are in no pair. Rows with the
    same id are one document or item of all their shingles. Other columns are
    ignored. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    wanted = stored(_shingles(items.select(F.col("item_id").alias("id"), "text"), size).distinct(), "items")
    sizes = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("n_item"))
    part = F.floor(F.log2("n_item")).cast("int")
    parts = sizes.groupBy(part.alias("part")).agg(F.max("n_item").alias("most"))
    keep = F.floor((den - num) * F.col("most") / F.lit(den)) + 1
    ranked = wanted.select("id", "h", F.row_number().over(Window.partitionBy("id").orderBy("h")).alias("rank"))
    sketch = ranked.join(sizes, "id").withColumn("part", part).join(F.broadcast(parts), "part").where(F.col("rank") <= keep)
    sketch = stored(sketch.select(F.col("id").alias("item_id"), "h"), "sketch")
    n_sketch, largest = sketch.agg(F.count(F.lit(1)), F.max("h")).first()

    found = _shingles(docs, size).select("id", "h").where(F.col("h") <= F.lit(largest)).join(_sent(sketch, n_sketch), "h")
    pairs = stored(found.select("id", "item_id").distinct(), "pairs")
    n_pairs = pairs.count()

    # Exact: the distinct shingles of the item that the document has.
    again = keep_keys(docs, pairs.select("id").distinct(), "id", n_pairs)
    own = wanted.select(F.col("id").alias("item_id"), "shingle", "h")
    both = _shingles(again, size).join(_sent(own, wanted.count()), ["h", "shingle"]).join(_sent(pairs, n_pairs), ["id", "item_id"])
    shared = both.select("id", "item_id", "h", "shingle").distinct().groupBy("id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    out = shared.join(F.broadcast(sizes) if n_sketch <= BROADCAST_KEYS else sizes, shared["item_id"] == sizes["id"]).where(F.lit(den) * F.col("n_shared") >= F.lit(num) * F.col("n_item"))
    return out.select(shared["id"].alias("doc_id"), "item_id", "n_item", "n_shared")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    leaked = stored(contained_items(docs, items, size, num, den).select("doc_id").distinct(), "leaked")
    n = leaked.count()
    return docs.join(F.broadcast(leaked) if n <= BROADCAST_KEYS else leaked, "doc_id", "left_anti").select(*docs.columns)




ORACLE = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
),
placed AS (SELECT kind, id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS place FROM cut WHERE len(w) > 0),
shingles AS (SELECT DISTINCT kind, id, array_to_string(w[place:place + 4], ' ') AS shingle FROM placed),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(s.n_item AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared
FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.shingle = i.shingle JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id, s.n_item
HAVING 5 * count(*) >= 4 * s.n_item
"""

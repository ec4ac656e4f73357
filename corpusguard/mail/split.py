"""Splits that leak nothing: near-duplicate clusters, one message of each, by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions.fingerprints import bands, near
from corpusguard.operators.graph import components
from corpusguard.tables import stored

# Sources by split, and the size under which the test split grows.
TEST_SOURCES = ("nazario-2024", "nazario-2025", "phishing-pot", "trec05", "trec06")
VALIDATION_SOURCES = ("nazario-2022", "nazario-2023")
SPAMASSASSIN_HARD = "spamassassin-hard_ham"
SPAMASSASSIN_BY_SPLIT = {"spamassassin-easy_ham": "train", "spamassassin-easy_ham_2": "validation", "spamassassin-hard_ham": "test"}
SMALL_TEST = 50_000
SPLITS = ("test", "validation", "train")


def split_of(source: Column, trec07_in_test: bool = False, spamassassin_only: bool = False) -> Column:
    """The split of a source: by the table of the policy, then by its family."""
    table = dict.fromkeys(TEST_SOURCES, "test") | dict.fromkeys(VALIDATION_SOURCES, "validation")
    table["trec07"] = "test" if trec07_in_test else "train"
    family = "validation"
    if spamassassin_only:
        table |= SPAMASSASSIN_BY_SPLIT
    elif trec07_in_test:
        table[SPAMASSASSIN_HARD] = "validation"
        family = "train"
    listed = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, source), F.when(F.startswith(source, F.lit("spamassassin-")), family), F.lit("train"))


def year_of(source: Column) -> Column:
    return (
        F.when(F.startswith(source, F.lit("nazario-20")), F.right(source, F.lit(4)))
        .when(F.startswith(source, F.lit("trec0")), F.concat(F.lit("20"), F.right(source, F.lit(2))))
        .when(F.startswith(source, F.lit("spamassassin-")), "2003")
        .otherwise("unknown")
    )


def clusters(messages: DataFrame) -> DataFrame:
    """Adds ``cluster`` to rows with ``(id, simhash, source, source_id, label)``:
    equal ids are together, and so are simhashes that differ in at most 3 bits.

    Distinct simhashes are compared, not rows, so copies cost nothing; they share a
    16-bit band whose remaining bits' count of ones differs by at most 3, which
    spreads large bands. Rows of one id carry one simhash.
    """
    hashes = stored(messages.select("simhash").distinct(), "hashes")
    ones = F.bit_count("simhash")
    left = hashes.select("simhash", F.explode(bands(F.col("simhash"))).alias("at"), ones.alias("ones"))
    # A partner has -3 .. 3 ones more; the smaller side looks ahead.
    ahead = left.select("simhash", "at", F.explode(F.sequence(F.col("ones"), F.col("ones") + 3)).alias("ones"))
    pairs = ahead.join(left.select(F.col("simhash").alias("other"), "at", "ones"), ["at", "ones"])
    edges = pairs.where((F.col("simhash") != F.col("other")) & near(F.col("simhash"), F.col("other")))
    found = components(edges.select(F.col("simhash").alias("a"), F.col("other").alias("b")).distinct())
    out = messages.join(found, messages["simhash"] == found["node"], "left")
    return out.select(*messages.columns, F.coalesce("component", "simhash").alias("cluster"))


def choose_unique(clustered: DataFrame, trec07_in_test: bool = False, spamassassin_only: bool = False) -> DataFrame:
    """One row per cluster of one label, the least by (split, source, source_id), with
    ``split``; clusters of several labels go whole."""
    split = split_of(F.col("source"), trec07_in_test, spamassassin_only)
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)
    rows = clustered.withColumn("split", split).withColumn("_rank", F.struct(rank, "source", "source_id"))
    best = rows.groupBy("cluster").agg(
        F.min("label").alias("_least"), F.max("label").alias("_most"), F.min_by(F.struct(*[c for c in rows.columns if c != "_rank"]), "_rank").alias("row")
    )
    return best.where(F.col("_least") == F.col("_most")).select("row.*")


def exclusions(clustered: DataFrame) -> DataFrame:
    """``(reason, n)``: rows of clusters with several labels, and duplicates."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    reason = F.when(F.col("a") != F.col("b"), "conflicting_label").otherwise("duplicate")
    lost = F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(F.col("n") - 1)
    return sizes.select(reason.alias("reason"), lost.alias("n")).where("n > 0").groupBy("reason").agg(F.sum("n").alias("n"))


def prepare(messages: DataFrame, small_test: int = SMALL_TEST) -> tuple[DataFrame, str]:
    """``prepare_clustered`` without the clustered rows."""
    return prepare_clustered(messages, small_test)[:2]


def prepare_clustered(messages: DataFrame, small_test: int = SMALL_TEST) -> tuple[DataFrame, str, DataFrame]:
    """Splits messages; returns the kept rows, the name of the policy, and the
    clustered rows. With a small test split, and the source at hand, one source
    moves from training to test."""
    has = messages.agg(
        F.count_if(F.startswith("source", F.lit("trec"))), F.count_if(F.startswith("source", F.lit("spamassassin-"))), F.count_if(F.col("source") == "trec07")
    ).first()
    only = has[0] == 0 and has[1] > 0
    clustered = stored(clusters(messages), "clusters")
    kept = choose_unique(clustered, False, only)
    if has[2] and kept.where("split = 'test'").count() < small_test:
        return choose_unique(clustered, True, only), "trec07_in_test", clustered
    return kept, "spamassassin_only" if only else "trec07_in_train", clustered


def kept_order(kept: DataFrame) -> DataFrame:
    """Rows by split (test, validation, train), source and id."""
    return kept.orderBy(F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split")), "source", "id")


def manifest(messages: DataFrame, kept: DataFrame, lost: DataFrame, policy: str, seed: int) -> DataFrame:
    """One row: the policy and the counts by source, by split and by reason of loss.
    The ids of a split are a table by themselves: their number has no bound."""

    def counts(df: DataFrame, key: str, name: str, n: Column) -> DataFrame:
        by = df.groupBy(key).agg(n.alias("n"))
        return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    one = F.count(F.lit(1))
    out = counts(messages, "source", "source_counts", one).join(counts(kept, "split", "split_counts", one)).join(counts(lost, "reason", "excluded", F.sum("n")))
    return out.select(F.lit(seed).alias("seed"), F.lit(policy).alias("split_policy"), "source_counts", "split_counts", "excluded")

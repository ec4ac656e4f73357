"""Merging, searching and counting findings.

``seen_in`` is ordered by arrival, so an explicit arrival number decides instead
of the order in which rows happen to come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions.text import contains_text

# What a person can say about a finding.
TRIAGE = ("unknown", "valid", "invalid", "failed")

KEY = ("source_id", "rule_id", "fingerprint")
PLACE = ("path", "origin", "line_no", "context_name", "seq_id")


def merge(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """One row per source, rule and fingerprint.

    Both tables have the columns of ``KEY``, ``PLACE``, ``arrival`` and ``triage``;
    ``existing`` may hold one row per place seen. The place is the first one found
    in a file, or the first one at all if all are from diffs; an existing place is
    only ever given up for a file. ``seen_in``: sequence ids by first arrival.
    """
    columns = [*KEY, *PLACE, "arrival", "triage"]
    rows = existing.select(*columns, F.lit(0).alias("_new")).unionByName(arriving.select(*columns, F.lit(1).alias("_new")))
    rank = F.struct(F.when(F.col("origin") == "path", 0).otherwise(1).alias("o"), F.col("_new"), F.col("arrival"))
    seen = rows.where("seq_id is not null").groupBy(*KEY, "seq_id").agg(F.min(F.struct("_new", "arrival")).alias("first"))
    seen = seen.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "seq_id"))), lambda x: x["seq_id"]).alias("seen_in"))
    places = rows.groupBy(*KEY).agg(F.min_by(F.struct(*PLACE), rank).alias("place"), F.min_by("triage", F.struct("_new", "arrival")).alias("triage"))
    out = places.join(seen, list(KEY), "left")
    return out.select(*KEY, *[F.col("place")[c].alias(c) for c in PLACE], F.coalesce("seen_in", F.array().cast("array<string>")).alias("seen_in"), "triage")


def matching(df: DataFrame, **wanted: list | None) -> DataFrame:
    """Rows whose columns are in the lists given; None or an empty list is no filter."""
    for column, values in wanted.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def searched(df: DataFrame, search: str | None, owner: str = "owner", name: str = "name", others: tuple[str, ...] = ("path", "context_name")) -> DataFrame:
    """Rows in which the text occurs. With a slash its halves are looked for in owner
    and name; ASCII case is ignored and no character is a wildcard."""
    if not search:
        return df
    anywhere: Column = F.lit(False)
    for column in others:
        anywhere = anywhere | F.coalesce(contains_text(F.col(column), search), F.lit(False))
    left, slash, right = search.partition("/")
    if slash:
        named = contains_text(F.col(owner), left) & contains_text(F.col(name), right)
    else:
        named = contains_text(F.col(owner), search) | contains_text(F.col(name), search)
    return df.where(anywhere | F.coalesce(named, F.lit(False)))


def in_scope(df: DataFrame, grants: DataFrame, owner: str = "owner", name: str = "name") -> DataFrame:
    """Rows of the owners and names that an approved grant names, whatever the case.
    No grants: no rows. To be applied before any other filter."""
    approved = grants.where("status = 'approved'").select(F.lower("owner").alias("_owner"), F.lower("name").alias("_name")).distinct()
    return df.join(approved, (F.lower(df[owner]) == F.col("_owner")) & (F.lower(df[name]) == F.col("_name")), "left_semi")


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; ``order`` must end in a unique column. A top-k plan, no full sort."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def counted(df: DataFrame, column: str, domain: list[str] | tuple[str, ...]) -> DataFrame:
    """``(position, value, n)`` for every value of a small domain, in its order, 0 if none."""
    values = df.sparkSession.createDataFrame(list(enumerate(domain)), "position int, value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, "value", "left").select("position", "value", F.coalesce("n", F.lit(0)).alias("n"))


def options(df: DataFrame, key: str, names: list[str], status: str, known: tuple[str, ...], otherwise: str) -> DataFrame:
    """One row per key: the smallest of each name, the total, and a count for each
    known status; every other status, null too, counts as ``otherwise``."""
    shown = [s for s in known if s != otherwise]
    rest = ~F.coalesce(F.col(status).isin(shown), F.lit(False))
    counts = [F.count_if(F.col(status) == s).alias(f"{s}_count") for s in shown]
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in names], F.count(F.lit(1)).alias("count"), *counts, F.count_if(rest).alias(f"{otherwise}_count"))


def facets(df: DataFrame, selected: dict[str, list]) -> DataFrame:
    """``(facet, value, n)``: for each facet the counts by value under the selections
    of all the others, its own ignored. One pass: rows are first counted by all
    facets together, and only those counts are filtered."""
    cube = df.groupBy(*selected).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for facet in selected:
        others = {k: v for k, v in selected.items() if k != facet}
        one = matching(cube, **others).groupBy(F.col(facet).cast("string").alias("value")).agg(F.sum("n").alias("n"))
        one = one.select(F.lit(facet).alias("facet"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def set_triage(df: DataFrame, triage: str, ids: list[int]) -> DataFrame:
    """Findings with the triage that a person gave; ``unknown`` clears when and why."""
    if triage not in TRIAGE:
        raise ValueError(f"unknown triage: {triage}")
    hit = F.col("id").isin(ids)
    clear = hit & F.lit(triage == "unknown")
    return df.withColumns(
        {
            "triage": F.when(hit, triage).otherwise(F.col("triage")),
            "checked_at": F.when(~clear, F.col("checked_at")),
            "reason": F.when(~clear, F.col("reason")),
        }
    )


def reset_triage(df: DataFrame, source_id: int, rule_ids: list[str]) -> DataFrame:
    hit = (F.col("source_id") == source_id) & F.col("rule_id").isin(rule_ids)
    return df.withColumns({"triage": F.when(hit, "unknown").otherwise(F.col("triage")), "checked_at": F.when(~hit, F.col("checked_at")), "reason": F.when(~hit, F.col("reason"))})


def failed_from_unknown(df: DataFrame) -> DataFrame:
    """Unknown findings that were checked, or have a reason, have failed."""
    hit = (F.col("triage") == "unknown") & (F.col("checked_at").isNotNull() | (F.length(F.coalesce("reason", F.lit(""))) > 0))
    return df.withColumn("triage", F.when(hit, "failed").otherwise(F.col("triage")))


def sorted_view(df: DataFrame, by: str, descending: bool = False, unique: str = "source_id") -> DataFrame:
    """A table as a person sorts it: names without regard to case, descending the
    exact reverse of ascending, ties included, and nulls last when descending."""
    kind = dict(df.dtypes)[by]
    key = F.lower(by) if kind == "string" else F.col(by)
    return df.orderBy(key.desc_nulls_last(), F.desc(unique)) if descending else df.orderBy(key.asc_nulls_first(), F.asc(unique))


def out_of_place(rows: DataFrame, frozen: DataFrame, position: str = "position", key: str = "id") -> DataFrame:
    """Positions at which rows and a frozen list of ids differ, or that one of them
    lacks; no rows if they agree."""
    a, b = rows.select(position, F.col(key).alias("found")), frozen.select(position, F.col(key).alias("expected"))
    return a.join(b, position, "full").where(~F.col("found").eqNullSafe(F.col("expected")))


def with_counts(df: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``df`` with the numbers that ``counts`` has for its key, 0 for keys without any."""
    numbers = [c for c in counts.columns if c != key]
    return df.join(counts, key, "left").select(*df.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def pending(rows: DataFrame, results: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Rows without a result; a result that ``failed`` holds for is none."""
    good = results if failed is None else results.where(~F.coalesce(failed, F.lit(False)))
    return rows.join(good.select(key).distinct(), key, "left_anti")


def orphans(results: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose keys the corpus does not have; nulls equal nulls."""
    a, b = results.alias("a"), corpus.select(*keys).distinct().alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return a.join(b, condition, "left_anti").select(*results.columns)


def require_no_orphans(results: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """The results, if the corpus has the keys of all of them; else an error that names one."""
    if lost := orphans(results, corpus, keys).select(*keys).limit(1).collect():
        raise ValueError(f"a saved result is not in the corpus: {lost[0].asDict()}")
    return results


def first_source_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``(id, ...)``: of the rows of a key the first by ``order``; a null key has none."""
    rest = [c for c in df.columns if c not in order]
    best = df.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("first"))
    return best.select("id", *[F.col("first")[c].alias(c) for c in (*order, *rest)])


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows that the seed chooses, whatever the order of the table: the first by
    a digest of seed and key. Too few rows are an error. A top-k plan."""
    chosen = page(df.withColumn("_rank", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)), [F.asc("_rank"), F.asc(key)], limit=n)
    if (found := chosen.count()) < n:
        raise ValueError(f"a sample of {n} was asked of {found} rows")
    return chosen.drop("_rank")

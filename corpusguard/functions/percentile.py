"""Percentiles by lower index, ``sorted(x)[int((n - 1) * fraction)]``, and medians.

``percentile`` interpolates and holds every distinct value of a group in one state,
and ``percentile_disc`` rounds up, so neither gives this. A first pass brackets each
wanted value per group by an approximate percentile of known rank error. A second
counts what lies below the brackets and orders only the distinct values inside them,
some thousandths of a group, so that no group is sorted or gathered whole. All
fractions share the passes. A bracket of very many distinct values is cut into
ranges by value, counted, and only the range that holds the rank is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.tables import stored

#: The approximate ranks are off by at most 1 / ACCURACY of a group's rows.
ACCURACY, MARGIN = 10_000, 0.0005
#: Groups of fewer rows are ordered whole: the margin would be a few ranks.
SMALL = 10_000


#: Ranges that a large bracket is cut into, and the distinct values that make it large.
RANGES, MOST_VALUES = 1000, 100_000


def lower_index(df: DataFrame, by: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """``(by..., name)``: one row per group that has a value; nulls are passed over."""
    return lower_indexes(df, by, value, {name: fraction}).select(*by, name)


def lower_indexes(df: DataFrame, by: list[str], value: str, fractions: dict[str, float], medians: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., n, names...)``: the value at each fraction's lower index, and under
    the names of ``medians`` the mean of the two middle values."""
    wanted = [(name, f, False) for name, f in fractions.items()]
    wanted += [(f"{name}_{side}", 0.5, upper) for name in medians for side, upper in (("low", False), ("high", True))]
    groups = by or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*by, *([] if by else [F.lit(1).alias("_all")]), F.col(value).alias("_value"))
    ends = F.array(*[F.lit(min(1.0, max(0.0, f + side * MARGIN))) for _, f, _ in wanted for side in (-1, 1)])
    bracket = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_value", ends, ACCURACY).alias("_ends"))

    def rank(f: float, upper: bool) -> Column:
        place = (F.col("n") - 1) * F.lit(f)
        return F.ceil(place) if upper else F.floor(place)

    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank(f, up).alias("rank"), F.col("_ends")[2 * i].alias("low"), F.col("_ends")[2 * i + 1].alias("high")) for i, (name, f, up) in enumerate(wanted)])
    bracket = bracket.select(*groups, "n", F.inline(asked))
    whole = F.col("n") < SMALL
    bracket = bracket.withColumns({"low": F.when(~whole, F.col("low")), "high": F.when(~whole, F.col("high"))})
    # A row counts once for each wanted value that it is below, or in the bracket of;
    # rows above all brackets of a group go in the join.
    placed = rows.join(F.broadcast(bracket), groups) if not by else rows.join(bracket, groups)
    placed = placed.where(F.col("high").isNull() | (F.col("_value") <= F.col("high")))
    key = [*groups, "name", "n", "rank"]
    inside = F.col("low").isNull() | (F.col("_value") >= F.col("low"))
    counts = placed.groupBy(*key, F.when(inside, F.col("_value")).alias("_value")).agg(F.count(F.lit(1)).alias("_times"))
    below = counts.where("_value is null").select(*key, F.col("_times").alias("_below"))
    counts = _narrowed(stored(counts, "counts").where("_value is not null").join(below, key, "left").withColumn("_below", F.coalesce("_below", F.lit(0))), key)
    order = Window.partitionBy(*key).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_times").over(order) + F.col("_below"))
    found = upto.where(F.col("_upto") > F.col("rank")).groupBy(*groups, "n", "name").agg(F.min("_value").alias("_value"))
    out = found.groupBy(*groups, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name, _, _ in wanted])
    means = [((F.col(f"{m}_low") + F.col(f"{m}_high")) / 2).alias(m) for m in medians]
    return out.select(*by, "n", *fractions, *means)


def _narrowed(counts: DataFrame, key: list[str]) -> DataFrame:
    """The same, but of brackets with very many values only the range that holds the rank."""
    sizes = counts.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), F.min("_value").alias("_from"), F.max("_value").alias("_to"))
    sizes = stored(sizes.where(F.col("_size") > MOST_VALUES), "large-brackets")
    if sizes.isEmpty():
        return counts
    cut = counts.join(F.broadcast(sizes), key, "left")
    number = F.floor((F.col("_value") - F.col("_from")) / (F.col("_to") - F.col("_from")) * RANGES)
    cut = cut.withColumn("_range", F.when(F.col("_size").isNotNull(), number))
    sums = cut.where("_range is not null").groupBy(*key, "_below", "_range").agg(F.sum("_times").alias("_sum"))
    order = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0)) + F.col("_below"))
    holds = sums.where((F.col("_before") <= F.col("rank")) & (F.col("_before") + F.col("_sum") > F.col("rank")))
    kept = cut.drop("_below").join(F.broadcast(holds.select(*key, "_range", F.col("_before").alias("_below"))), [*key, "_range"])
    columns = [*key, "_value", "_times", "_below"]
    return cut.where("_range is null").select(*columns).unionByName(kept.select(*columns))

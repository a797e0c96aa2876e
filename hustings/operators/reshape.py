"""Reshaping, breakdowns and totals."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def vote_columns(df: DataFrame, metadata: set[str]) -> list[str]:
    """Every column that is not metadata is a vote column."""
    return [c for c in df.columns if c not in metadata]


def prefixed(df: DataFrame, columns: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in columns})


def ensure_columns(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Columns that must be there are added where they are not."""
    return df.select("*", *[F.lit(v).alias(c) for c, v in columns.items() if c not in df.columns])


def split_by(df: DataFrame, column: str, values: list) -> dict[object, DataFrame]:
    return {v: df.filter(F.col(column).eqNullSafe(F.lit(v))) for v in values}


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def remainder(df: DataFrame, parts: list[str], name: str, whole: float = 100) -> DataFrame:
    return df.withColumn(name, F.lit(whole) - reduce(lambda a, b: a + b, [F.col(p) for p in parts]))


def derived_wide(df: DataFrame, keys: list[str], columns: list[str], makers: dict[str, object]) -> DataFrame:
    """``{prefix}_{column}`` for every prefix and column in one select, however many there are."""
    return df.select(*keys, *[f(F.col(c)).alias(f"{p}_{c}") for p, f in makers.items() for c in columns])


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_totals(df: DataFrame, keys: list[str], sums: dict[str, Column], after: dict[str, Column], label: str = "Total") -> DataFrame:
    """Groups, their subtotals and the total by rollup; ratios come after, from the sums themselves. Totals are labelled in the key."""
    rolled = df.rollup(*keys).agg(F.grouping_id().alias("_level"), *[c.alias(n) for n, c in sums.items()])
    named = [F.when(F.col("_level").bitwiseAND(1 << (len(keys) - 1 - i)) != 0, label).otherwise(F.col(k).cast("string")).alias(k) for i, k in enumerate(keys)]
    return rolled.select(*named, *sums, *[c.alias(n) for n, c in after.items()])


def shares_wide(df: DataFrame, keys: list[str], category: str, values: list[str], digits: int = 2) -> DataFrame:
    """Percent of a group's rows in each category, one column each in the given order; rows in other categories count in the whole."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(category) == v).alias(f"_{v}") for v in values])
    return counts.select(*keys, *[F.round(F.col(f"_{v}") / F.col("_n") * 100, digits).alias(v) for v in values])


def breakdown(df: DataFrame, category: str, measure: Column | None = None) -> DataFrame:
    """Rows (category, n, percent), and the measure's sum on request."""
    more = [F.sum(measure).alias("total")] if measure is not None else []
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), *more)
    whole = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).select(category, "n", *(["total"] if more else []), (F.col("n") / F.col("_all") * 100).alias("percent"))


def tally_over_domain(df: DataFrame, category: str, domain: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures for every value of the domain, 0 where no row has it."""
    spark = df.sparkSession
    values = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in domain])).alias(category))
    sums = df.groupBy(category).agg(*[c.alias(n) for n, c in measures.items()])
    return values.join(sums, category, "left").select(category, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures])


def area_balance(before: DataFrame, after: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Groups whose sums differ between two versions by more than the tolerance; a group that one lacks has 0 there."""
    sums = lambda d, n: d.groupBy(*keys).agg(F.sum(value).alias(n))
    joined = sums(before, "before").join(sums(after, "after"), keys, "full").fillna(0.0, ["before", "after"])
    return joined.withColumn("difference", F.col("after") - F.col("before")).filter(F.abs("difference") > tolerance)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows (key, change): added, removed or changed between two versions, by a fingerprint of all other columns."""
    columns = sorted(set(old.columns) - {key})
    mark = lambda d, n: d.select(key, F.xxhash64(*[F.col(c) for c in columns]).alias(n))
    joined = mark(old, "_old").join(mark(new, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return joined.select(key, change.alias("change")).filter("change is not null")


def natural_order(column: str) -> list[Column]:
    """Sort keys for codes of letters and digits: letters first, then the number."""
    return [F.regexp_extract(column, "^([A-Za-z]*)", 1), F.regexp_extract(column, "([0-9]+)$", 1).try_cast("long").asc_nulls_first()]


def top_row(df: DataFrame, keys: list[str], value: Column, order: Column, most: bool = True) -> DataFrame:
    """The row of each key with the largest (or smallest) value, ties by the least ``order``."""
    rank = F.struct((value if most else -value).alias("v"), (-order).alias("o"))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("_b"))
    return best.select("_b.*")

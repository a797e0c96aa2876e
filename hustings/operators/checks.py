"""Checks of keys, ids, dependencies and totals: each returns the rows that fail."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from hustings.operators.windows import gaps, stretched


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(lost)}")
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def broken_dependency(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys with more than one value in some column that should depend on the key, and how many each has."""
    counts = df.groupBy(key).agg(*[F.count_distinct(v).alias(f"n_{v}") for v in values])
    wrong = counts[f"n_{values[0]}"] > 1
    for v in values[1:]:
        wrong = wrong | (counts[f"n_{v}"] > 1)
    return counts.filter(wrong)


def id_problems(df: DataFrame, id_column: str, pattern: str) -> DataFrame:
    """Rows (id, problem) for ids "{group}{number}": bad format, repeated, or missing between 1 and the group's largest number."""
    read = df.select(F.col(id_column).alias("id"), F.regexp_extract(id_column, pattern, 1).alias("g"), F.regexp_extract(id_column, pattern, 2).try_cast("long").alias("k"))
    bad = read.filter(F.col("k").isNull()).select("id", F.lit("bad format").alias("problem"))
    good = read.filter(F.col("k").isNotNull())
    twice = good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("problem"))
    lost = stretched(gaps(good, "g", "k"), F.col("first"), F.col("last"), "k").select(F.concat("g", F.col("k").cast("string")).alias("id"), F.lit("missing").alias("problem"))
    return bad.unionByName(twice).unionByName(lost)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: rows, and for each check how many of them fail it."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in checks.items()])


def error_report(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Percent by which found sums are off the expected ones, largest first; keys without an expectation are left out."""
    joined = expected.join(found, key)
    return joined.withColumn("error_pct", F.round((F.col("found") - F.col("expected")) / F.col("expected") * 100, 1))

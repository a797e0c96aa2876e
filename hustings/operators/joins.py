"""Joins to rate tables, rosters and hierarchies, and reports on keys that find no partner."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: The 13 clusters of rate tables. Fixed values.
CLUSTERS = ("S", "A1", "A2", "B1", "B2", "C1", "C2", "D1", "D2", "E1", "E2", "F1", "F2")


class MissingRates(KeyError):
    """Keys of the base table without a rate."""


def left_join_nulls(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null meets null."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    joined = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]), "left")
    return joined.drop(*[f"_r_{c}" for c in on])


def missing_keys(base: DataFrame, other: DataFrame, on: list[str], other_on: list[str] | None = None) -> DataFrame:
    """The distinct keys of ``base`` that ``other`` lacks."""
    keys = other.select(*[F.col(o).alias(c) for c, o in zip(on, other_on or on, strict=True)]).distinct()
    return base.select(*on).distinct().join(keys, on, "left_anti")


def with_rates(
    base: DataFrame, rates: DataFrame, on: list[str], values: list[str], rate_on: list[str] | None = None, type_column: str | None = None, type_value: str | None = None, on_missing: str = "error", prefix: str = "rate_"
) -> DataFrame:
    """``base`` with the rate columns of its key, renamed by ``prefix``; optionally of the rows of one type.

    ``on_missing``: "error" raises MissingRates where a key has no rate, as one small anti join tells before; "raise" looks in the join itself, and the
    job that reads such a row fails; "zero" gives 0.
    """
    if type_column is not None and type_value is not None:
        rates = rates.filter(F.col(type_column) == type_value)
    keys = rate_on or on
    if on_missing == "error" and (lost := missing_keys(base, rates, on, keys).limit(20).collect()):
        raise MissingRates(f"no rate for {[r.asDict() for r in lost]}")
    slim = rates.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"{prefix}{v}") for v in values])
    if on_missing == "raise":
        joined = base.join(slim.withColumn("_hit", F.lit(True)), [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(on)], "left")
        lost = F.raise_error(F.concat(F.lit("no rate for "), F.to_json(F.struct(*on))))
        return joined.select(*base.columns, *[F.when(F.col("_hit").isNull(), lost).otherwise(F.col(f"{prefix}{v}")).alias(f"{prefix}{v}") for v in values])
    joined = base.join(slim, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(on)], "left").drop(*[f"_k{i}" for i in range(len(keys))])
    if on_missing != "zero":
        return joined
    return joined.select(*base.columns, *[F.coalesce(F.col(f"{prefix}{v}"), F.lit(0.0)).alias(f"{prefix}{v}") for v in values])


def apply_rates(base: DataFrame, rates: DataFrame, on: list[str], values: list[str], divide_by: float = 1.0, total: str | None = None, **how) -> DataFrame:
    """Each value column of ``base`` times its rate, divided; or their sum in one column ``total``."""
    joined = with_rates(base, rates, on, values, **how)
    made = {v: F.col(v) * F.col(f"rate_{v}") / divide_by for v in values}
    others = [c for c in base.columns if c not in values]
    if total is not None:
        return joined.select(*base.columns, reduce(lambda a, b: a + b, made.values()).alias(total))
    return joined.select(*others, *[c.alias(v) for v, c in made.items()])


def apply_combined_rates(base: DataFrame, specs: list[dict], values: list[str], divide_by: float = 1.0) -> DataFrame:
    """The rates of several tables added up, then multiplied once. A spec has ``rates``, ``on`` and what with_rates takes."""
    joined = base
    for i, spec in enumerate(specs):
        joined = with_rates(joined, values=values, prefix=f"rate{i}_", **spec)
    rate = lambda v: reduce(lambda a, b: a + b, [F.col(f"rate{i}_{v}") for i in range(len(specs))])
    return joined.select(*[c for c in base.columns if c not in values], *[(F.col(v) * rate(v) / divide_by).alias(v) for v in values])


def with_roster(roster: DataFrame, results: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Every row of the roster, with results where there are some and ``fill`` where not."""
    joined = roster.join(results, on, "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in joined.columns])


def fill_from(left: DataFrame, right: DataFrame, on: list[str], column: str, value: str) -> DataFrame:
    """``column`` of ``left``, where null, from ``value`` of ``right``."""
    slim = right.select(*on, F.col(value).alias("_value"))
    joined = left.join(slim, on, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col("_value")).alias(c) if c == column else F.col(c) for c in left.columns])


def count_unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: n_rows of ``left`` and how many of them find no key in ``right``."""
    marked = left.join(right.select(*on).distinct().withColumn("_there", F.lit(1)), on, "left")
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_there").isNull()).alias("n_unmatched"))


def members(units: DataFrame, tests: dict[str, object]) -> DataFrame:
    """The rows that are in all the named units: a district that spans constituencies is told by both columns."""
    return units.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in tests.items()], F.lit(True)))


def pick_by(side: Column, columns: dict[str, Column]) -> Column:
    """The column named by a side; blank is null."""
    out = None
    for name, c in columns.items():
        out = F.when(side == name, c) if out is None else out.when(side == name, c)
    return F.nullif(F.trim(out), F.lit(""))

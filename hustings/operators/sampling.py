"""Allocation of people to areas and cells, as one plan of row arithmetic on top of broadcast rates."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from hustings.functions.numbers import keyed_normal, keyed_uniform
from hustings.operators import joins
from hustings.operators.reconcile import clamp, gated_draw, reconcile


def capacity(seed: str, *keys: str, low: int, high: int) -> Column:
    """A whole number between low and high, each as likely."""
    return (F.lit(low) + F.floor(keyed_uniform(seed, *keys) * (high - low + 1))).cast("long")


def noisy(rows: DataFrame, mean: Column, sd_share: float, keys: list[str], name: str, seed: str = "noise") -> DataFrame:
    return rows.withColumn(name, F.greatest(F.lit(0.0), keyed_normal(seed, mean, mean * sd_share, *keys)))


def vote_chain(areas: DataFrame, key: str, people: list[str], rates: DataFrame, rate_on: list[str], seed: str = "chain") -> DataFrame:
    """Rows (key, cluster columns of electorate, turnout, spoilt and three sides' votes) for areas with people by cluster.

    Electorate: people by rate, drawn and gated to 45 to 97.5 % of the people, never above them. Turnout: 60 % of it, drawn, within it. Spoilt:
    1 % of turnout. Three sides: drawn around thirds of the valid votes and reconciled to sum to them. Every stage is of whole numbers, so the
    sums hold exactly; the plan has one broadcast join and no shuffle. A row is 15 draws or more: deal a table of few columns to tasks first (``shared.spread``).
    """
    based = joins.with_rates(areas, rates, rate_on, people, on_missing="zero")
    made = []
    for c in people:
        mean = F.col(c) * F.col(f"rate_{c}") / 100
        value, unresolved = gated_draw(seed, mean, mean * 0.1, [key, F.lit(c)], 0.45, 0.975, 5, F.col(c))
        made += [F.floor(clamp(value, F.col(c))).alias(f"electorate_{c}"), unresolved.alias(f"unresolved_{c}")]
    staged = based.select(*areas.columns, *made)
    staged = staged.select("*", *[F.floor(clamp(keyed_normal(f"{seed}-turnout", F.col(f"electorate_{c}") * 0.6, F.col(f"electorate_{c}") * 0.06, key, F.lit(c)), F.col(f"electorate_{c}"))).alias(f"turnout_{c}") for c in people])
    staged = staged.select("*", *[F.floor(F.col(f"turnout_{c}") * 0.01).alias(f"spoilt_{c}") for c in people])
    for c in people:
        valid = F.col(f"turnout_{c}") - F.col(f"spoilt_{c}")
        draws = [F.floor(clamp(keyed_normal(f"{seed}-{s}", valid / 3, valid * 0.05, key, F.lit(c)), valid)).cast("long") for s in ("L", "MR", "R")]
        staged = staged.withColumn(f"votes_{c}", reconcile(F.array(*draws), valid))
    return staged

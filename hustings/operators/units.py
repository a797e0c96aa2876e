"""Seats that are won unit by unit: a unit counts once all of its rows are declared."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from hustings.functions import status as st
from hustings.operators.methods import SIDES, first_preferences, plurality_leader


def unit_winners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, n_rows, Left, Right, MR, winner) of the units whose rows are all declared; a tie or no vote has no winner."""
    first = first_preferences()
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("status") == st.DECLARED).alias("_all"), *[F.sum(v).alias(s) for s, v in first.items()])
    return sums.filter("_all").drop("_all").withColumn("winner", plurality_leader({s: F.col(s) for s in SIDES}))


def council_totals(all_units: DataFrame, winners: DataFrame, council: str, unit: str) -> DataFrame:
    """For each council: its units, those declared and not, and units won by each side."""
    known = all_units.filter(F.col(council).isNotNull() & F.col(unit).isNotNull()).groupBy(council).agg(F.count_distinct(unit).alias("total_units"))
    won = winners.groupBy(council).agg(F.count(F.lit(1)).alias("declared_units"), *[F.count_if(F.col("winner") == s).alias(f"won_{s}") for s in SIDES])
    joined = known.join(won, council, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(council, "total_units", zero("declared_units").alias("declared_units"), F.greatest(F.lit(0), F.col("total_units") - zero("declared_units")).alias("undeclared_units"), *[zero(f"won_{s}").alias(f"won_{s}") for s in SIDES])


def units_by_party(winners: DataFrame, parties: DataFrame, on: list[str]) -> DataFrame:
    """Units won by each party: ``parties`` has (on, side, party), so that each place decides which party a side is."""
    named = winners.filter("winner is not null").join(parties.withColumnRenamed("side", "winner"), [*on, "winner"])
    return named.groupBy("party").agg(F.count(F.lit(1)).alias("units"))


def leader_and_second(rows: DataFrame, keys: list[str], name: str, count: str) -> DataFrame:
    """For each key the name with the most, its count and the next count (0 if none); ties by name."""
    place = Window.partitionBy(*keys).orderBy(F.col(count).desc(), F.col(name))
    ranked = rows.withColumn("_p", F.row_number().over(place)).filter("_p <= 2")
    first = lambda c, p: F.max(F.when(F.col("_p") == p, F.col(c)))
    return ranked.groupBy(*keys).agg(first(name, 1).alias("leader"), first(count, 1).alias("won"), F.coalesce(first(count, 2), F.lit(0)).alias("second"))

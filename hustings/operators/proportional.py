"""Seats in proportion to votes: quota and largest remainder, in two stages over lists and their parties."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from hustings.operators.tally import fully_declared, gated, safe_vote_bound


def largest_remainder(rows: DataFrame, keys: list[str], votes: str, quota: Column, seats: Column, unit: str, name: str = "seats") -> DataFrame:
    """``rows`` with seats: whole quotas, then one each to the largest remainders, ties by votes, then unit.

    ``keys`` name the contest, ``unit`` the candidate; ``quota`` and ``seats`` are constant in a contest. Without a quota or seats all get 0.
    """
    raw = F.col(votes) / quota
    able = (quota > 0) & (seats > 0)
    counted = rows.withColumn("_floor", F.when(able, F.floor(raw)).otherwise(0)).withColumn("_rest", F.when(able, raw - F.floor(raw)).otherwise(0.0))
    whole = Window.partitionBy(*keys)
    place = whole.orderBy(F.col("_rest").desc(), F.col(votes).desc(), F.col(unit))
    counted = counted.withColumn("_left", F.greatest(F.lit(0), seats - F.sum("_floor").over(whole))).withColumn("_place", F.row_number().over(place))
    return counted.select(*rows.columns, (F.col("_floor") + F.when(able & (F.col("_place") <= F.col("_left")), 1).otherwise(0)).cast("long").alias(name))


def two_stage_seats(votes: DataFrame, keys: list[str], total_seats: int | Column, threshold_pct: float = 15.0) -> DataFrame:
    """Rows (keys, list, party, votes) with the lists' and parties' seats.

    Lists pool their parties' votes and need ``threshold_pct`` of the valid votes; the quota is the qualifying votes over the seats. The seats
    of a list go to its parties by the list's own quota. A list that does not qualify, or has one party or no seat, gives each of its parties
    the list's seats. All windows are over a contest's lists and parties, which are few.
    """
    seats = F.lit(total_seats) if isinstance(total_seats, int) else total_seats
    lists = votes.groupBy(*keys, "list").agg(F.sum("votes").alias("list_votes"), F.count(F.lit(1)).alias("n_parties"))
    contest = Window.partitionBy(*keys)
    lists = lists.withColumn("valid", F.sum("list_votes").over(contest)).withColumn("qualified", F.col("list_votes") >= F.col("valid") * threshold_pct / 100)
    quota = F.sum(F.when(F.col("qualified"), F.col("list_votes")).otherwise(0)).over(contest) / seats
    lists = lists.withColumn("quota", quota).withColumn("_gated", F.when(F.col("qualified"), F.col("list_votes")).otherwise(0))
    # a list that does not qualify has no votes here, so no whole quota; it sorts after all that do
    lists = lists.withColumn("_key", F.concat(F.when(F.col("qualified"), "0").otherwise("1"), F.col("list")))
    placed = largest_remainder(lists, keys, "_gated", F.col("quota"), seats, "_key", "list_seats")
    placed = placed.withColumn("list_seats", F.when(F.col("qualified"), F.col("list_seats")).otherwise(F.lit(0)).cast("long"))
    parties = votes.join(placed.drop("_gated", "_key"), [*keys, "list"])
    inner = F.when(F.col("list_seats") > 0, F.col("list_votes") / F.col("list_seats")).otherwise(0.0)
    out = largest_remainder(parties, [*keys, "list"], "votes", inner, F.col("list_seats"), "party", "seats")
    plain = ~F.col("qualified") | (F.col("n_parties") <= 1) | (F.col("list_seats") == 0)
    return out.withColumn("seats", F.when(plain, F.col("list_seats")).otherwise(F.col("seats")))


def guaranteed_seats(votes: DataFrame, keys: list[str], bound: Column | str, total_seats: int | Column, threshold_pct: float = 15.0) -> DataFrame:
    """Rows (keys, list, party, votes, ...) with seats that no further declaration can take away.

    Gate and quota are taken on ``bound``, the valid votes there can be at most, and only whole quotas count. ``bound`` is constant in a contest.
    """
    seats = F.lit(total_seats) if isinstance(total_seats, int) else total_seats
    bound = F.col(bound) if isinstance(bound, str) else bound
    of_list = F.sum("votes").over(Window.partitionBy(*keys, "list"))
    qualified = (bound > 0) & (of_list >= bound * threshold_pct / 100)
    quota = F.when(seats > 0, bound / seats).otherwise(0.0)
    return votes.select("*", of_list.alias("list_votes"), qualified.alias("qualified"), F.when(qualified & (quota > 0), F.floor(F.col("votes") / quota)).otherwise(0).cast("long").alias("seats"))


def seats_so_far(rows: DataFrame, keys: list[str], parties: dict[str, tuple[str, Column]], total_seats: int, derived: DataFrame | None = None, threshold_pct: float = 15.0) -> DataFrame:
    """Rows (keys, list, party, votes, final, seats): final seats of a contest whose rows are all declared, else the seats that are certain.

    ``rows`` have status, Turnout and Electorate; ``parties`` gives the list and the votes of each party. Votes are those of declared rows.
    ``derived`` stands for a sector whose own row is blank: units that count as one vote for the party that wins them (keys, total_units,
    declared_units, won_{party}). The contest is final only when all of its units are declared too, and each unit is one valid vote at most.
    """
    valid = sum((v for _, v in parties.values()), F.lit(0))
    sums = rows.groupBy(*keys).agg(fully_declared().alias("final"), safe_vote_bound(valid).alias("bound"), *[F.coalesce(F.sum(gated(v)), F.lit(0)).alias(f"_v_{p}") for p, (_, v) in parties.items()])
    known = lambda c: F.coalesce(F.col(c), F.lit(0)) if derived is not None else F.lit(0)
    joined = sums.join(derived, keys, "left") if derived is not None else sums
    each = F.array(*[F.struct(F.lit(of).alias("list"), F.lit(p).alias("party"), (F.col(f"_v_{p}") + known(f"won_{p}")).alias("votes")) for p, (of, _) in parties.items()])
    final = F.col("final") & (known("declared_units") == known("total_units"))
    votes = joined.select(*keys, final.alias("final"), (F.col("bound") + known("total_units")).alias("bound"), F.inline(each))
    full = two_stage_seats(votes.drop("bound", "final"), keys, total_seats, threshold_pct).select(*keys, "party", F.col("seats").alias("_full"))
    sure = guaranteed_seats(votes, keys, "bound", total_seats, threshold_pct).withColumnRenamed("seats", "_sure")
    return sure.join(full, [*keys, "party"]).select(*keys, "list", "party", "votes", "final", F.when(F.col("final"), F.col("_full")).otherwise(F.col("_sure")).alias("seats"))

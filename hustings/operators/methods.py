"""Election methods on rows that hold a contest's sums: thousands of contests are one DataFrame, and each method is row arithmetic.

Ties between sides are broken in the order Left, Right, MR throughout.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

SIDES = ("Left", "Right", "MR")
#: Votes by first and second preference; a side twice means no second preference.
TRANSFERS = tuple(f"{a}_{b}" for a in SIDES for b in SIDES)


def first_preferences() -> dict[str, Column]:
    return {s: F.col(f"{s}_Left") + F.col(f"{s}_Right") + F.col(f"{s}_MR") for s in SIDES}


def ranked(votes: dict[str, Column]) -> Column:
    """An array of (votes, order, side), most votes first, ties in the given order."""
    return F.sort_array(F.array(*[F.struct(v.cast("double").alias("votes"), F.lit(-i).alias("o"), F.lit(s).alias("side")) for i, (s, v) in enumerate(votes.items())]), asc=False)


def plurality_leader(votes: dict[str, Column]) -> Column:
    """The side with most votes; null on a tie at the top or without votes."""
    r = ranked(votes)
    return F.when((r[0]["votes"] > 0) & (r[0]["votes"] > r[1]["votes"]), r[0]["side"])


def of_side(side: Column, values: dict[str, Column]) -> Column:
    out = None
    for s, v in values.items():
        out = F.when(side == s, v) if out is None else out.when(side == s, v)
    return out


def runoff_votes(eliminated: Column) -> dict[str, Column]:
    """Second-round votes of each side after a side is out: own first preferences and its transfers. Null for the side that is out."""
    first = first_preferences()
    return {s: F.when(eliminated != s, first[s] + of_side(eliminated, {e: F.col(f"{e}_{s}") for e in SIDES if e != s})) for s in SIDES}


def runoff(rows: DataFrame, eliminated: Column) -> DataFrame:
    """``rows`` with r2_Left, r2_Right, r2_MR (null for the side that is out), nil, winner (null on a tie) and tie."""
    votes = runoff_votes(eliminated)
    seconds = rows.select("*", *[v.alias(f"r2_{s}") for s, v in votes.items()], of_side(eliminated, {e: F.col(f"{e}_{e}") for e in SIDES}).alias("nil"))
    most = F.greatest(*[F.col(f"r2_{s}") for s in SIDES])
    least = F.least(*[F.col(f"r2_{s}") for s in SIDES])
    winner = F.when(most > least, F.coalesce(*[F.when(F.col(f"r2_{s}") == most, s) for s in SIDES]))
    return seconds.select("*", winner.alias("winner"), (most == least).alias("tie"))


def supplementary_vote(sums: DataFrame) -> DataFrame:
    """``sums`` with r1_* (first preferences), valid, majority_winner, eliminated, r2_*, nil, winner and tie.

    More than half of the valid votes wins at once. Else the side with the fewest is out, its second preferences go to the two that are left,
    and the one with more wins; equal second rounds have no winner. Nothing is eliminated and no second round there is after a majority.
    """
    first = first_preferences()
    rows = sums.select("*", *[v.alias(f"r1_{s}") for s, v in first.items()])
    r1 = {s: F.col(f"r1_{s}") for s in SIDES}
    rows = rows.withColumn("valid", r1["Left"] + r1["Right"] + r1["MR"])
    rows = rows.withColumn("majority_winner", F.coalesce(*[F.when((F.col("valid") > 0) & (2 * v > F.col("valid")), s) for s, v in r1.items()]))
    fewest = F.least(*r1.values())
    rows = rows.withColumn("eliminated", F.when(F.col("majority_winner").isNull(), F.coalesce(*[F.when(v == fewest, s) for s, v in r1.items()])))
    done = runoff(rows, F.col("eliminated"))
    return done.withColumns({"winner": F.coalesce("majority_winner", "winner"), "tie": F.coalesce("tie", F.lit(False))})


def hypothetical_runoffs(sums: DataFrame) -> DataFrame:
    """Three rows a contest, one for each side that might be out."""
    return runoff(sums.withColumn("eliminated", F.explode(F.array(*[F.lit(s) for s in SIDES]))), F.col("eliminated"))


def with_certainty(sv: DataFrame, undecided: str = "undecided") -> DataFrame:
    """A supplementary vote's rows with what is certain while ``undecided`` votes are still to come.

    stage: round1-majority when the first leads the others together by more than the pool; uncertain until a runoff is unavoidable and its pair
    settled (the second leads the third by more than the pool); then runoff-winner when the pair's lead is more than the pool, else
    runoff-pending. Also result_certain, certain_winner, runoff_certain, participants_certain and certain_out.
    """
    r = ranked({s: F.col(f"r1_{s}") for s in SIDES})
    u = F.greatest(F.lit(0), F.coalesce(F.col(undecided), F.lit(0)))
    rows = sv.withColumn("_r", r).withColumn("_u", u)
    first, second, third = (F.col("_r")[i] for i in range(3))
    majority = first["votes"] - (second["votes"] + third["votes"]) > F.col("_u")
    unavoidable = second["votes"] + third["votes"] - first["votes"] >= F.col("_u")
    pair = second["votes"] - third["votes"] > F.col("_u")
    in_second = lambda side: F.coalesce(of_side(side, {s: F.col(f"r2_{s}") for s in SIDES}), F.lit(0))
    lead = in_second(first["side"]) - in_second(second["side"])
    settled = F.abs(lead) > F.col("_u")
    stage = F.when(majority, "round1-majority").when(~(unavoidable & pair), "uncertain").when(settled, "runoff-winner").otherwise("runoff-pending")
    rows = rows.withColumn("stage", stage)
    winner = F.when(F.col("stage") == "round1-majority", first["side"]).when(F.col("stage") == "runoff-winner", F.when(lead >= 0, first["side"]).otherwise(second["side"]))
    later = F.col("stage") != "round1-majority"
    return rows.select(
        *sv.columns,
        "stage",
        F.col("stage").isin("round1-majority", "runoff-winner").alias("result_certain"),
        winner.alias("certain_winner"),
        (later & unavoidable).alias("runoff_certain"),
        (later & pair).alias("participants_certain"),
        F.when(later & pair, third["side"]).alias("certain_out"),
    )


def leading_side() -> Column:
    """Shown as the leader: the winner once a majority or the pair is certain, until then who has most first preferences."""
    settled = (F.col("stage") == "round1-majority") | F.col("participants_certain")
    return F.when(settled, F.col("winner")).otherwise(plurality_leader({s: F.col(f"r1_{s}") for s in SIDES}))


def share_for(side: Column) -> Column:
    """The share behind a side: of the second round where there was one, else of the first."""
    second = F.coalesce(F.col("r2_Left"), F.lit(0)) + F.coalesce(F.col("r2_Right"), F.lit(0)) + F.coalesce(F.col("r2_MR"), F.lit(0))
    in_second = F.coalesce(of_side(side, {s: F.col(f"r2_{s}") for s in SIDES}), F.lit(0))
    in_first = of_side(side, {s: F.col(f"r1_{s}") for s in SIDES})
    return F.when(F.col("eliminated").isNotNull(), F.when(second > 0, in_second / second)).otherwise(F.when(F.col("valid") > 0, in_first / F.col("valid")))


def spoil_shares() -> tuple[Column, Column]:
    """Percent spoilt in the first round, and spoilt or exhausted in the second (null where there was none)."""
    first = F.col("valid") + F.col("Spoil")
    lost = F.col("Spoil") + F.coalesce(F.col("nil"), F.lit(0))
    second = F.coalesce(F.col("r2_Left"), F.lit(0)) + F.coalesce(F.col("r2_Right"), F.lit(0)) + F.coalesce(F.col("r2_MR"), F.lit(0)) + lost
    return F.when(first > 0, F.col("Spoil") / first * 100).otherwise(0.0), F.when(F.col("eliminated").isNotNull(), F.when(second > 0, lost / second * 100).otherwise(0.0))


def round_label() -> Column:
    return F.when(F.col("stage") == "round1-majority", "No Runoff Needed").when(~F.col("runoff_certain"), "Runoff Uncertain").when(~F.col("participants_certain"), "Runoff Needed").otherwise("Runoff In Progress")


def winner_label() -> Column:
    return F.when(F.col("result_certain"), "Winner Decided").otherwise("Winner Undecided")


def margin_safe(won: Column, second: Column, remaining: Column, leader: Column) -> tuple[Column, Column]:
    """(margin, final): a leader in units won is final when none remain or fewer than the margin."""
    margin = won - second
    left = F.greatest(F.lit(0), remaining)
    return margin, leader.isNotNull() & ((left == 0) | (left < margin))

"""Tallies as of a moment: what counts from a row depends on its status, which a parameter ``now`` decides."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from hustings.functions import status as st
from hustings.functions.numbers import percent
from hustings.operators.methods import SIDES, TRANSFERS


def with_status(rows: DataFrame, now: str | Column, column: str = "status") -> DataFrame:
    return rows.withColumn(column, st.status(now))


def gated(votes: Column | str, state: str = "status", least: str = st.DECLARED) -> Column:
    """A row's votes where its status is far enough, else null: not known is not 0."""
    return F.when(st.at_least(state, least), F.col(votes) if isinstance(votes, str) else votes)


def sum_gated(votes: str, state: str = "status", least: str = st.DECLARED) -> Column:
    return F.coalesce(F.sum(gated(votes, state, least)), F.lit(0))


def percent_declared(electorate: str = "Electorate", state: str = "status") -> Column:
    """Share of the electorate, not of the rows, whose rows are declared."""
    return percent(F.sum(F.when(F.col(state) == st.DECLARED, F.col(electorate)).otherwise(0)), F.sum(electorate))


def undecided_pool(state: str = "status") -> Column:
    """Votes still to come at most: none from declared rows, the turnout of counting ones, the electorate of all others."""
    return F.sum(F.when(F.col(state) == st.DECLARED, 0).when(F.col(state) == st.COUNTING, F.col("Turnout")).otherwise(F.col("Electorate")))


def safe_vote_bound(valid: Column, state: str = "status") -> Column:
    """Valid votes there can be at most: those of declared rows, the turnout of counting ones, the electorate of all others."""
    return F.sum(F.when(F.col(state) == st.DECLARED, valid).when(F.col(state) == st.COUNTING, F.col("Turnout")).otherwise(F.col("Electorate")))


def fully_declared(state: str = "status") -> Column:
    return F.bool_and(F.col(state) == st.DECLARED)


def status_summary(rows: DataFrame, keys: list[str], electorate: str = "Electorate", state: str = "status") -> DataFrame:
    """Rows, electorate and share of it for each status, for each key; one shuffle for all four."""
    names = {s: s.lower().replace(" ", "_") for s in st.STATUSES}
    sums = [f(s).alias(f"{part}_{n}") for s, n in names.items() for part, f in (("n", lambda s: F.count_if(F.col(state) == s)), ("e", lambda s: F.sum(F.when(F.col(state) == s, F.col(electorate)).otherwise(0))))]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(electorate).alias("electorate"), *sums)
    return out.select("*", *[percent(F.col(f"e_{n}"), F.col("electorate")).alias(f"pct_{n}") for n in names.values()])


def dominant_status() -> Column:
    """A unit's status from a status summary: declared when all is, counting when something is counted or declared."""
    return F.when(F.col("pct_declared") >= 100, st.DECLARED).when((F.col("n_counting") > 0) | (F.col("pct_declared") > 0), st.COUNTING).when(F.col("n_verifying") > 0, st.VERIFYING).otherwise(st.NOT_RECEIVED)


def sums_of_seat() -> list[Column]:
    """The sums that a seat's summary needs from its rows: transfers and spoils of declared rows, known turnout, electorate, pool."""
    declared = F.when(F.col("status") == st.DECLARED, F.col("Electorate")).otherwise(0)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("status") == st.DECLARED).alias("n_declared"),
        F.sum("Electorate").alias("Electorate"),
        F.sum(gated("Turnout", least=st.COUNTING)).alias("Turnout"),
        sum_gated("Spoil").alias("Spoil"),
        *[sum_gated(c).alias(c) for c in TRANSFERS],
        undecided_pool().alias("undecided"),
        F.sum(declared).alias("_declared"),
    ]


def _with_percent(sums: DataFrame) -> DataFrame:
    return sums.withColumn("percent_declared", percent(F.col("_declared"), F.col("Electorate"))).drop("_declared")


def seat_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All that a seat's summary needs from its rows, by one aggregate (:func:`sums_of_seat`), and the percent declared."""
    return _with_percent(rows.groupBy(*keys).agg(*sums_of_seat()))


def sums_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The same as :func:`seat_sums` from sums of smaller places, so that several levels of places need one pass over the rows."""
    names = ["n_rows", "n_declared", "Electorate", "Turnout", "Spoil", *TRANSFERS, "undecided", "_declared"]
    return _with_percent(sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]))


def yes_no_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Referendum sums for each key: yes and no from declared rows, turnout from counting ones on, electorate from all."""
    out = rows.groupBy(*keys).agg(sum_gated("Yes_Votes").alias("yes"), sum_gated("No_Votes").alias("no"), F.sum("Electorate").alias("electorate"), F.sum(gated("Turnout", least=st.COUNTING)).alias("turnout"), percent_declared().alias("percent_declared"))
    return out.select("*", (F.col("yes") + F.col("no")).alias("valid"), percent(F.col("yes"), F.col("yes") + F.col("no")).alias("yes_percent"), percent(F.col("no"), F.col("yes") + F.col("no")).alias("no_percent"))


def referendum_label(yes: Column, no: Column, electorate: Column, declared: Column) -> Column:
    """Decided once the lead is more than the electorate that has not declared."""
    remaining = F.greatest(F.lit(0.0), electorate * (1 - declared / 100))
    decided = (yes + no > 0) & (F.abs(yes - no) > remaining)
    return F.when(decided & (yes > no), "Agree").when(decided, "Disagree").otherwise("In Progress")


def votes_by_side(rows: DataFrame, keys: list[str], declared_only: bool = True) -> DataFrame:
    """Rows (keys, side, votes) of first preferences; zeros are left out."""
    rows = rows.filter(F.col("status") == st.DECLARED) if declared_only else rows
    first = [(F.col(f"{s}_Left") + F.col(f"{s}_Right") + F.col(f"{s}_MR")).alias(s) for s in SIDES]
    long = rows.select(*keys, *first).unpivot(keys, list(SIDES), "side", "votes")
    return long.groupBy(*keys, "side").agg(F.sum("votes").alias("votes")).filter("votes <> 0")


def share_of_total(rows: DataFrame, keys: list[str], votes: str, name: str = "share") -> DataFrame:
    whole = F.sum(votes).over(Window.partitionBy(*keys))
    return rows.withColumn(name, F.when(whole > 0, F.col(votes) / whole).otherwise(0.0))


def transition_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, event_time, to_status) for the moments of each row that are known."""
    made = F.array(*[F.struct(F.col(c).alias("event_time"), F.lit(s).alias("to_status")) for c, s in (("received_at", st.VERIFYING), ("verified_at", st.COUNTING), ("declared_at", st.DECLARED))])
    return rows.select(*keys, F.inline(made)).filter("event_time is not null")


def timeline(rows: DataFrame, votes: list[str], moment: str = "declared_at") -> DataFrame:
    """After each moment with a declaration: the running sums of votes and the share of the electorate that has declared.

    Rows are added up by moment, and the moments by month, before any running sum; the running sum of a month is over its own moments only,
    and that over months has a row for each, so no window sees the rows.
    """
    sums = rows.filter(F.col(moment).isNotNull()).groupBy(F.col(moment).alias("moment")).agg(*[F.sum(v).alias(v) for v in [*votes, "Electorate"]])
    sums = sums.withColumn("_month", F.date_trunc("month", "moment"))
    names = [*votes, "Electorate"]
    months = sums.groupBy("_month").agg(*[F.sum(n).alias(f"_m_{n}") for n in names])
    before = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("_month", *[F.coalesce(F.sum(f"_m_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    inside = Window.partitionBy("_month").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.agg(F.sum("Electorate").alias("_all"))
    running = sums.join(months, "_month").select("moment", *[(F.col(f"_b_{n}") + F.sum(n).over(inside)).alias(n) for n in names])
    return running.crossJoin(F.broadcast(whole)).select("moment", *votes, percent(F.col("Electorate"), F.col("_all")).alias("percent_declared"))


def as_of(rows: DataFrame, moments: list[str], keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """``measures`` for each key at each of a few moments, in one pass: a row is looked at once a moment, then summed in part at once."""
    each = rows.withColumn("as_of", F.explode(F.array(*[F.lit(m).cast("timestamp") for m in moments])))
    return with_status(each, F.col("as_of")).groupBy("as_of", *keys).agg(*[c.alias(n) for n, c in measures.items()])


def beyond_checkpoints(rows: DataFrame, column: str, checkpoints: list[str]) -> DataFrame:
    """Rows (checkpoint, n_after): how many rows have a later moment than each checkpoint."""
    counts = rows.agg(*[F.count_if(F.col(column) > F.lit(c).cast("timestamp")).alias(f"n{i}") for i, c in enumerate(checkpoints)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.col(f"n{i}").alias("n_after")) for i, c in enumerate(checkpoints)])))


def quality_report(tables: dict[str, DataFrame], checks: dict[str, Column]) -> DataFrame:
    """Rows (source, n_rows, one count of failures for each check)."""
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in checks.items()]).select(F.lit(name).alias("source"), "*") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)

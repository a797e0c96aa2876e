"""Queries of the tally family: status, sums as of a moment, methods, certainty, units, referendum."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.functions import status as st
from hustings.functions.numbers import percent
from hustings.operators import joins, methods, tally, units
from hustings.operators.methods import SIDES, TRANSFERS
from hustings.plans.adapters import NOW_LATE, NOW_MID, located, precinct, result, sql, status_sql
from hustings.plans.registry import query

MID, LATE = f"TIMESTAMP '{NOW_MID}'", f"TIMESTAMP '{NOW_LATE}'"
STATUS_MID = f"st AS (SELECT *, {status_sql(MID)} AS status FROM located)"
STATUS_LATE = f"st AS (SELECT *, {status_sql(LATE)} AS status FROM located)"
LONG = lambda c, n: f"CAST({c} AS BIGINT) AS {n}"


def mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.with_status(located(spark, sf_dir), NOW_MID)


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.with_status(located(spark, sf_dir), NOW_LATE)


# The sums of a seat and the supplementary vote in SQL, shared by several queries.
def sums_sql(key: str, source: str = "st") -> str:
    gated = ", ".join(LONG(f"coalesce(sum({c}) FILTER (status = 'Declared'), 0)", c) for c in (*TRANSFERS, "Spoil"))
    return f"""sums AS (SELECT {key}, count(*) AS n_rows, count(*) FILTER (status = 'Declared') AS n_declared, {LONG('sum(Electorate)', 'Electorate')},
      {LONG("sum(Turnout) FILTER (status IN ('Declared', 'Counting'))", 'Turnout')}, {gated},
      CASE WHEN sum(Electorate) > 0 THEN coalesce(sum(Electorate) FILTER (status = 'Declared'), 0) / sum(Electorate) * 100 ELSE 0 END AS percent_declared,
      {LONG("sum(CASE status WHEN 'Declared' THEN 0 WHEN 'Counting' THEN Turnout ELSE Electorate END)", 'undecided')} FROM {source} GROUP BY {key})"""


R1 = {s: f"({s}_Left + {s}_Right + {s}_MR)" for s in SIDES}


def _second_sql(s: str) -> str:
    return f"CASE WHEN eliminated <> '{s}' THEN r1_{s} + CASE eliminated {' '.join(f'WHEN {chr(39)}{e}{chr(39)} THEN {e}_{s}' for e in SIDES if e != s)} END END AS r2_{s}"


SV_SQL = f"""r1 AS (SELECT *, {', '.join(f'{v} AS r1_{s}' for s, v in R1.items())}, {' + '.join(R1.values())} AS valid FROM sums),
 mw AS (SELECT *, CASE {' '.join(f"WHEN valid > 0 AND 2 * r1_{s} > valid THEN '{s}'" for s in SIDES)} END AS majority_winner FROM r1),
 el AS (SELECT *, CASE WHEN majority_winner IS NULL THEN CASE {' '.join(f"WHEN r1_{s} = least(r1_Left, r1_Right, r1_MR) THEN '{s}'" for s in SIDES)} END END AS eliminated FROM mw),
 r2 AS (SELECT *, {', '.join(_second_sql(s) for s in SIDES)}, CASE eliminated {' '.join(f"WHEN '{e}' THEN {e}_{e}" for e in SIDES)} END AS nil FROM el),
 sv AS (SELECT * EXCLUDE (w), coalesce(majority_winner, w) AS winner, coalesce(greatest(r2_Left, r2_Right, r2_MR) = least(r2_Left, r2_Right, r2_MR), false) AS tie FROM (
   SELECT *, CASE WHEN greatest(r2_Left, r2_Right, r2_MR) > least(r2_Left, r2_Right, r2_MR) THEN CASE {' '.join(f"WHEN r2_{s} = greatest(r2_Left, r2_Right, r2_MR) THEN '{s}'" for s in SIDES)} END END AS w FROM r2))"""
_PICK = lambda side: f"coalesce(CASE {side} {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN r2_{s}' for s in SIDES)} END, 0)"
CERTAINTY_SQL = f"""ranked AS (SELECT *, list_sort([{', '.join(f"{{'v': -r1_{s}, 'o': {i}, 's': '{s}'}}" for i, s in enumerate(SIDES))}]) AS rk FROM sv),
 flat AS (SELECT * EXCLUDE (rk), -rk[1].v AS v1, -rk[2].v AS v2, -rk[3].v AS v3, rk[1].s AS s1, rk[2].s AS s2, rk[3].s AS s3, greatest(0, undecided) AS u FROM ranked),
 staged AS (SELECT *, {_PICK('s1')} - {_PICK('s2')} AS lead2, CASE WHEN v1 - (v2 + v3) > u THEN 'round1-majority' WHEN NOT (v2 + v3 - v1 >= u AND v2 - v3 > u) THEN 'uncertain'
   WHEN abs({_PICK('s1')} - {_PICK('s2')}) > u THEN 'runoff-winner' ELSE 'runoff-pending' END AS stage FROM flat),
 certain AS (SELECT *, stage IN ('round1-majority', 'runoff-winner') AS result_certain,
   CASE WHEN stage = 'round1-majority' THEN s1 WHEN stage = 'runoff-winner' THEN CASE WHEN lead2 >= 0 THEN s1 ELSE s2 END END AS certain_winner,
   stage <> 'round1-majority' AND v2 + v3 - v1 >= u AS runoff_certain, stage <> 'round1-majority' AND v2 - v3 > u AS participants_certain,
   CASE WHEN stage <> 'round1-majority' AND v2 - v3 > u THEN s3 END AS certain_out FROM staged)"""
LEADER_SQL = "CASE WHEN stage = 'round1-majority' OR participants_certain THEN winner WHEN v1 > 0 AND v1 > v2 THEN s1 END"
SUMMARY = ["n_rows", "n_declared", "Electorate", "Turnout", "Spoil", "undecided", "valid", "winner", "tie", "eliminated", "stage", "result_certain", "certain_winner"]


def seat_summary_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, supplementary vote, certainty and leader of each seat: one aggregate, then row arithmetic."""
    full = methods.with_certainty(methods.supplementary_vote(tally.seat_sums(rows, keys)))
    return full.withColumn("leader", methods.leading_side())


@query("seat_summary", sql(f"SELECT Constituency, {', '.join(SUMMARY)}, round(percent_declared, 6) AS percent_declared, {LEADER_SQL} AS leader FROM certain", "located", more=f"{STATUS_MID}, {sums_sql('Constituency')}, {SV_SQL}, {CERTAINTY_SQL}"))
def seat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """134: everything about each constituency as of a moment."""
    return seat_summary_of(mid(spark, sf_dir), ["Constituency"]).select("Constituency", *SUMMARY, F.round("percent_declared", 6).alias("percent_declared"), "leader")


@query("s134_seat_summary_by_region", sql(f"SELECT Constituency, Region, {', '.join(SUMMARY)}, round(percent_declared, 6) AS percent_declared, {LEADER_SQL} AS leader FROM certain", "located", more=f"{STATUS_MID}, {sums_sql('Constituency, Region')}, {SV_SQL}, {CERTAINTY_SQL}"))
def seat_summary_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seat_summary_of(mid(spark, sf_dir), ["Constituency", "Region"]).select("Constituency", "Region", *SUMMARY, F.round("percent_declared", 6).alias("percent_declared"), "leader")


@query("s102_row_status", sql(f"SELECT Result_ID, {status_sql(MID)} AS status FROM result", "result"))
def row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.with_status(result(spark, sf_dir), NOW_MID).select("Result_ID", "status")


@query("s020_at_least_counting", sql(f"SELECT Result_ID FROM (SELECT *, {status_sql(MID)} AS status FROM result) WHERE status IN ('Counting', 'Declared')", "result"))
def at_least_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.with_status(result(spark, sf_dir), NOW_MID).filter(st.at_least("status", st.COUNTING)).select("Result_ID")


@query("s061_status_gated_sums", sql(f"SELECT Constituency, Electorate, Turnout, Spoil, {', '.join(TRANSFERS)} FROM sums", "located", more=f"{STATUS_MID}, {sums_sql('Constituency')}"))
def gated_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.seat_sums(mid(spark, sf_dir), ["Constituency"]).select("Constituency", "Electorate", "Turnout", "Spoil", *TRANSFERS)


@query("s062_percent_declared", sql("SELECT County, round(percent_declared, 6) AS percent_declared FROM sums", "located", more=f"{STATUS_MID}, {sums_sql('County')}"))
def percent_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid(spark, sf_dir).groupBy("County").agg(F.round(tally.percent_declared(), 6).alias("percent_declared"))


_NAMES = {s: s.lower().replace(" ", "_") for s in st.STATUSES}
_BREAKDOWN = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{n}, CAST(coalesce(sum(Electorate) FILTER (status = '{s}'), 0) AS BIGINT) AS e_{n}" for s, n in _NAMES.items())
_PCT = ", ".join(f"CASE WHEN electorate > 0 THEN e_{n} / electorate * 100 ELSE 0 END AS pct_{n}" for n in _NAMES.values())
BREAKDOWN_SQL = f"b AS (SELECT *, {_PCT} FROM (SELECT Ward, count(*) AS n_rows, CAST(sum(Electorate) AS BIGINT) AS electorate, {_BREAKDOWN} FROM st GROUP BY Ward))"


@query("s063_status_breakdown", sql(f"SELECT Ward, n_rows, electorate, {', '.join(f'n_{n}, e_{n}, round(pct_{n}, 6) AS pct_{n}' for n in _NAMES.values())} FROM b", "located", more=f"{STATUS_MID}, {BREAKDOWN_SQL}"))
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tally.status_summary(mid(spark, sf_dir), ["Ward"])
    return out.select("Ward", "n_rows", "electorate", *[c for n in _NAMES.values() for c in (F.col(f"n_{n}"), F.col(f"e_{n}"), F.round(f"pct_{n}", 6).alias(f"pct_{n}"))])


@query("s064_fully_declared", sql("SELECT Ward, bool_and(status = 'Declared') AS fully_declared FROM st GROUP BY Ward", "located", more=STATUS_MID))
def fully_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid(spark, sf_dir).groupBy("Ward").agg(tally.fully_declared().alias("fully_declared"))


@query("s065_dominant_status", sql("SELECT Ward, CASE WHEN pct_declared >= 100 THEN 'Declared' WHEN n_counting > 0 OR pct_declared > 0 THEN 'Counting' WHEN n_verifying > 0 THEN 'Verifying' ELSE 'Not Received' END AS status FROM b", "located", more=f"{STATUS_MID}, {BREAKDOWN_SQL}"))
def dominant_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.status_summary(mid(spark, sf_dir), ["Ward"]).select("Ward", tally.dominant_status().alias("status"))


@query("s066_undecided_pool", sql("SELECT Constituency, undecided FROM sums", "located", more=f"{STATUS_MID}, {sums_sql('Constituency')}"))
def undecided_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid(spark, sf_dir).groupBy("Constituency").agg(tally.undecided_pool().alias("undecided"))


@query("s067_safe_vote_bound", sql("SELECT Zone, CAST(sum(CASE status WHEN 'Declared' THEN Turnout - Spoil WHEN 'Counting' THEN Turnout ELSE Electorate END) AS BIGINT) AS bound FROM st GROUP BY Zone", "located", more=STATUS_MID))
def safe_vote_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid(spark, sf_dir).groupBy("Zone").agg(tally.safe_vote_bound(F.col("Turnout") - F.col("Spoil")).alias("bound"))


UNITS_SQL = f"""unit AS (SELECT District, Ward, count(*) AS n_rows, bool_and(status = 'Declared') AS done, {', '.join(LONG(f'sum({v})', s) for s, v in R1.items())} FROM st GROUP BY District, Ward),
 won AS (SELECT * EXCLUDE (done), CASE WHEN greatest("Left", "Right", MR) > 0 AND (("Left" = greatest("Left", "Right", MR))::INT + ("Right" = greatest("Left", "Right", MR))::INT + (MR = greatest("Left", "Right", MR))::INT) = 1
   THEN CASE WHEN "Left" = greatest("Left", "Right", MR) THEN 'Left' WHEN "Right" = greatest("Left", "Right", MR) THEN 'Right' ELSE 'MR' END END AS winner FROM unit WHERE done)""".replace("AS Left", 'AS "Left"').replace("AS Right", 'AS "Right"')


@query("s068_unit_winners", sql('SELECT District, Ward, n_rows, "Left", "Right", MR, winner FROM won', "located", more=f"{STATUS_LATE}, {UNITS_SQL}"))
def unit_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_winners(late(spark, sf_dir), ["District", "Ward"])


@query(
    "s069_council_totals",
    sql(
        f"SELECT District, count(DISTINCT Ward) AS total_units, coalesce(any_value(d), 0) AS declared_units, greatest(0, count(DISTINCT Ward) - coalesce(any_value(d), 0)) AS undeclared_units, {', '.join(f'coalesce(any_value(w_{s}), 0) AS won_{s}' for s in SIDES)} FROM precinct LEFT JOIN c USING (District) GROUP BY District",
        "located",
        more=f"{STATUS_LATE}, {UNITS_SQL}, c AS (SELECT District, count(*) AS d, {', '.join(f'count(*) FILTER (winner = {chr(39)}{s}{chr(39)}) AS w_{s}' for s in SIDES)} FROM won GROUP BY District)",
    ),
)
def council_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.council_totals(precinct(spark, sf_dir), units.unit_winners(late(spark, sf_dir), ["District", "Ward"]), "District", "Ward")


#: Which party a side is, by district: sides rotate among four parties with the length of the district's name.
PARTY_SQL = "parties AS (SELECT District, side, 'P' || ((length(District) + o) % 4) AS party FROM (SELECT DISTINCT District FROM precinct), (SELECT unnest(['Left', 'Right', 'MR']) AS side, unnest([0, 1, 2]) AS o))"


def district_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).alias("o")) for i, s in enumerate(SIDES)])
    return precinct(spark, sf_dir).select("District").distinct().select("District", F.inline(sides)).select("District", "side", F.concat(F.lit("P"), ((F.length("District") + F.col("o")) % 4).cast("string")).alias("party"))


@query("s069_units_by_party", sql("SELECT party, count(*) AS units FROM won JOIN parties ON won.District = parties.District AND won.winner = parties.side GROUP BY party", "located", more=f"{STATUS_LATE}, {UNITS_SQL}, {PARTY_SQL}"))
def units_by_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.units_by_party(units.unit_winners(late(spark, sf_dir), ["District", "Ward"]), district_parties(spark, sf_dir), ["District"])


SIDE_VOTES_SQL = f"side_votes AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT District, {chr(39)}{s}{chr(39)} AS side, CAST(sum({v}) AS BIGINT) AS votes FROM st WHERE status = {chr(39)}Declared{chr(39)} GROUP BY District' for s, v in R1.items())}) WHERE votes <> 0)"


@query("s070_party_votes", sql("SELECT party, CAST(sum(votes) AS BIGINT) AS votes FROM side_votes JOIN parties USING (District, side) GROUP BY party", "located", more=f"{STATUS_MID}, {SIDE_VOTES_SQL}, {PARTY_SQL}"))
def party_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.votes_by_side(mid(spark, sf_dir), ["District"]).join(district_parties(spark, sf_dir), ["District", "side"]).groupBy("party").agg(F.sum("votes").alias("votes"))


@query("s071_side_votes", sql("SELECT CASE side WHEN 'Left' THEN 'Pooled' WHEN 'Right' THEN 'Pooled' ELSE side END AS label, CAST(sum(votes) AS BIGINT) AS votes FROM side_votes GROUP BY 1", "located", more=f"{STATUS_MID}, {SIDE_VOTES_SQL}"))
def side_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tally.votes_by_side(mid(spark, sf_dir), ["District"]).withColumn("label", F.when(F.col("side").isin("Left", "Right"), "Pooled").otherwise(F.col("side")))
    return labelled.groupBy("label").agg(F.sum("votes").alias("votes"))


@query("s073_vote_share", sql("SELECT District, side, votes, round(votes / sum(votes) OVER (PARTITION BY District), 6) AS share FROM side_votes", "located", more=f"{STATUS_MID}, {SIDE_VOTES_SQL}"))
def vote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tally.share_of_total(tally.votes_by_side(mid(spark, sf_dir), ["District"]), ["District"], "votes")
    return out.select("District", "side", "votes", F.round("share", 6).alias("share"))


@query(
    "s072_seats_by_side_and_type",
    sql(
        "SELECT side, count(*) FILTER (t = 'constituency') AS constituency, count(*) FILTER (t = 'county') AS county, count(*) FILTER (t = 'zone') AS zone, count(*) AS total FROM w WHERE side IS NOT NULL GROUP BY side",
        "located",
        more=f"{STATUS_MID}, w AS ({' UNION ALL '.join(f'(WITH {sums_sql(k)}, {SV_SQL}, {CERTAINTY_SQL} SELECT {LEADER_SQL} AS side, {chr(39)}{k.lower()}{chr(39)} AS t FROM certain)' for k in ('Constituency', 'County', 'Zone'))})",
    ),
)
def seats_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a county lies in one constituency and one zone: the rows are summed once, by county, and these few sums once more for each type
    rows = mid(spark, sf_dir)
    sums = rows.groupBy("County", "Constituency", "Zone").agg(*tally.sums_of_seat())
    each = F.array(*[F.struct(F.lit(k.lower()).alias("t"), F.col(k).cast("long").alias("seat")) for k in ("Constituency", "County", "Zone")])
    seats = tally.sums_of_sums(sums.withColumn("_s", F.explode(each)).select("*", "_s.t", "_s.seat"), ["t", "seat"])
    won = methods.with_certainty(methods.supplementary_vote(seats)).withColumn("leader", methods.leading_side())
    # counted by side: a filter on the leader would be pushed through all of its arithmetic
    counts = won.groupBy("t").agg(*[F.count_if(F.col("leader") == s).alias(s) for s in SIDES])
    long = counts.unpivot(["t"], list(SIDES), "side", "n")
    types = ["constituency", "county", "zone"]
    wide = long.groupBy("side").pivot("t", types).sum("n")
    return wide.select("*", (F.col("constituency") + F.col("county") + F.col("zone")).alias("total")).filter("total > 0")


YES = "CASE WHEN status = 'Declared' THEN Left_Left + Left_Right + Left_MR + MR_MR ELSE 0 END"
NO = "CASE WHEN status = 'Declared' THEN Turnout - Spoil - (Left_Left + Left_Right + Left_MR + MR_MR) ELSE 0 END"


def referendum(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.col("Left_Left") + F.col("Left_Right") + F.col("Left_MR") + F.col("MR_MR")
    return mid(spark, sf_dir).withColumns({"Yes_Votes": yes, "No_Votes": F.col("Turnout") - F.col("Spoil") - yes})


REF_SQL = f"""ref AS (SELECT Zone, County, GROUPING_ID(Zone, County) AS level, CAST(sum({YES}) AS BIGINT) AS yes, CAST(sum({NO}) AS BIGINT) AS "no", CAST(sum(Electorate) AS BIGINT) AS electorate,
   CAST(sum(Turnout) FILTER (status IN ('Declared', 'Counting')) AS BIGINT) AS turnout, coalesce(sum(Electorate) FILTER (status = 'Declared'), 0) / sum(Electorate) * 100 AS pd FROM st GROUP BY GROUPING SETS ((), (Zone), (Zone, County)))"""


@query(
    "s074_referendum_levels",
    sql('SELECT level, Zone, County, yes, "no", yes + "no" AS valid, electorate, turnout, round(CASE WHEN yes + "no" > 0 THEN yes / (yes + "no") * 100 ELSE 0 END, 6) AS yes_percent, round(pd, 6) AS percent_declared FROM ref', "located", more=f"{STATUS_MID}, {REF_SQL}"),
)
def referendum_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation, authorities and counties from one pass: rollup."""
    rows = referendum(spark, sf_dir)
    out = rows.rollup("Zone", "County").agg(
        F.grouping_id().alias("level"), tally.sum_gated("Yes_Votes").alias("yes"), tally.sum_gated("No_Votes").alias("no"), F.sum("Electorate").alias("electorate"), F.sum(tally.gated("Turnout", least=st.COUNTING)).alias("turnout"), tally.percent_declared().alias("pd")
    )
    valid = F.col("yes") + F.col("no")
    return out.select("level", "Zone", "County", "yes", "no", valid.alias("valid"), "electorate", "turnout", F.round(percent(F.col("yes"), valid), 6).alias("yes_percent"), F.round("pd", 6).alias("percent_declared"))


@query("s133_referendum_label", sql("SELECT Zone, CASE WHEN yes + \"no\" > 0 AND abs(yes - \"no\") > greatest(0, electorate * (1 - pd / 100)) THEN CASE WHEN yes > \"no\" THEN 'Agree' ELSE 'Disagree' END ELSE 'In Progress' END AS label FROM ref WHERE level = 1", "located", more=f"{STATUS_MID}, {REF_SQL}"))
def referendum_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tally.yes_no_summary(referendum(spark, sf_dir), ["Zone"])
    return out.select("Zone", tally.referendum_label(F.col("yes"), F.col("no"), F.col("electorate"), F.col("percent_declared")).alias("label"))


@query("s121_supplementary_vote", sql(f"SELECT County, {', '.join(f'r1_{s}, r2_{s}' for s in SIDES)}, valid, majority_winner, eliminated, nil, winner, tie FROM sv", "located", more=f"{STATUS_LATE}, {sums_sql('County')}, {SV_SQL}"))
def supplementary_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = methods.supplementary_vote(tally.seat_sums(late(spark, sf_dir), ["County"]))
    return out.select("County", *[f"r{i}_{s}" for s in SIDES for i in (1, 2)], "valid", "majority_winner", "eliminated", "nil", "winner", "tie")


_HYPO = f"""h AS (SELECT County, {', '.join(f'{s}_{t}' for s in SIDES for t in SIDES)}, {', '.join(f'{v} AS r1_{s}' for s, v in R1.items())}, unnest(['Left', 'Right', 'MR']) AS eliminated FROM sums),
 h2 AS (SELECT *, {', '.join(_second_sql(s) for s in SIDES)}, CASE eliminated {' '.join(f"WHEN '{e}' THEN {e}_{e}" for e in SIDES)} END AS nil FROM h)"""


@query("s122_hypothetical_runoffs", sql(f"SELECT County, eliminated, {', '.join(f'r2_{s}' for s in SIDES)}, nil, CASE WHEN greatest(r2_Left, r2_Right, r2_MR) > least(r2_Left, r2_Right, r2_MR) THEN CASE {' '.join(f'WHEN r2_{s} = greatest(r2_Left, r2_Right, r2_MR) THEN {chr(39)}{s}{chr(39)}' for s in SIDES)} END END AS winner FROM h2", "located", more=f"{STATUS_LATE}, {sums_sql('County')}, {_HYPO}"))
def hypothetical_runoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = methods.hypothetical_runoffs(tally.seat_sums(late(spark, sf_dir), ["County"]))
    return out.select("County", "eliminated", *[f"r2_{s}" for s in SIDES], "nil", "winner")


@query("s123_plurality_leader", sql("SELECT Ward, CASE WHEN v1 > 0 AND v1 > v2 THEN s1 END AS leader FROM flat", "located", more=f"{STATUS_MID}, {sums_sql('Ward')}, {SV_SQL}, {CERTAINTY_SQL}"))
def plurality_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.seat_sums(mid(spark, sf_dir), ["Ward"]).select("Ward", methods.plurality_leader(methods.first_preferences()).alias("leader"))


@query("s124_certainty", sql("SELECT Ward, stage, result_certain, certain_winner, runoff_certain, participants_certain, certain_out FROM certain", "located", more=f"{STATUS_MID}, {sums_sql('Ward')}, {SV_SQL}, {CERTAINTY_SQL}"))
def certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seat_summary_of(mid(spark, sf_dir), ["Ward"]).select("Ward", "stage", "result_certain", "certain_winner", "runoff_certain", "participants_certain", "certain_out")


@query("s125_displayed_leader", sql(f"SELECT Ward, {LEADER_SQL} AS leader FROM certain", "located", more=f"{STATUS_MID}, {sums_sql('Ward')}, {SV_SQL}, {CERTAINTY_SQL}"))
def displayed_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seat_summary_of(mid(spark, sf_dir), ["Ward"]).select("Ward", "leader")


@query(
    "s126_leader_share",
    sql(
        f"SELECT County, leader, round(CASE WHEN leader IS NULL THEN NULL WHEN eliminated IS NOT NULL THEN {_PICK('leader')} / (coalesce(r2_Left, 0) + coalesce(r2_Right, 0) + coalesce(r2_MR, 0)) WHEN valid > 0 THEN CASE leader {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN r1_{s}' for s in SIDES)} END / valid END, 6) AS share FROM (SELECT *, {LEADER_SQL} AS leader FROM certain)",
        "located",
        more=f"{STATUS_LATE}, {sums_sql('County')}, {SV_SQL}, {CERTAINTY_SQL}",
    ),
)
def leader_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seat_summary_of(late(spark, sf_dir), ["County"])
    return out.select("County", "leader", F.round(F.when(F.col("leader").isNotNull(), methods.share_for(F.col("leader"))), 6).alias("share"))


@query(
    "s181_spoil_shares",
    sql(
        "SELECT County, round(CASE WHEN valid + Spoil > 0 THEN Spoil / (valid + Spoil) * 100 ELSE 0 END, 6) AS spoil_1, round(CASE WHEN eliminated IS NOT NULL THEN (Spoil + nil) / (coalesce(r2_Left, 0) + coalesce(r2_Right, 0) + coalesce(r2_MR, 0) + Spoil + nil) * 100 END, 6) AS spoil_2 FROM sv",
        "located",
        more=f"{STATUS_LATE}, {sums_sql('County')}, {SV_SQL}",
    ),
)
def spoil_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = methods.spoil_shares()
    return methods.supplementary_vote(tally.seat_sums(late(spark, sf_dir), ["County"])).select("County", F.round(one, 6).alias("spoil_1"), F.round(two, 6).alias("spoil_2"))


@query(
    "s182_stage_labels",
    sql(
        "SELECT Ward, CASE WHEN stage = 'round1-majority' THEN 'No Runoff Needed' WHEN NOT runoff_certain THEN 'Runoff Uncertain' WHEN NOT participants_certain THEN 'Runoff Needed' ELSE 'Runoff In Progress' END AS round_label, CASE WHEN result_certain THEN 'Winner Decided' ELSE 'Winner Undecided' END AS winner_label FROM certain",
        "located",
        more=f"{STATUS_MID}, {sums_sql('Ward')}, {SV_SQL}, {CERTAINTY_SQL}",
    ),
)
def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seat_summary_of(mid(spark, sf_dir), ["Ward"]).select("Ward", methods.round_label().alias("round_label"), methods.winner_label().alias("winner_label"))


@query(
    "s127_unit_runoff_under_parent",
    sql(
        f"SELECT Ward, Zone, eliminated, {', '.join(f'r2_{s}' for s in SIDES)} FROM (SELECT *, {', '.join(_second_sql(s) for s in SIDES)} FROM (SELECT u.Ward, u.Zone, e.eliminated, {', '.join(f'u.{c}' for c in TRANSFERS)}, {', '.join(f'u.r1_{s}' for s in SIDES)} FROM u JOIN e USING (Zone)))",
        "located",
        more=f"{STATUS_LATE}, u AS (WITH {sums_sql('Ward, Zone')}, {SV_SQL} SELECT * FROM sv), e AS (WITH {sums_sql('Zone')}, {SV_SQL} SELECT Zone, eliminated FROM sv)",
    ),
)
def unit_runoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ward's second round with the side out that is out in its zone."""
    rows = late(spark, sf_dir)
    parent = methods.supplementary_vote(tally.seat_sums(rows, ["Zone"])).select("Zone", "eliminated")
    wards = tally.seat_sums(rows, ["Ward", "Zone"]).join(parent, "Zone")
    return methods.runoff(wards, F.col("eliminated")).select("Ward", "Zone", "eliminated", *[f"r2_{s}" for s in SIDES])


@query(
    "s132_margin_safe",
    sql(
        "SELECT l.District, l.leader, l.won, l.won - l.second AS margin, total - d AS remaining, (total - d = 0 OR total - d < l.won - l.second) AS final FROM l JOIN t USING (District)",
        "located",
        more=f"{STATUS_LATE}, {UNITS_SQL}, n AS (SELECT District, winner, count(*) AS c, row_number() OVER (PARTITION BY District ORDER BY count(*) DESC, winner) AS p FROM won WHERE winner IS NOT NULL GROUP BY District, winner), l AS (SELECT District, max(winner) FILTER (p = 1) AS leader, max(c) FILTER (p = 1) AS won, coalesce(max(c) FILTER (p = 2), 0) AS second FROM n GROUP BY District), t AS (SELECT District, count(DISTINCT Ward) AS total, (SELECT count(*) FROM won w WHERE w.District = p.District) AS d FROM precinct p GROUP BY District)",
    ),
)
def margin_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = units.unit_winners(late(spark, sf_dir), ["District", "Ward"])
    counts = winners.filter("winner is not null").groupBy("District", "winner").agg(F.count(F.lit(1)).alias("n"))
    lead = units.leader_and_second(counts, ["District"], "winner", "n")
    totals = units.council_totals(precinct(spark, sf_dir), winners, "District", "Ward").select("District", "undeclared_units")
    margin, final = methods.margin_safe(F.col("won"), F.col("second"), F.col("undeclared_units"), F.col("leader"))
    return lead.join(totals, "District").select("District", "leader", "won", margin.alias("margin"), F.col("undeclared_units").alias("remaining"), final.alias("final"))


@query(
    "s135_precinct_detail",
    sql(
        f"SELECT Result_ID, status, CASE WHEN status IN ('Declared', 'Counting') THEN Turnout END AS turnout, CASE WHEN status = 'Declared' AND v1 > 0 AND v1 > v2 THEN s1 END AS leader FROM (SELECT *, list_sort([{', '.join(f'{R1[s]}' for s in SIDES)}], 'DESC')[1] AS v1, list_sort([{', '.join(f'{R1[s]}' for s in SIDES)}], 'DESC')[2] AS v2, CASE greatest({', '.join(R1.values())}) {' '.join(f'WHEN {v} THEN {chr(39)}{s}{chr(39)}' for s, v in R1.items())} END AS s1 FROM st)",
        "located",
        more=STATUS_MID,
    ),
)
def precinct_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    leader = methods.plurality_leader(methods.first_preferences())
    return mid(spark, sf_dir).select("Result_ID", "status", tally.gated("Turnout", least=st.COUNTING).alias("turnout"), F.when(F.col("status") == st.DECLARED, leader).alias("leader"))


@query("s172_transition_events", sql("SELECT Result_ID, received_at AS event_time, 'Verifying' AS to_status FROM result UNION ALL SELECT Result_ID, verified_at, 'Counting' FROM result UNION ALL SELECT Result_ID, declared_at, 'Declared' FROM result WHERE declared_at IS NOT NULL", "result"))
def transition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.transition_events(result(spark, sf_dir), ["Result_ID"])


@query(
    "s173_tally_timeline",
    sql(
        f"SELECT declared_at AS moment, {', '.join(LONG(f'sum(sum({R1[s]})) OVER w', f'v_{s}') for s in SIDES)}, round(sum(sum(Electorate)) OVER w / (SELECT sum(Electorate) FROM result) * 100, 6) AS percent_declared FROM result WHERE declared_at IS NOT NULL GROUP BY declared_at WINDOW w AS (ORDER BY declared_at ROWS UNBOUNDED PRECEDING)",
        "result",
    ),
)
def tally_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result(spark, sf_dir).select("*", *[v.alias(f"v_{s}") for s, v in methods.first_preferences().items()])
    names = [f"v_{s}" for s in SIDES]
    return tally.timeline(rows, names).select("moment", *names, F.round("percent_declared", 6).alias("percent_declared"))


_MOMENTS = ["1996-01-01 00:00:00", NOW_MID, NOW_LATE]


@query(
    "s174_as_of_snapshots",
    sql(
        f"SELECT as_of, Zone, count(*) FILTER (status = 'Declared') AS n_declared, round(coalesce(sum(Electorate) FILTER (status = 'Declared'), 0) / sum(Electorate) * 100, 6) AS percent_declared FROM (SELECT *, {status_sql('as_of')} AS status FROM located, (SELECT unnest([{', '.join(f'TIMESTAMP {chr(39)}{m}{chr(39)}' for m in _MOMENTS)}]) AS as_of)) GROUP BY as_of, Zone",
        "located",
    ),
)
def as_of_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.as_of(located(spark, sf_dir), _MOMENTS, ["Zone"], {"n_declared": F.count_if(F.col("status") == st.DECLARED), "percent_declared": F.round(tally.percent_declared(), 6)})


@query("s176_declarations_per_day", sql("SELECT time_bucket(INTERVAL 1 DAY, declared_at) AS day, count(*) AS n FROM result WHERE declared_at IS NOT NULL GROUP BY 1", "result"))
def declarations_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, sf_dir).filter("declared_at is not null").groupBy(F.window("declared_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "n")


@query("s092_beyond_checkpoints", sql(f"SELECT c AS checkpoint, count(*) FILTER (declared_at > CAST(c AS TIMESTAMP)) AS n_after FROM result, (SELECT unnest([{', '.join(repr(m) for m in _MOMENTS)}]) AS c) GROUP BY c", "result"))
def beyond_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.beyond_checkpoints(result(spark, sf_dir), "declared_at", _MOMENTS)


_CHECKS_SQL = "count(*) FILTER (Turnout > Electorate) AS turnout_over, count(*) FILTER (declared_at IS NULL) AS no_declaration, count(*) FILTER (Spoil > 5) AS many_spoilt"


@query("s075_quality_report", sql(f"SELECT 'mid' AS source, count(*) AS n_rows, {_CHECKS_SQL} FROM result WHERE received_at <= {MID} UNION ALL SELECT 'all', count(*), {_CHECKS_SQL} FROM result", "result"))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result(spark, sf_dir)
    checks = {"turnout_over": F.col("Turnout") > F.col("Electorate"), "no_declaration": F.col("declared_at").isNull(), "many_spoilt": F.col("Spoil") > 5}
    return tally.quality_report({"mid": rows.filter(F.col("received_at") <= F.lit(NOW_MID).cast("timestamp")), "all": rows}, checks)


@query("s035_roster_with_results", sql("SELECT p.Shape_ID, coalesce(c, 0) AS n_results, coalesce(s, 'Not Received') AS status FROM precinct p LEFT JOIN (SELECT Shape_ID, count(*) AS c, 'Received' AS s FROM result GROUP BY Shape_ID) r ON p.Shape_ID = r.Shape_ID", "precinct", "result"))
def roster_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = result(spark, sf_dir).groupBy("Shape_ID").agg(F.count(F.lit(1)).alias("n_results")).withColumn("status", F.lit("Received"))
    return joins.with_roster(precinct(spark, sf_dir).select("Shape_ID"), sums, ["Shape_ID"], {"n_results": 0, "status": "Not Received"})


@query("s052_total_over_decided_seats", sql("SELECT count(*) AS seats, count(*) FILTER (result_certain) AS decided, CAST(sum(CASE WHEN result_certain THEN valid ELSE 0 END) AS BIGINT) AS decided_votes FROM certain", "located", more=f"{STATUS_MID}, {sums_sql('Ward')}, {SV_SQL}, {CERTAINTY_SQL}"))
def total_over_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seat_summary_of(mid(spark, sf_dir), ["Ward"]).agg(F.count(F.lit(1)).alias("seats"), F.count_if("result_certain").alias("decided"), F.sum(F.when(F.col("result_certain"), F.col("valid")).otherwise(0)).alias("decided_votes"))


@query("s037_winning_party", sql(f"SELECT County, winner, CASE winner WHEN 'Left' THEN 'LP' || (County % 3) WHEN 'Right' THEN 'RP' || (County % 2) WHEN 'MR' THEN NULL END AS party FROM sv", "located", more=f"{STATUS_LATE}, {sums_sql('County')}, {SV_SQL}"))
def winning_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties by county; the middle's is blank, so null."""
    sv = methods.supplementary_vote(tally.seat_sums(late(spark, sf_dir), ["County"]))
    parts = sv.select("County").distinct().select("County", F.concat(F.lit("LP"), (F.col("County") % 3).cast("string")).alias("Left_Party"), F.concat(F.lit("RP"), (F.col("County") % 2).cast("string")).alias("Right_Party"), F.lit(" ").alias("MR_Party"))
    return sv.join(parts, "County").select("County", "winner", joins.pick_by(F.col("winner"), {s: F.col(f"{s}_Party") for s in SIDES}).alias("party"))

"""Queries on scores, labels, draws, reconciliation and seats in proportion."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.functions import numbers as num
from hustings.functions import scores
from hustings.functions.scores import SIDES
from hustings.operators import proportional, reconcile, sampling, tally, units, windows
from hustings.operators.labels import with_perception
from hustings.operators.methods import first_preferences
from hustings.plans.adapters import NOW_LATE, NOW_MID, cluster, located, precinct, rate, result, sector, sql, status_sql, table
from hustings.plans.registry import query
from hustings.plans.tally_queries import R1, STATUS_MID, UNITS_SQL
from hustings.shared import spread


@query("s099_distance_km", sql("SELECT id, round(sqrt((x - 48) * (x - 48) + (y - 44) * (y - 44)) / 8.01, 6) AS km, round(sqrt((x - 48) * (x - 48) + (y - 44) * (y - 44)) / 8.01 / 40, 6) AS hours FROM point", "point"))
def distance_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hustings.functions.geometry import distance
    from hustings.plans.adapters import point

    km = distance(F.col("x"), F.col("y"), F.lit(48.0), F.lit(44.0), 8.01)
    return point(spark, sf_dir).select("id", F.round(km, 6).alias("km"), F.round(km / 40, 6).alias("hours"))


@query("s100_round_up_hours", sql("SELECT Result_ID, ceil(Turnout / 120 * 2) / 2 AS half, ceil(Turnout / 120 * 60 / 15) * 15 / 60 AS quarter FROM result", "result"))
def round_up_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.col("Turnout") / 120
    return result(spark, sf_dir).select("Result_ID", num.round_up_hours(hours, 30).cast("double").alias("half"), num.round_up_hours(hours, 15).cast("double").alias("quarter"))


@query("s101_add_seconds", sql("SELECT Result_ID, strftime(received_at + to_seconds(Turnout * 61), '%Y-%m-%dT%H:%M:%SZ') AS at FROM result", "result"))
def add_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, sf_dir).select("Result_ID", num.iso_utc(num.plus_seconds("received_at", F.col("Turnout") * 61)).alias("at"))


_FRACTION_SQL = "f AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 7) || '/' || (p_partkey % 5) WHEN 1 THEN ' ' || (p_partkey % 9) || '.5 ' WHEN 2 THEN '' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)"


@query("s103_text_fractions", sql("SELECT id, round(CASE WHEN trim(t) = '' THEN 0 WHEN t LIKE '%/%' THEN CAST(split_part(t, '/', 1) AS DOUBLE) / nullif(CAST(split_part(t, '/', 2) AS DOUBLE), 0) ELSE CAST(trim(t) AS DOUBLE) END, 6) AS value FROM f", more=_FRACTION_SQL))
def text_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    text = F.when(k % 4 == 0, F.concat(s(k % 7), F.lit("/"), s(k % 5))).when(k % 4 == 1, F.concat(F.lit(" "), s(k % 9), F.lit(".5 "))).when(k % 4 == 2, "").otherwise(s(F.col("p_size")))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(num.fraction(text), 6).alias("value"))


#: Race texts by customer: neutral ones in two spellings, landslides and races.
_RACES = ["Head_to_Head", "Head to Head", "Vote_Left", "Vote_R", "Race: L_MR", "Race: MR_R", "Vote: Left_R", ""]
_RACE_SQL = f"race AS (SELECT c_custkey AS id, [{', '.join(repr(r) for r in _RACES)}][c_custkey % {len(_RACES)} + 1] AS r FROM customer)"


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.element_at(F.array(*[F.lit(r) for r in _RACES]), (F.col("c_custkey") % len(_RACES) + 1).cast("int")).alias("r"))


@query("s104_canonical_race", sql("SELECT id, CASE WHEN replace(trim(r), '_', ' ') = 'Head to Head' THEN 'Head to Head' ELSE r END AS race FROM race", more=_RACE_SQL))
def canonical_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).select("id", scores.canonical_race("r").alias("race"))


@query("s105_race_flags", sql("SELECT id, CASE WHEN r IN ('Vote_R', 'Race: MR_R') THEN 1 ELSE 0 END AS L, CASE WHEN r IN ('Vote_Left', 'Vote_R', 'Vote: Left_R') THEN 1 ELSE 0 END AS MR, CASE WHEN r IN ('Vote_Left', 'Race: L_MR') THEN 1 ELSE 0 END AS R FROM race", more=_RACE_SQL))
def race_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).select("id", *[c.alias(p) for p, c in scores.race_flags("r").items()])


@query("s106_key_extraction", "SELECT p_partkey AS id, regexp_extract(p_brand, '^([A-Za-z]+)', 1) AS letters, split_part(p_name, ' ', 1) AS before FROM part")
def key_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", "^([A-Za-z]+)", 1).alias("letters"), F.substring_index("p_name", " ", 1).alias("before"))


@query("s107_step_tables", sql("SELECT Shape_ID, CASE WHEN Population * 20 <= 400000 THEN 20000 WHEN Population * 20 <= 650000 THEN 23000 WHEN Population * 20 <= 1000000 THEN 24000 ELSE 25000 END AS quota FROM precinct", "precinct"))
def step_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).select("Shape_ID", scores.population_quota(F.col("Population") * 20).alias("quota"))


@query("s108_conditional_score", sql("SELECT Shape_ID, greatest(0, least(80, CASE WHEN Ward % 3 = 0 THEN Area ELSE Area + CASE District WHEN 'BUILDING' THEN 40 WHEN 'MACHINERY' THEN -60 ELSE 0 END END)) AS score FROM precinct", "precinct"))
def conditional_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.col("Area") + scores.cases("District", {"BUILDING": 40, "MACHINERY": -60}, 0)
    return precinct(spark, sf_dir).select("Shape_ID", scores.clip(F.when(F.col("Ward") % 3 == 0, F.col("Area")).otherwise(full), 0, 80).alias("score"))


@query("s109_joint_cap", sql("SELECT Area_ID, round(A1 * f, 6) AS a, round(B1 * f, 6) AS b, round((100 - (A1 + B1) * f) * C1 / nullif(C1 + D1, 0), 6) AS c FROM (SELECT *, CASE WHEN A1 + B1 >= 90 THEN 90 / (A1 + B1) ELSE 1 END AS f FROM cluster)", "cluster"))
def joint_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shares capped together; the others fill up to 100 in proportion."""
    a, b = scores.joint_cap(F.col("A1"), F.col("B1"))
    rest = (100 - a - b) * F.col("C1") / F.nullif(F.col("C1") + F.col("D1"), F.lit(0.0))
    return cluster(spark, sf_dir).select("Area_ID", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(rest, 6).alias("c"))


_REWARD = lambda a, b: f"CASE WHEN {a} > {b} THEN {a} - {b} - 1 WHEN {a} < {b} THEN -({b} - {a} - 1) ELSE 0 END"
_CHAR = {"L": "(Area_ID % 11)", "MR": "(Area_ID % 7)", "R": "(Area_ID % 5)"}


def charisma() -> list:
    return [F.col("Area_ID") % k for k in (11, 7, 5)]


@query("s110_charisma_scores", sql(f"SELECT Area_ID, {', '.join('(' + ' + '.join(_REWARD(_CHAR[p], _CHAR[q]) for q in SIDES if q != p).replace('CASE', '(CASE').replace('END', 'END)') + f') * 0.75::DOUBLE AS {p}' for p in SIDES)} FROM cluster", "cluster"))
def charisma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, sf_dir).select("Area_ID", *[c.cast("double").alias(p) for p, c in scores.charisma_scores(*charisma()).items()])


@query("s111_swing", sql("SELECT Area_ID, round(l * (1 - 0.1) + m * 0.2, 6) AS L, round(m * (1 - 0.2 - 0.05) + l * 0.1 + (100 - l - m) * 0.15, 6) AS MR, round((100 - l - m) * (1 - 0.15) + m * 0.05, 6) AS R FROM (SELECT Area_ID, A1 / 2 AS l, B1 / 3 AS m FROM cluster)", "cluster"))
def swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = {"LtoM": F.lit(0.1), "MtoL": F.lit(0.2), "MtoR": F.lit(0.05), "RtoM": F.lit(0.15)}
    return cluster(spark, sf_dir).select("Area_ID", *[F.round(c, 6).alias(p) for p, c in scores.swing(F.col("A1") / 2, F.col("B1") / 3, rates).items()])


_SQUEEZE = {"L": ("C1 / 10", "A1 - 20"), "MR": ("D1 / 10", "B1 - 30"), "R": ("E1 / 10", "150 - A1 - B1")}
_RAW = {p: f"{loc} + ({com}) * ((100 - (C1 / 10 + D1 / 10 + E1 / 10)) / 100)" for p, (loc, com) in _SQUEEZE.items()}


@query("s112_squeeze", sql(f"SELECT Area_ID, {', '.join(f'round({p} * 100 / (L + MR + R), 6) AS {p}' for p in SIDES)} FROM (SELECT Area_ID, {', '.join(f'CASE WHEN {v} <= 0 THEN 1.5::DOUBLE WHEN {v} >= 100 THEN 95::DOUBLE ELSE {v} END AS {p}' for p, v in _RAW.items())} FROM cluster)", "cluster"))
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = {"L": F.col("C1") / 10, "MR": F.col("D1") / 10, "R": F.col("E1") / 10}
    combined = {"L": F.col("A1") - 20, "MR": F.col("B1") - 30, "R": 150 - F.col("A1") - F.col("B1")}
    return cluster(spark, sf_dir).select("Area_ID", *[F.round(c, 6).alias(p) for p, c in scores.squeeze(local, combined).items()])


@query("s113_activity_score", sql("SELECT Area_ID, " + " + ".join(f"(Area_ID * {i + 3} % 5) * {w}::DOUBLE" for i, w in enumerate(scores.TIER_WEIGHTS.values())) + " AS score FROM cluster", "cluster"))
def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {t: (F.col("Area_ID") * (i + 3)) % 5 for i, t in enumerate(scores.TIER_WEIGHTS)}
    return cluster(spark, sf_dir).select("Area_ID", scores.activity_score(counts).alias("score"))


@query(
    "s114_disadvantage_flags",
    sql(
        f"SELECT Area_ID, {', '.join(f'CASE WHEN {v} < m AND {v} < 4 AND m - {v} > 3 THEN 1 ELSE 0 END AS char_{p}' for p, v in _CHAR.items())}, {', '.join(f'CASE WHEN {c} < 40 AND NOT (A1 < 40 AND B1 < 40 AND C1 < 40) THEN 1 ELSE 0 END AS local_{p}' for p, c in zip(SIDES, ('A1', 'B1', 'C1'), strict=True))}, {', '.join(f'CASE WHEN greatest(A1, B1, C1) - {c} >= 20 THEN 1 ELSE 0 END AS gap_{p}' for p, c in zip(SIDES, ('A1', 'B1', 'C1'), strict=True))} FROM (SELECT *, greatest({', '.join(_CHAR.values())}) AS m FROM cluster)",
        "cluster",
    ),
)
def disadvantage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = dict(zip(SIDES, (F.col("A1"), F.col("B1"), F.col("C1")), strict=True))
    made = [(f"char_{p}", c) for p, c in scores.charisma_flags(*charisma()).items()]
    made += [(f"local_{p}", c) for p, c in scores.local_flags(shares, 40).items()] + [(f"gap_{p}", c) for p, c in scores.gap_flags(shares).items()]
    return cluster(spark, sf_dir).select("Area_ID", *[c.alias(n) for n, c in made])


#: Fifteen flags of a customer, from the bits of a multiple of its key.
_FLAGS = [f"{q}_{p}" for q in ("national", "ward", "difference", "charisma", "local") for p in SIDES]
_FLAGS_SQL = f"flags AS (SELECT c_custkey AS id, {', '.join(f'(c_custkey * 7919 // {2**i}) % 2 AS {f}' for i, f in enumerate(_FLAGS))} FROM customer)"


def flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[(F.floor(F.col("c_custkey") * 7919 / 2**i) % 2).alias(f) for i, f in enumerate(_FLAGS)])


def _perception_sql() -> str:
    s = {p: f"(national_{p} + ward_{p} + difference_{p})" for p in SIDES}
    behind = {p: f"(CASE WHEN national_{p} = 1 OR (ward_{p} = 1 AND difference_{p} = 1) THEN 1 ELSE 0 END)" for p in SIDES}
    nb, nw = "(" + " + ".join(behind.values()) + ")", "(" + " + ".join(f"{behind[p]} * ward_{p}" for p in SIDES) + ")"
    chosen = {p: f"(CASE WHEN {nb} <= 1 THEN {behind[p]} WHEN {nw} > 0 THEN {behind[p]} * ward_{p} ELSE {behind[p]} * national_{p} END)" for p in SIDES}
    value = {p: f"greatest(0, least(3, floor({s[p]} - (CASE WHEN {s[p]} = 3 THEN 0.75 ELSE 0.5 END) * ((1 - charisma_{p}) + (1 - local_{p})))))" for p in SIDES}
    high = "(" + " + ".join(f"({s[p]} >= 2)::INT" for p in SIDES) + ")"
    dominant = "CASE " + " ".join(f"WHEN {s[p]} < 2 THEN '{scores.LABELS[p]}'" for p in SIDES) + " END || '_Dominance'"
    alone = "(" + " + ".join(chosen.values()) + ") = 1"
    races_ = {p: "Race: " + "_".join(scores.LABELS[q] for q in SIDES if q != p) for p in SIDES}
    label = " ".join(f"WHEN {alone} AND {chosen[p]} = 1 THEN CASE WHEN {value[p]} = 0 THEN 'Head_to_Head' ELSE '{races_[p]}' END" for p in SIDES)
    strength = " ".join(f"WHEN {alone} AND {chosen[p]} = 1 THEN {value[p]}" for p in SIDES)
    return f"SELECT id, CASE WHEN {high} = 2 THEN {dominant} {label} ELSE 'Head_to_Head' END AS perception, CAST(CASE WHEN {high} = 2 THEN 0 {strength} ELSE 0 END AS INT) AS strength FROM flags"


PERCEPTION_SQL = _perception_sql()


@query("s115_perception", sql(PERCEPTION_SQL, more=_FLAGS_SQL))
def perception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_perception(flag_rows(spark, sf_dir)).select("id", "perception", "strength")


@query("s058_flag_patterns", sql(f"SELECT {', '.join(_FLAGS[:6])}, count(*) AS frequency, round(avg(id % 100), 6) AS mean_vote FROM flags GROUP BY {', '.join(_FLAGS[:6])}", more=_FLAGS_SQL))
def flag_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_rows(spark, sf_dir).groupBy(*_FLAGS[:6]).agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg(F.col("id") % 100), 6).alias("mean_vote"))


@query("s116_turnout_factor", sql(f"SELECT id, CASE WHEN perception LIKE '%\\_Dominance' ESCAPE '\\' THEN perception WHEN perception = c THEN CASE WHEN perception = 'Head_to_Head' THEN 'Competitive Head to Head' ELSE perception END ELSE 'Normal Head to Head' END AS factor FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'Head_to_Head' ELSE 'Race: MR_R' END AS c FROM ({PERCEPTION_SQL}))", more=_FLAGS_SQL))
def turnout_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perception(spark, sf_dir).withColumn("c", F.when(F.col("id") % 2 == 0, "Head_to_Head").otherwise("Race: MR_R"))
    return rows.select("id", scores.turnout_factor("perception", "c").alias("factor"))


_PW = (3.0, -0.5, (0.02, -0.03, -0.05), (5.0, 20.0))


def _density_sql() -> str:
    import math

    alpha, b2, (g1, g2, g3), (k1, k2) = _PW
    bs = (b2 + (g2 - g1) * math.log(k1), b2, b2 + (g2 - g3) * math.log(k2))
    piece = lambda b, g: f"exp({alpha}::DOUBLE + ({b!r})::DOUBLE * ln(Area) + ({g!r})::DOUBLE * ln(Area) * ln(Area))"
    return f"CASE WHEN Area < {k1} THEN {piece(bs[0], g1)} WHEN Area < {k2} THEN {piece(bs[1], g2)} ELSE {piece(bs[2], g3)} END"


@query("s117_piecewise_density", sql(f"SELECT Shape_ID, round({_density_sql()}, 6) AS density FROM precinct", "precinct"))
def piecewise_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).select("Shape_ID", F.round(scores.piecewise_density(F.col("Area"), *_PW), 6).alias("density"))


@query("s118_list_explode", sql("SELECT list, party, count(*) AS n FROM sector GROUP BY list, party", "sector"))
def list_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with arrays of parties back to one row for each party."""
    lists = sector(spark, sf_dir).groupBy("list").agg(F.collect_list("party").alias("parties"))
    return lists.select("list", F.explode("parties").alias("party")).groupBy("list", "party").agg(F.count(F.lit(1)).alias("n"))


@query("s180_density_and_population", sql("SELECT Shape_ID, round(Population / nullif(Area, 0), 6) AS density, round(coalesce(nullif(CASE WHEN Shape_ID % 9 = 0 THEN NULL WHEN Shape_ID % 9 = 1 THEN 0 ELSE Population END, 0), Area * 500), 6) AS population FROM precinct", "precinct"))
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("Shape_ID") % 9 == 0, "NA").when(F.col("Shape_ID") % 9 == 1, "0").otherwise(F.col("Population").cast("string"))
    return precinct(spark, sf_dir).select("Shape_ID", F.round(scores.density(F.col("Population"), F.col("Area")), 6).alias("density"), F.round(scores.population_or(text, F.col("Area"), F.lit(500.0)), 6).alias("population"))


@query("s119_percent_text", sql("SELECT Area_ID, printf('%.2f%%', A1 / 3 + 0.0001) AS share FROM cluster", "cluster"))
def percent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, sf_dir).select("Area_ID", num.percent_text(F.col("A1") / 3 + 0.0001).alias("share"))


@query("s120_normal_quantile", f"SELECT c_custkey AS id, round({num.normal_quantile_sql('((c_custkey % 999 + 1) / 1000)')}, 6) AS z FROM customer")
def normal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(num.normal_quantile((F.col("c_custkey") % 999 + 1) / 1000), 6).alias("z"))


# Draws: the same keys give the same numbers in both engines.
_MEAN = "CAST(c_custkey % 40 AS DOUBLE)"


@query("s136_keyed_normal", f"SELECT c_custkey AS id, round({num.keyed_normal_sql('s1', _MEAN, f'{_MEAN} * 0.1', 'c_custkey')}, 4) AS v FROM customer")
def keyed_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = (F.col("c_custkey") % 40).cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(num.keyed_normal("s1", mean, mean * 0.1, "c_custkey"), 4).alias("v"))


_DRAWS = ", ".join(num.keyed_normal_sql("s2", _MEAN, f"{_MEAN} * 0.3", "c_custkey", str(k)) for k in range(1, 5))


@query("s137_gated_draw", f"SELECT id, round(coalesce(g[1], ds[4]), 4) AS v, len(g) = 0 AS unresolved FROM (SELECT id, ds, list_filter(ds, lambda x: (x / m >= 0.8 AND x / m <= 1.1)) AS g FROM (SELECT c_custkey AS id, {_MEAN} + 1 AS m, [{_DRAWS}] AS ds FROM customer))")
def gated_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = (F.col("c_custkey") % 40).cast("double")
    v, unresolved = reconcile.gated_draw("s2", mean, mean * 0.3, ["c_custkey"], 0.8, 1.1, 4, mean + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(v, 4).alias("v"), unresolved.alias("unresolved"))


@query("s138_clamp", sql("SELECT Area_ID, greatest(0, least(A1 * 2 - 50, B1)) AS v FROM cluster", "cluster"))
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, sf_dir).select("Area_ID", reconcile.clamp(F.col("A1") * 2 - 50, F.col("B1")).alias("v"))


@query("s139_reconcile_two", sql("SELECT Area_ID, CASE WHEN A1 >= B1 THEN 300 - B1 - 5 ELSE A1 END AS a, CASE WHEN A1 >= B1 THEN B1 ELSE 300 - A1 - 5 END AS b FROM cluster", "cluster"))
def reconcile_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = reconcile.reconcile_two(F.lit(300), F.lit(5), F.col("A1"), F.col("B1"))
    return cluster(spark, sf_dir).select("Area_ID", a.alias("a"), b.alias("b"))


@query(
    "s140_reconcile_three",
    sql(
        "SELECT Area_ID, max(v) FILTER (i = 0) AS a, max(v) FILTER (i = 1) AS b, max(v) FILTER (i = 2) AS c FROM (SELECT Area_ID, i, CAST(CASE p WHEN 1 THEN least(x1, 120) WHEN 2 THEN least(x2, 120 - least(x1, 120)) ELSE 120 - least(x1, 120) - least(x2, 120 - least(x1, 120)) END AS BIGINT) AS v FROM (SELECT *, row_number() OVER w AS p, first_value(x) OVER w AS x1, nth_value(x, 2) OVER (PARTITION BY Area_ID ORDER BY x, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x2 FROM (SELECT Area_ID, unnest([A1, B1, C1]) AS x, unnest([0, 1, 2]) AS i FROM cluster) WINDOW w AS (PARTITION BY Area_ID ORDER BY x, i))) GROUP BY Area_ID",
        "cluster",
    ),
)
def reconcile_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reconcile.reconcile(F.array(*[F.col(c).cast("long") for c in ("A1", "B1", "C1")]), F.lit(120))
    return cluster(spark, sf_dir).withColumn("d", done).select("Area_ID", F.col("d")[0].alias("a"), F.col("d")[1].alias("b"), F.col("d")[2].alias("c"))


@query("s141_residual_into_largest", sql("SELECT Area_ID, CAST(A1 + CASE WHEN A1 >= B1 AND A1 >= C1 THEN 200 - A1 - B1 - C1 ELSE 0 END AS BIGINT) AS a, CAST(B1 + CASE WHEN B1 > A1 AND B1 >= C1 THEN 200 - A1 - B1 - C1 ELSE 0 END AS BIGINT) AS b, CAST(C1 + CASE WHEN C1 > A1 AND C1 > B1 THEN 200 - A1 - B1 - C1 ELSE 0 END AS BIGINT) AS c FROM cluster", "cluster"))
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reconcile.residual_into_largest(F.array(*[F.col(c).cast("long") for c in ("A1", "B1", "C1")]), F.lit(200).cast("long"))
    return cluster(spark, sf_dir).withColumn("d", done).select("Area_ID", F.col("d")[0].alias("a"), F.col("d")[1].alias("b"), F.col("d")[2].alias("c"))


_PEOPLE = ("S", "A1", "A2")


def _chain_sql() -> str:
    """The chain of draws, a table for each stage; the same keys give the same numbers."""
    stage = ["base AS (SELECT Area_ID, " + ", ".join(f"c.{k} * 100 AS {k}, coalesce(r.{k}, 0) AS rate_{k}" for k in _PEOPLE) + " FROM cluster c LEFT JOIN rate r ON c.Sub_Region = r.Sub_Region)"]
    electorate, turnout, votes = [], [], []
    for k in _PEOPLE:
        mean = f"({k} * rate_{k} / 100)"
        draws = ", ".join(num.keyed_normal_sql("chain", mean, f"{mean} * 0.1", "Area_ID", f"'{k}'", str(i)) for i in range(1, 6))
        electorate.append(f"floor(greatest(0, least((SELECT coalesce(list_filter(d, lambda x: {k} = 0 OR x / {k} BETWEEN 0.45 AND 0.975)[1], d[5]) FROM (SELECT [{draws}] AS d)), {k}))) AS electorate_{k}")
        e = f"electorate_{k}"
        drawn = num.keyed_normal_sql("chain-turnout", f"({e} * 0.6)", f"{e} * 0.06", "Area_ID", f"'{k}'")
        turnout.append(f"floor(greatest(0, least({drawn}, {e}))) AS turnout_{k}")
        valid = f"(turnout_{k} - spoilt_{k})"
        three = [f"CAST(floor(greatest(0, least({num.keyed_normal_sql(f'chain-{s}', f'({valid} / 3)', f'{valid} * 0.05', 'Area_ID', f'{chr(39)}{k}{chr(39)}')}, {valid}))) AS BIGINT)" for s in ("L", "MR", "R")]
        votes.append(f"list_sort([{', '.join(f'{{v: {v}, i: {i}}}' for i, v in enumerate(three))}]) AS o_{k}, CAST({valid} AS BIGINT) AS valid_{k}")
    stage += [f"e_ AS (SELECT *, {', '.join(electorate)} FROM base)", f"t_ AS (SELECT *, {', '.join(turnout)} FROM e_)", f"s_ AS (SELECT *, {', '.join(f'floor(turnout_{k} * 0.01) AS spoilt_{k}' for k in _PEOPLE)} FROM t_)"]
    stage += [f"v_ AS (SELECT *, {', '.join(votes)} FROM s_)", f"w_ AS (SELECT *, {', '.join(f'least(o_{k}[1].v, valid_{k}) AS p1_{k}, least(o_{k}[2].v, valid_{k} - least(o_{k}[1].v, valid_{k})) AS p2_{k}' for k in _PEOPLE)} FROM v_)"]
    out = []
    for k in _PEOPLE:
        out += [f"CAST({c}_{k} AS BIGINT) AS {c}_{k}" for c in ("electorate", "turnout", "spoilt")]
        out += [f"CASE {i} WHEN o_{k}[1].i THEN p1_{k} WHEN o_{k}[2].i THEN p2_{k} ELSE valid_{k} - p1_{k} - p2_{k} END AS votes_{k}_{s}" for i, s in enumerate(("L", "MR", "R"))]
    return sql(f"SELECT Area_ID, {', '.join(out)} FROM w_", "cluster", "rate", more=", ".join(stage))


@query("s142_vote_chain", _chain_sql())
def vote_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People to electorate, turnout, spoilt and three sides' votes, for three clusters of each area."""
    areas = spread(cluster(spark, sf_dir), "Area_ID", 5_000)
    out = sampling.vote_chain(areas.select("Area_ID", "Sub_Region", *[(F.col(c) * 100).alias(c) for c in _PEOPLE]), "Area_ID", list(_PEOPLE), rate(spark, sf_dir), ["Sub_Region"])
    numbers = [F.col(f"{c}_{k}").cast("long").alias(f"{c}_{k}") for k in _PEOPLE for c in ("electorate", "turnout", "spoilt")]
    return out.select("Area_ID", *numbers, *[F.col(f"votes_{k}")[i].alias(f"votes_{k}_{s}") for k in _PEOPLE for i, s in enumerate(("L", "MR", "R"))])


def _referendum_sql() -> str:
    draw = lambda s: f"floor(greatest(0, least({num.keyed_normal_sql(s, '(turnout / 2)', 'turnout * 0.05', 'Area_ID')}, turnout - spoilt)))"
    drawn = f"SELECT *, CAST({draw('yes')} AS BIGINT) AS y, CAST({draw('no')} AS BIGINT) AS n FROM (SELECT Area_ID, CAST(A1 * 50 AS BIGINT) AS turnout, CAST(floor(A1 / 2) AS BIGINT) AS spoilt FROM cluster)"
    return sql(f"SELECT Area_ID, turnout, spoilt, CASE WHEN y >= n THEN turnout - n - spoilt ELSE y END AS yes, CASE WHEN y >= n THEN n ELSE turnout - y - spoilt END AS no FROM ({drawn})", "cluster")


@query("s143_referendum_builder", _referendum_sql())
def referendum_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes and no of each area drawn around halves and reconciled to the turnout less the spoilt."""
    rows = cluster(spark, sf_dir).select("Area_ID", (F.col("A1") * 50).cast("long").alias("turnout"), F.floor(F.col("A1") / 2).alias("spoilt"))
    draw = lambda s: F.floor(reconcile.clamp(num.keyed_normal(s, F.col("turnout") / 2, F.col("turnout") * 0.05, "Area_ID"), F.col("turnout") - F.col("spoilt")))
    yes, no = reconcile.reconcile_two(F.col("turnout"), F.col("spoilt"), draw("yes"), draw("no"))
    return rows.select("Area_ID", "turnout", "spoilt", yes.alias("yes"), no.alias("no"))


@query("s144_capacity", f"SELECT c_custkey AS id, CAST(10 + floor({num.keyed_uniform_sql('cap', 'c_custkey')} * 31) AS BIGINT) AS capacity FROM customer")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), sampling.capacity("cap", "c_custkey", low=10, high=40).alias("capacity"))


_SH = "list_sort([{'v': -A1, 'o': 0, 's': 'L'}, {'v': -B1, 'o': 1, 's': 'MR'}, {'v': -C1, 'o': 2, 's': 'R'}])"


@query(
    "s146_race_by_lot",
    sql(
        f"SELECT Area_ID, CASE WHEN t[2].v - t[1].v < 15 THEN 'Head to Head' ELSE 'Race: ' || t[1].s || '_' || CASE WHEN t[3].v - t[2].v > 15 OR {num.keyed_uniform_sql('lot', 'Area_ID')} < CASE WHEN -t[2].v - t[3].v > 0 THEN t[2].v / (t[2].v + t[3].v) ELSE 0.5 END THEN t[2].s ELSE t[3].s END END AS race FROM (SELECT Area_ID, {_SH} AS t FROM cluster)",
        "cluster",
    ),
)
def race_by_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = dict(zip(SIDES, (F.col("A1"), F.col("B1"), F.col("C1")), strict=True))
    return cluster(spark, sf_dir).select("Area_ID", scores.race_label(shares, shares, num.keyed_uniform("lot", "Area_ID")).alias("race"))


@query(
    "s147_inverse_cdf",
    sql(
        f"SELECT Area_ID, min(k) AS choice FROM (SELECT Area_ID, k, sum(w) OVER (PARTITION BY Area_ID ORDER BY k ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY Area_ID) AS t FROM (SELECT Area_ID, unnest(['a', 'b', 'c']) AS k, unnest([A1, B1, C1]) AS w FROM cluster)) WHERE t > 0 AND {num.keyed_uniform_sql('cdf', 'Area_ID')} * t < c GROUP BY Area_ID",
        "cluster",
    ),
)
def inverse_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster(spark, sf_dir).select("Area_ID", F.col("A1").alias("a"), F.col("B1").alias("b"), F.col("C1").alias("c")).unpivot(["Area_ID"], ["a", "b", "c"], "choice", "w")
    return windows.inverse_cdf(rows, ["Area_ID"], "choice", "w", num.keyed_uniform("cdf", "Area_ID"), "choice")


def _seats_sql(seats: int) -> str:
    return f"""lv AS (SELECT *, sum(lvotes) OVER (PARTITION BY Sector) AS valid FROM (SELECT Sector, list, sum(votes) AS lvotes, count(*) AS np FROM sector GROUP BY Sector, list)),
 q AS (SELECT *, lvotes >= valid * 0.15 AS ok FROM lv), q2 AS (SELECT *, sum(CASE WHEN ok THEN lvotes ELSE 0 END) OVER (PARTITION BY Sector) / {seats} AS quota FROM q),
 f AS (SELECT *, CASE WHEN ok THEN floor(lvotes / quota) ELSE 0 END AS fl, CASE WHEN ok THEN lvotes / quota - floor(lvotes / quota) ELSE -1 END AS rm FROM q2),
 g AS (SELECT *, {seats} - sum(fl) OVER (PARTITION BY Sector) AS lft, row_number() OVER (PARTITION BY Sector ORDER BY rm DESC, lvotes DESC, list) AS pl FROM f),
 h AS (SELECT *, CAST(fl + CASE WHEN ok AND pl <= lft THEN 1 ELSE 0 END AS BIGINT) AS list_seats FROM g),
 p AS (SELECT s.Sector, s.list, s.party, s.votes, h.ok, h.np, h.list_seats, CASE WHEN list_seats > 0 THEN lvotes / list_seats ELSE 0 END AS iq FROM sector s JOIN h USING (Sector, list)),
 pf AS (SELECT *, CASE WHEN iq > 0 THEN floor(votes / iq) ELSE 0 END AS pfl, CASE WHEN iq > 0 THEN votes / iq - floor(votes / iq) ELSE 0 END AS prm FROM p),
 pg AS (SELECT *, list_seats - sum(pfl) OVER (PARTITION BY Sector, list) AS plft, row_number() OVER (PARTITION BY Sector, list ORDER BY prm DESC, votes DESC, party) AS ppl FROM pf),
 seats AS (SELECT Sector, list, party, votes, ok AS qualified, list_seats, CAST(CASE WHEN NOT ok OR np <= 1 OR list_seats = 0 THEN CASE WHEN ok THEN list_seats ELSE 0 END ELSE pfl + CASE WHEN iq > 0 AND ppl <= plft THEN 1 ELSE 0 END END AS BIGINT) AS seats FROM pg)"""


@query("s128_largest_remainder", sql("SELECT Sector, party, CAST(fl + CASE WHEN pl <= 21 - sum(fl) OVER (PARTITION BY Sector) THEN 1 ELSE 0 END AS BIGINT) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY Sector ORDER BY votes / q - fl DESC, votes DESC, party) AS pl FROM (SELECT *, floor(votes / q) AS fl FROM (SELECT *, sum(votes) OVER (PARTITION BY Sector) / 21 AS q FROM sector)))", "sector"))
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = sector(spark, sf_dir).withColumn("q", F.sum("votes").over(Window.partitionBy("Sector")) / 21)
    return proportional.largest_remainder(rows, ["Sector"], "votes", F.col("q"), F.lit(21), "party").select("Sector", "party", "seats")


@query("s129_two_stage_seats", sql("SELECT Sector, list, party, votes, qualified, list_seats, seats FROM seats", "sector", more=_seats_sql(45)))
def two_stage_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportional.two_stage_seats(sector(spark, sf_dir), ["Sector"], 45).select("Sector", "list", "party", "votes", "qualified", "list_seats", "seats")


_BOUND = "bd AS (SELECT Sector, sum(votes) * 1.3 AS bound FROM sector GROUP BY Sector)"
_GUARANTEE = "gt AS (SELECT Sector, list, party, votes, CAST(CASE WHEN sum(votes) OVER (PARTITION BY Sector, list) >= bound * 0.15 THEN floor(votes / (bound / 45)) ELSE 0 END AS BIGINT) AS seats FROM sector JOIN bd USING (Sector))"


@query("s130_guaranteed_seats", sql("SELECT Sector, list, party, votes, seats FROM gt", "sector", more=f"{_BOUND}, {_GUARANTEE}"))
def guaranteed_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sector(spark, sf_dir)
    bounds = rows.groupBy("Sector").agg((F.sum("votes") * 1.3).alias("bound"))
    return proportional.guaranteed_seats(rows.join(bounds, "Sector"), ["Sector"], "bound", 45).select("Sector", "list", "party", "votes", "seats")


#: Zones up to 2 are looked at late, when all of their rows are declared; the others in the middle. Three parties are on two lists.
_FINAL_ZONE = 2
_LISTS = {"Left": "L1", "Right": "L2", "MR": "L1"}
_SO_FAR = f"""st AS (SELECT *, {status_sql(f"(CASE WHEN Zone <= {_FINAL_ZONE} THEN TIMESTAMP '{NOW_LATE}' ELSE TIMESTAMP '{NOW_MID}' END)")} AS status FROM located WHERE Zone > {_FINAL_ZONE} OR declared_at IS NOT NULL),
 {UNITS_SQL.replace("District, Ward", "Zone, Ward")},
 base AS (SELECT Zone, bool_and(status = 'Declared') AS fin, CAST(sum(CASE status WHEN 'Declared' THEN {' + '.join(R1.values())} WHEN 'Counting' THEN Turnout ELSE Electorate END) AS BIGINT) AS bound FROM st GROUP BY Zone),
 tot AS (SELECT Zone, count(*) AS total, count(*) FILTER (done) AS declared FROM unit GROUP BY Zone),
 sector AS ({' UNION ALL '.join(f"SELECT st.Zone AS Sector, '{s}' AS party, '{of}' AS list, CAST(coalesce(sum({R1[s]}) FILTER (status = 'Declared'), 0) + coalesce(any_value(n), 0) AS BIGINT) AS votes FROM st LEFT JOIN (SELECT Zone, count(*) AS n FROM won WHERE winner = '{s}' GROUP BY Zone) w ON st.Zone = w.Zone GROUP BY st.Zone" for s, of in _LISTS.items())}),
 bd AS (SELECT Zone AS Sector, bound + total AS bound, fin AND declared = total AS final FROM base JOIN tot USING (Zone))"""


@query("s131_final_or_provisional", sql("SELECT s.Sector AS Zone, s.list, s.party, s.votes, final, CASE WHEN final THEN s.seats ELSE g.seats END AS seats FROM seats s JOIN gt g ON s.Sector = g.Sector AND s.party = g.party JOIN bd ON bd.Sector = s.Sector", "located", more=f"{_SO_FAR}, {_seats_sql(45)}, {_GUARANTEE}"))
def final_or_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with a derived sector of wards won: final where all rows and wards are declared, else what is guaranteed."""
    now = F.when(F.col("Zone") <= _FINAL_ZONE, F.lit(NOW_LATE).cast("timestamp")).otherwise(F.lit(NOW_MID).cast("timestamp"))
    rows = tally.with_status(located(spark, sf_dir).filter((F.col("Zone") > _FINAL_ZONE) | F.col("declared_at").isNotNull()), now)
    wards = units.council_totals(rows, units.unit_winners(rows, ["Zone", "Ward"]), "Zone", "Ward")
    parties = {s: (_LISTS[s], v) for s, v in first_preferences().items()}
    return proportional.seats_so_far(rows, ["Zone"], parties, 45, wards)


@query("s067_bound_by_party_sum", sql("SELECT Constituency, CAST(sum(CASE status WHEN 'Declared' THEN Left_Left + Left_Right + Left_MR + MR_MR WHEN 'Counting' THEN Turnout ELSE Electorate END) AS BIGINT) AS bound FROM st GROUP BY Constituency", "located", more=STATUS_MID))
def bound_by_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = num.total(["Left_Left", "Left_Right", "Left_MR", "MR_MR"])
    return tally.with_status(located(spark, sf_dir), NOW_MID).groupBy("Constituency").agg(tally.safe_vote_bound(valid).alias("bound"))

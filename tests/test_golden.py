"""Worked examples with known results, and rules that hold at their borders."""

import itertools

import pyspark.sql.functions as F
import pytest

from hustings.functions import numbers as num
from hustings.functions import status as st
from hustings.operators import joins, methods, proportional, reconcile, tally, windows
from hustings.operators.graph import connected_components

LISTS = {"NRD": "L", "LRP": "L", "GRF": "G", "Right": "R"}


def votes(spark, right=24_509):
    rows = [("x", LISTS[p], p, v) for p, v in (("NRD", 36_894), ("LRP", 31_142), ("GRF", 67_288), ("Right", right))]
    return spark.createDataFrame(rows, "c string, list string, party string, votes bigint")


def test_two_stage_seats(spark):
    out = proportional.two_stage_seats(votes(spark), ["c"], 45).collect()
    assert {r.party: r.seats for r in out} == {"NRD": 10, "LRP": 9, "GRF": 19, "Right": 7}
    assert {r.list: r.list_seats for r in out} == {"L": 19, "G": 19, "R": 7}
    assert round(out[0].quota, 2) == 3551.84


def test_gated_list(spark):
    out = proportional.two_stage_seats(votes(spark, 5_000), ["c"], 45).collect()
    assert {r.party: r.seats for r in out}["Right"] == 0
    assert sum(r.seats for r in out) == 45


def test_guaranteed_minimum(spark):
    rows = spark.createDataFrame([("x", "G", "GRF", 160), ("x", "O", "Other", 40)], "c string, list string, party string, votes bigint")
    out = {r.party: r.seats for r in proportional.guaranteed_seats(rows.withColumn("bound", F.lit(1000)), ["c"], "bound", 45).collect()}
    assert out == {"GRF": 7, "Other": 0}


def test_guaranteed_seats_never_fall(spark):
    """As sectors declare, the bound falls to the votes themselves and no seat that was sure is lost."""
    final = {"NRD": 3_689, "LRP": 3_114, "GRF": 6_728, "Right": 2_450}
    steps = []
    for k in range(11):
        bound = 16_500 - k * (16_500 - sum(final.values())) / 10
        steps += [(k, LISTS[p], p, int(v * k / 10), float(bound)) for p, v in final.items()]
    rows = spark.createDataFrame(steps, "k int, list string, party string, votes bigint, bound double")
    out = {(r.k, r.party): r.seats for r in proportional.guaranteed_seats(rows, ["k"], "bound", 45).collect()}
    exact = {r.party: r.seats for r in proportional.two_stage_seats(rows.filter("k = 10").drop("bound"), ["k"], 45).collect()}
    for p in final:
        line = [out[k, p] for k in range(11)]
        assert line == sorted(line) and line[-1] <= exact[p]


SUMS = {f"{a}_{b}": 0 for a in methods.SIDES for b in methods.SIDES}


def contest(spark, **more):
    row = SUMS | more
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


def test_runoff(spark):
    out = methods.supplementary_vote(contest(spark, Left_Left=1000, Right_Right=900, MR_Left=120, MR_Right=50, MR_MR=30)).first()
    assert (out.eliminated, out.r2_Left, out.r2_Right, out.r2_MR, out.nil, out.winner, out.tie) == ("MR", 1120, 950, None, 30, "Left", False)


def test_majority_and_tie(spark):
    out = methods.supplementary_vote(contest(spark, Left_Left=60, Right_Right=40)).first()
    assert (out.majority_winner, out.eliminated, out.winner) == ("Left", None, "Left")
    out = methods.supplementary_vote(contest(spark, Left_Left=50, Right_Right=50)).first()
    assert (out.majority_winner, out.eliminated, out.winner, out.tie) == (None, "MR", None, True)


@pytest.mark.parametrize(("undecided", "certain"), [(49, True), (50, False)])
def test_certainty_border(spark, undecided, certain):
    sums = contest(spark, Left_Left=150, Right_Right=50, MR_MR=50).withColumn("undecided", F.lit(undecided))
    out = methods.with_certainty(methods.supplementary_vote(sums)).first()
    assert (out.stage == "round1-majority") is certain


def brute_vote(row):
    first = {a: sum(row[f"{a}_{b}"] for b in methods.SIDES) for a in methods.SIDES}
    valid = sum(first.values())
    for s in methods.SIDES:
        if valid and 2 * first[s] > valid:
            return s
    out = min(methods.SIDES, key=lambda s: first[s])
    a, b = (s for s in methods.SIDES if s != out)
    x, y = first[a] + row[f"{out}_{a}"], first[b] + row[f"{out}_{b}"]
    return a if x > y else b if y > x else None


def test_many_contests(spark):
    rows = [SUMS | dict(zip(SUMS, v, strict=True)) for v in itertools.islice(itertools.product((0, 3, 5), repeat=9), 0, 19683, 29)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} bigint" for k in SUMS))
    assert [r.winner for r in methods.supplementary_vote(df).collect()] == [brute_vote(r) for r in rows]


def test_status_order(spark):
    rows = spark.createDataFrame([(None, None, None), ("2026-01-01", None, None), ("2026-01-01", "2026-01-02", None), (None, None, "2026-01-01"), ("2026-02-01", None, None)], "r string, v string, d string")
    timed = rows.select(num.to_time("r").alias("received_at"), num.to_time("v").alias("verified_at"), num.to_time("d").alias("declared_at"))
    assert [r[0] for r in timed.select(st.status("2026-01-15")).collect()] == [st.NOT_RECEIVED, st.VERIFYING, st.COUNTING, st.DECLARED, st.NOT_RECEIVED]


def test_percent_is_weighted(spark):
    rows = spark.createDataFrame([(100, st.DECLARED), (900, st.COUNTING)], "Electorate bigint, status string")
    assert rows.agg(tally.percent_declared()).first()[0] == 10


@pytest.mark.parametrize(("remaining", "final"), [(10, False), (4, True), (5, False), (0, True)])
def test_margin_safe(spark, remaining, final):
    margin, done = methods.margin_safe(F.lit(12), F.lit(7), F.lit(remaining), F.lit("A"))
    assert tuple(spark.range(1).select(margin, done).first()) == (5, final)


def test_blank_cells_count_nothing(spark):
    rows = spark.createDataFrame([("",), (" 12 ",), ("x",), (None,)], "a string")
    assert [r[0] for r in rows.select(num.to_number("a")).collect()] == [0, 12, 0, 0]


def test_rounding(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "a double")
    assert [r[0] for r in rows.select(num.half_up("a")).collect()] == [1, 2, 3, 0]
    assert [r[0] for r in rows.select(num.half_even("a")).collect()] == [0, 2, 2, 0]


def test_missing_rates_are_told(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, S double")
    rates = spark.createDataFrame([("a", 10.0)], "k string, S double")
    with pytest.raises(joins.MissingRates):
        joins.apply_rates(base, rates, ["k"], ["S"])
    out = joins.apply_rates(base, rates, ["k"], ["S"], on_missing="zero").orderBy("k").collect()
    assert [r.S for r in out] == [10.0, 0.0]


def test_reconcile_keeps_totals(spark):
    rows = spark.createDataFrame([([7, 9, 4], 15), ([50, 1, 2], 10), ([0, 0, 0], 6), ([5], 9)], "v array<bigint>, t bigint")
    out = [r[0] for r in rows.select(reconcile.reconcile(F.col("v"), F.col("t"))).collect()]
    assert out == [[7, 4, 4], [7, 1, 2], [0, 0, 6], [9]]


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1040)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (None, 7), (3, 2), (2, 3)], "src bigint, dst bigint")
    found = {r.id: r.component for r in connected_components(edges).collect()}
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in range(1000, 1040)} == {1000}
    assert found[2] == found[3] == 2 and 5 not in found and 7 not in found
    assert connected_components(edges.limit(0)).count() == 0


def test_numbers_longer_than_their_padding_stay_whole(spark):
    rows = spark.range(1, 1201).select("id", F.lit("g").alias("grp"), F.cos(F.col("id") / 200).alias("x"), F.sin(F.col("id") / 200).alias("y"))
    out = [r.new_id for r in windows.clockwise_ids(rows, ["grp"], F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit("G-")).collect()]
    assert sorted(out) == sorted(f"G-{n:03d}" for n in range(1, 1201))
    used = rows.filter("id <> 7 and id <> 1100").select("grp", "id")
    wanted = spark.createDataFrame([("g", 4)], "grp string, n int")
    assert {r.new_id for r in windows.free_ids(used, "grp", "id", wanted, "n").collect()} == {"g_007", "g_1100", "g_1201", "g_1202"}

"""Every registered query of the library against its SQL on the smallest tables; those without SQL run and keep their invariants."""

import pytest

from comparing import assert_same
from hustings.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_slots_never_overlap(spark, sf):
    rows = QUERIES["s086_earliest_free_slot"](spark, sf).toPandas()
    assert rows["slot"].min() == 0
    for _, g in rows.groupby(["Ward", "slot"]):
        assert g.sort_values("Result_ID")["done"].is_monotonic_increasing


def test_vote_chain_sums(spark, sf):
    for r in QUERIES["s142_vote_chain"](spark, sf).collect():
        for c in ("S", "A1", "A2"):
            assert 0 <= r[f"turnout_{c}"] <= r[f"electorate_{c}"]
            votes = [r[f"votes_{c}_{s}"] for s in ("L", "MR", "R")]
            assert sum(votes) == r[f"turnout_{c}"] - r[f"spoilt_{c}"] and min(votes) >= 0


def test_referendum_sums(spark, sf):
    for r in QUERIES["s143_referendum_builder"](spark, sf).collect():
        assert r.yes + r.no + r.spoilt == r.turnout


def test_overlaps_touch_grown_squares(spark, sf):
    rows = QUERIES["s045_overlaps"](spark, sf).collect()
    assert {r.a == -1 for r in rows} == {True, False}
    assert all(r.a == -1 or r.a % 7 == 0 or r.b % 7 == 0 for r in rows)


def test_labels_stay_valid_and_anchored(spark, sf):
    rows = QUERIES["s153_blended_labels"](spark, sf).collect()
    again = {(r.id, r.type) for r in QUERIES["s153_blended_labels"](spark, sf).collect()}
    assert {(r.id, r.type) for r in rows} == again
    for r in rows:
        if r.frozen:
            assert r.type == f"C{r.id % 4 + 1}"
        else:
            assert (r.key + int(r.type[1])) % 3 != 0


def test_insertions_lie_half_way(spark):
    rows = QUERIES["s166_insertions"](spark, "/root/testdata/sf0.01").collect()
    assert rows and {r.t for r in rows} == {0.5}


def test_redundant_vertices_are_those_of_the_whole_layer(spark, sf, monkeypatch):
    from hustings.operators import topology

    seen = []
    found = topology.redundant_vertices
    monkeypatch.setattr(topology, "redundant_vertices", lambda rows: seen.append(rows) or found(rows))
    keys = {r.key for r in QUERIES["s165_redundant_vertices"](spark, sf).collect()}
    ids = [r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    assert sorted(r.id for r in seen[0].collect()) == sorted(ids)
    assert keys == {f"0.0,{i // 20 + 0.5}" for i in ids if i % 20 == 0}


def test_loops_of_gaps_and_corners(spark):
    """A ring of eight squares around a gap, two squares that touch at a corner, and a chain that does not close."""
    import pyspark.sql.functions as F

    from hustings.functions import geometry as g
    from hustings.operators import topology

    def square(i, x, y):
        return (i, f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))")

    rows = [square(3 * x + y, x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [square(20, 10, 10), square(21, 11, 11)]
    edge = topology.directed_edges(spark.createDataFrame(rows, "id bigint, geometry string").select("id", g.parse_wkt("geometry").alias("rings")))
    out = topology.loops(topology.border(edge)).toPandas()
    loops = {k: v.sort_values("place") for k, v in out.groupby("loop")}
    assert sorted((len(v), v["area"].iloc[0]) for v in loops.values()) == [(4, -1.0), (4, 1.0), (4, 1.0), (12, 9.0)]
    for v in loops.values():
        assert v["place"].tolist() == list(range(len(v))) and v["closed"].all()
        assert v["b"].tolist() == [*v["a"].tolist()[1:], v["a"].iloc[0]]
    chain = topology.loops(topology.border(edge).filter((F.col("id") == 20) & (F.col("pos") < 3))).toPandas().sort_values("place")
    assert not chain["closed"].any() and len(chain) == 3


def test_insertions_into_all_blocks(spark, sf):
    ids = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    corners = {}
    for i in ids:
        for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)):
            corners.setdefault((i % 20 + x, i // 20 + y), set()).add(i)
    want = {(i, f"{i % 20}.0,{i // 20 + 1}.0") for i in ids if corners[i % 20, i // 20 + 1] - {i}}
    assert {(r.id, r.key) for r in QUERIES["s166_insertions"](spark, sf).collect()} == want

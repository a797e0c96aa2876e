"""Plans and steps that must stay as they are when tables grow."""

import os
import time

import pyspark.sql.functions as F
import pytest

from comparing import assert_same
from hustings.functions import geometry as g
from hustings.operators import spatial, topology
from hustings.plans import registry
from hustings.shared import spread

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries whose joins have two sides that grow: neither may be sent out whole.
NOT_SENT = [
    "s043_adjacency_by_edge",
    "s043_adjacency_by_overlap",
    "s044_candidate_pairs",
    "s046_point_in_shape",
    "s154_valid_priors",
    "s160_vertex_classes",
    "s161_outer_boundary",
    "s166_insertions",
]


@pytest.mark.parametrize("name", NOT_SENT)
def test_growing_sides_are_not_sent_out(spark, sf, name):
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def pairs_met(spark, monkeypatch, join):
    """How many pairs ``within`` gives while ``join`` runs."""
    found, plain = [], spatial.within

    def counted(*args, **kwargs):
        found.append(plain(*args, **kwargs))
        return found[-1]

    monkeypatch.setattr(spatial, "within", counted)
    return join().collect(), sum(f.count() for f in found)


def crowds(spark):
    points = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(200)], "id long, x double, y double")
    return points, spark.createDataFrame([(i, "ab"[i % 2], 0.0, float(i % 4)) for i in range(200)], "rid long, kind string, rx double, ry double")


def test_tier_counts_of_crowds_pair_places(spark, monkeypatch):
    points, others = crowds(spark)
    rows, n = pairs_met(spark, monkeypatch, lambda: spatial.tier_counts(points, others, [1.0, 2.0]))
    want = {(0, "a"): (50, 50), (0, "b"): (50, 0), (1, "a"): (50, 0), (1, "b"): (0, 50)}
    assert len(rows) == 400 and n <= 16
    assert all((r.tier_0, r.tier_1) == want[r.id % 2, r.kind] for r in rows)


def test_overlaps_where_the_layer_goes_on_above_the_outline(spark, sf, tmp_path):
    for name in os.listdir(sf):
        if name != "part.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey + 79940 AS p_partkey", "* EXCEPT (p_partkey)").coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "part.parquet")
    assert_same(QUERIES["s045_overlaps"](spark, str(tmp_path)), SQL["s045_overlaps"], str(tmp_path))


def test_nearest_of_crowds_pairs_places(spark, monkeypatch):
    points, others = crowds(spark)
    rows, n = pairs_met(spark, monkeypatch, lambda: spatial.nearest_within(points, others, 1.0))
    assert {(r.id % 2, r.rid, r.distance) for r in rows} == {(0, 0, 0.0), (1, 0, 1.0)}
    assert len(rows) == 200 and n <= 8


def test_ring_functions_take_a_step_a_point(spark):
    n = 30_000
    ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: g.point(i.cast("double"), (i * i / n).cast("double")))
    began = time.monotonic()
    row = spark.range(1).select(F.array(ring).alias("rings")).select(g.area("rings").alias("area"), g.perimeter(F.col("rings")[0]).alias("perimeter"), g.centroid(F.col("rings")[0]).alias("c")).first()
    assert time.monotonic() - began < 20
    assert row.area == pytest.approx(n * n / 6, rel=1e-6) and row.c.x == pytest.approx(n / 2, rel=1e-6) and row.perimeter > n


def test_rows_are_dealt_by_their_number(spark):
    rows = spread(spark.range(1000).coalesce(1), "id", 100)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000


def test_a_draw_hashes_its_keys_once(spark, sf):
    """Three clusters of each area: a draw for the electorate, which attempts share, one for the turnout and one for each of three sides."""
    plan = QUERIES["s142_vote_chain"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 3 * 5


def test_nearest_centres_of_crowds_take_places(spark, monkeypatch):
    """1,000 points of four places among 300 centres: the rows that are kept on the way are of places, and of few cells for each."""
    kept, plain = [], spatial.materialize

    def counted(df):
        kept.append(plain(df))
        return kept[-1]

    monkeypatch.setattr(spatial, "materialize", counted)
    points = [(i, 0, float(i % 2) * 7 + 0.3, float(i % 4) * 5) for i in range(1000)]
    centres = [(0, i * 37 % 101 / 4.0, i * 53 % 89 / 4.0) for i in range(300)]
    rows = spatial.nearest_centre(spark.createDataFrame(points, "id long, grp int, x double, y double"), spark.createDataFrame(centres, "grp int, cx double, cy double"), "grp").collect()
    want = {(x, y): min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for _, a, b in centres) for _, _, x, y in points}
    assert len(rows) == 1000 and all(r.distance == pytest.approx(want[points[r.id][2:]]) for r in rows)
    assert all(t.count() <= 4 for t in kept if "x" in t.columns)


def test_a_shape_is_read_once(spark, sf):
    assert QUERIES["s168_dissolve"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_compactness_goes_around_a_ring_once(spark, sf):
    assert QUERIES["s098_compactness"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("SQRT(") == 1


def test_vertices_read_texts_after_they_are_dealt(spark, sf):
    for name in ("s161_outer_boundary", "s165_redundant_vertices"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == 1 and plan.index("regexp_extract(") < plan.index("RepartitionByExpression")


def test_redundant_vertices_look_at_neighbours_on_lines_only(spark):
    """A square with a midpoint on one side: its corners have no neighbours to count; a midpoint that is another shape's corner is none."""
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.0), (0.0, 2.0), (0.0, 1.0)]]
    dented = [[(0.0, 1.0), (0.0, 0.0), (-2.0, 0.0), (-2.0, 1.0)]]
    rows = topology.redundant_vertices(spark.createDataFrame([(1, square), (2, dented)], f"id long, rings {g.RINGS}"))
    assert [r.key for r in rows.collect()] == ["1.0,2.0"]
    assert "CASE WHEN NOT" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_layer_statistics_deal_vertices_by_their_number(spark, monkeypatch):
    """A row of 100 squares with a hole each; the first comes as two rows."""
    dealt, plain = [], topology.spread
    monkeypatch.setattr(topology, "DEALT", 100)
    monkeypatch.setattr(topology, "spread", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    ring = lambda *points: F.array(*[g.point(F.col("id") + x, F.lit(y)) for x, y in points])
    rings = F.array(ring((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)), ring((0.25, 0.25), (0.5, 0.25), (0.25, 0.5)))
    shapes = spark.range(100).select("id", rings.alias("rings"))
    row = topology.layer_statistics(topology.vertices(shapes.unionByName(shapes.filter("id = 0")).coalesce(1))).first()
    assert row.asDict() == {"shapes": 100, "vertices": 707, "holes": 100, "shared_vertices": 198}
    assert [d.rdd.getNumPartitions() for d in dealt] == [8, 8]

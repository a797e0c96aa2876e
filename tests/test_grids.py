"""Joins through grid cells against plain loops: star-shaped and long shapes, holes, crowds, and points on lines."""

import math
import random

import pyspark.sql.functions as F
import pytest

from hustings.operators import graph, grids, spatial, topology

RINGS = "id long, rings array<array<struct<x:double,y:double>>>"


def star(r, cx, cy, radius, n):
    return [(cx + radius * (0.3 + 0.7 * r.random()) * math.cos(2 * math.pi * i / n), cy + radius * (0.3 + 0.7 * r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def layer():
    """One shape of 3,000 vertices with a hole, squares side by side, a tiny one, a very long one, and some sixty more."""
    r = random.Random(1)
    squares = [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(4, 0), (8, 0), (8, 4), (4, 4)]]]
    long = [[(-7.5, -1000), (-7.25, -1000), (-7.25, 1000), (-7.5, 1000)]]
    more = [[star(r, r.uniform(-100, 100), r.uniform(-100, 100), r.uniform(1, 15), r.randint(3, 40))] for _ in range(60)]
    return list(enumerate([[star(r, 0, 0, 100, 3000), star(r, 0, 0, 20, 50)], *squares, [star(r, -50, 20, 30, 17)], [star(r, 3, 3, 0.01, 9)], long, *more]))


@pytest.fixture(scope="module")
def shapes():
    return layer()


@pytest.fixture(scope="module")
def table(spark, shapes):
    return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in shapes], RINGS)


def sides(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def inside(x, y, rings):
    hits = sum((b > y) != (q > y) and x < (p - a) * (y - b) / (q - b) + a for (a, b), (p, q) in sides(rings))
    return hits % 2 == 1


def side(p, q, v):
    return (q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0])


def crossing_counts(shapes):
    cross = lambda p, q, u, v: side(p, q, u) * side(p, q, v) < 0 and side(u, v, p) * side(u, v, q) < 0
    found = {(a, b): sum(cross(*s, *t) for s in sides(ra) for t in sides(rb)) for k, (a, ra) in enumerate(shapes) for b, rb in shapes[k + 1 :]}
    return {k: n for k, n in found.items() if n}


def test_points_in_shapes(spark, shapes, table):
    r = random.Random(2)
    points = [(i, r.uniform(-110, 110), r.uniform(-110, 110)) for i in range(800)] + [(2000 + 20 * i + j, float(i), float(j)) for i in range(-2, 9) for j in range(-2, 9)]
    points += [(5000 + i, 3 + r.uniform(-0.01, 0.01), 3 + r.uniform(-0.01, 0.01)) for i in range(100)]
    got = [tuple(x) for x in spatial.containing(spark.createDataFrame(points, "pid long, px double, py double"), table).collect()]
    assert sorted(got) == sorted((p, i) for p, x, y in points for i, rings in shapes if inside(x, y, rings))


def test_a_border_cell_has_a_few_of_many_edges(table):
    found = spatial.shape_index(table.filter("id = 0")).agg(F.max(F.size("edges")), F.count(F.lit(1))).first()
    assert found[0] <= 60 and found[1] < 4000


def test_crossings_and_overlaps_with_holes(shapes, table):
    counts = crossing_counts(shapes)
    assert {(x.a, x.b): x.crossings for x in spatial.crossings(table).collect()} == counts
    within = lambda ra, rb: sum(inside(x, y, rb) for ring in ra for x, y in ring)
    want = {}
    for k, (a, ra) in enumerate(shapes):
        for b, rb in shapes[k + 1 :]:
            row = (within(ra, rb), within(rb, ra), counts.get((a, b), 0))
            if max(row[:2]) > 2 or row[2] > 2:
                want[a, b] = row
    assert {(x.a, x.b): (x.inside_a, x.inside_b, x.crossings) for x in spatial.overlaps(table).collect()} == want


def test_candidate_pairs_of_boxes_of_all_sizes(shapes, table):
    box = {i: (min(x for r in q for x, _ in r), min(y for r in q for _, y in r), max(x for r in q for x, _ in r), max(y for r in q for _, y in r)) for i, q in shapes}
    got = [tuple(x) for x in spatial.candidate_pairs(table).collect()]
    assert sorted(got) == sorted((a, b) for a in box for b in box if a < b and box[a][0] <= box[b][2] and box[b][0] <= box[a][2] and box[a][1] <= box[b][3] and box[b][1] <= box[a][3])


def test_cells_along_a_line(spark):
    r = random.Random(4)
    lines = [(r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-50, 50)) for _ in range(60)] + [(0.0, 0.0, 40.0, 40.0), (3.0, -7.0, 3.0, 9.5), (-8.0, 2.0, 9.0, 2.0), (1.5, 1.5, 1.5, 1.5)]
    df = spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double")
    for level in (0, 2):
        for row in df.select("*", grids.line_cells(*[F.col(c) for c in df.columns], F.lit(level)).alias("cells")).collect():
            cells = [tuple(c) for c in row.cells]
            assert len(cells) == len(set(cells)) <= 4 + 2 * (abs(row.x1 - row.x2) + abs(row.y1 - row.y2)) / 2**level
            for i in range(1001):
                x, y = row.x1 + (row.x2 - row.x1) * i / 1000, row.y1 + (row.y2 - row.y1) * i / 1000
                assert (math.floor(x / 2**level), math.floor(y / 2**level)) in cells


def test_insertions_on_slanted_edges_of_all_lengths(spark):
    r = random.Random(5)
    edges = [(i, 0, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(30)] + [(30, 0, -5000.0, -5000.0, 5000.0, 5000.0), (31, 0, 1.0, 1.0, 1.0, 1.0)]
    vertices, want = [], set()
    for i, _, x1, y1, x2, y2 in edges[:31]:
        for k, t in enumerate((0.0, 0.25, 0.5, 1.0)):
            vertices.append((100 + i, f"{i}/{k}", x1 + (x2 - x1) * t, y1 + (y2 - y1) * t))
            if t in (0.25, 0.5):
                want.add((i, f"{i}/{k}", t))
    vertices.append((40, "on the long one", 1234.5, 1234.5))
    want.add((30, "on the long one", round((1234.5 + 5000) / 10000, 9)))
    out = topology.insertions(spark.createDataFrame(vertices, "id long, key string, x double, y double"), spark.createDataFrame(edges, "id long, pos int, x1 double, y1 double, x2 double, y2 double"), 0.5)
    assert {(x.id, x.key, x.t) for x in out.collect()} == want


def test_snapping_is_by_nearness(spark):
    rows = [(1, 0.4999, 0.0), (2, 0.5001, 0.0), (3, 0.01, 5.0), (4, 0.49, 5.0), (5, None, 1.0), (6, 9.0, 9.0)] + [(10 + i, 20 + 0.0001 * (i % 100), 20 + 0.0001 * (i // 100)) for i in range(3000)]
    got = {r.id: (r.sx, r.sy) for r in topology.snap(spark.createDataFrame(rows, "id int, x double, y double"), 0.05).collect()}
    assert got[1] == got[2] == (0.5, 0.0) and got[3] == (0.01, 5.0) and got[4] == (0.49, 5.0) and got[5] == (None, None) and got[6] == (9.0, 9.0)
    assert len({got[10 + i] for i in range(3000)}) == 1 and len(got) == len(rows)


def test_snapped_groups_are_not_wide(spark):
    rows = [(i, i * 0.03, 0.0) for i in range(400)]
    moved = topology.snap(spark.createDataFrame(rows, "id int, x double, y double"), 0.05).collect()
    assert max(abs(r.x - r.sx) for r in moved) < 0.1 and 120 <= len({r.sx for r in moved}) <= 400


def test_colours_of_neighbours_differ(spark):
    r = random.Random(6)
    edges = {tuple(sorted(r.sample(range(200), 2))) for _ in range(700)} | {(0, i) for i in range(1, 150)}
    nodes = spark.range(203)
    colour = {x.id: x.colour for x in graph.colour_rounds(nodes, spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert set(colour) == set(range(203)) and all(colour[a] != colour[b] for a, b in edges)
    assert colour[202] == 0 and graph.colour_rounds(nodes, spark.createDataFrame([], "src long, dst long")).filter("colour <> 0").count() == 0


def test_nearest_of_many_centres(spark):
    r = random.Random(7)
    centres = [(g, r.gauss(0, 1) if g else r.uniform(-100, 100), r.gauss(0, 1)) for g in (0, 1) for _ in range(300)] + [(2, 5.0, 5.0)] * 40 + [(3, 1.0, 1.0), (3, 2.0, 2.0)] + [(4, None, 1.0)]
    points = [(i, i % 6, r.uniform(-150, 150), r.choice([0.0, r.uniform(-90, 90)])) for i in range(600)]
    out = spatial.nearest_centre(spark.createDataFrame(points, "id int, grp int, x double, y double"), spark.createDataFrame(centres, "grp int, cx double, cy double"), "grp")
    want = {i: min(math.hypot(x - cx, y - cy) for g, cx, cy in centres if g == k and cx is not None) for i, k, x, y in points if k < 4}
    got = {x.id: x.distance for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def clusters(points, eps):
    parent = {i: i for i, *_ in points}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lone = set(parent)
    for k, (i, x, y) in enumerate(points):
        for j, u, v in points[k + 1 :]:
            if math.hypot(x - u, y - v) <= eps:
                lone -= {i, j}
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: None if i in lone else find(i) for i in parent}


def test_clusters_of_crowds_and_chains(spark):
    r = random.Random(8)
    points = [(i, r.gauss(0, 0.4), r.gauss(0, 0.4)) for i in range(700)] + [(1000 + i, 10 + i * 0.99, 3.0) for i in range(30)] + [(2000 + i, 10.0 + i * 1.01, -30.0) for i in range(10)]
    points += [(3000 + i, r.uniform(-20, 20), r.uniform(-20, 20)) for i in range(150)] + [(4000 + i, 0.705 if i % 2 else 1.72, 50.0) for i in range(6)]
    got = {x.id: x.cluster for x in spatial.dense_clusters(spark.createDataFrame(points, "id int, x double, y double"), 1.0).collect()}
    assert got == clusters(points, 1.0)


def test_two_crowds_in_neighbouring_cells_make_few_rows(spark, monkeypatch):
    seen = []
    kept = spatial.materialize
    monkeypatch.setattr(spatial, "materialize", lambda df: seen.append(kept(df)) or seen[-1])
    r = random.Random(9)
    crowd = [(i, r.uniform(0, 0.7) + 0.72 * (i % 2), r.uniform(0, 0.7)) for i in range(20000)]
    out = spatial.dense_clusters(spark.createDataFrame(crowd, "id int, x double, y double"), 1.0)
    assert out.filter("cluster = 0").count() == 20000
    assert sum(t.count() for t in seen if "p" in t.columns) < 2000

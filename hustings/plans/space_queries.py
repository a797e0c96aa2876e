"""Queries on points, shapes, layers, graphs and streams."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.functions import geometry as g
from hustings.functions import numbers as num
from hustings.operators import graph, spatial, topology
from hustings.plans.adapters import brick, cell, plot, point, sql, table
from hustings.plans.registry import query
from hustings.shared import by_shuffle, materialize, spread


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell(spark, sf_dir).select("id", "grp", g.parse_wkt("geometry").alias("rings"))


@query("s009_wkt_export", sql("SELECT id, 'POLYGON ((' || i || ' ' || j || ', ' || (i + 1) || ' ' || j || ', ' || (i + 1) || ' ' || (j + 1) || ', ' || i || ' ' || (j + 1) || ', ' || i || ' ' || j || '))' AS wkt FROM cell", "cell"))
def wkt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("id", g.to_wkt("rings").alias("wkt"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot(spark, sf_dir).select("id", g.parse_wkt("geometry").alias("rings"))


@query("s095_ring_math", sql("SELECT id, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(cx, 6) AS cx, round(cy, 6) AS cy, x0, y1, clockwise FROM plot", "plot"))
def ring_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes, slanted edges, dents and reversed rings."""
    ring = F.col("rings")[0]
    rows = plots(spark, sf_dir).select("id", g.area("rings").alias("area"), g.perimeter(ring).alias("perimeter"), g.centroid(ring).alias("c"), g.bbox(ring).alias("b"), g.is_clockwise(ring).alias("clockwise"))
    return rows.select("id", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), "b.x0", "b.y1", "clockwise")


@query("s096_wkt_parse", sql("SELECT id, CASE WHEN id % 10 = 3 THEN 0 ELSE 5 END AS n_points FROM cell", "cell"))
def wkt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text is broken: it has no points, and nothing fails."""
    rows = cell(spark, sf_dir).select("id", g.parse_wkt(F.when(F.col("id") % 10 == 3, F.substring("geometry", 3, 20)).otherwise(F.col("geometry"))).alias("r"))
    return rows.select("id", F.coalesce(F.size(F.get("r", F.lit(0))), F.lit(0)).alias("n_points"))


@query("s097_close_and_simplify", sql("SELECT id, n + 1 AS n_more, n AS n_less, n + 1 AS n_closed FROM (SELECT id, CASE f WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 4 END AS n FROM plot)", "plot"))
def close_and_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A midpoint is put on the first edge, straight or slanted, and taken out again; the ring is closed afterwards."""
    ring = F.col("rings")[0]
    opened = g.open_ring(ring)
    middle = g.point((opened[0]["x"] + opened[1]["x"]) / 2, (opened[0]["y"] + opened[1]["y"]) / 2)
    rows = plots(spark, sf_dir).withColumn("more", F.concat(F.slice(opened, 1, 1), F.array(middle), F.slice(opened, 2, 10)))
    done = rows.withColumn("less", g.simplify_ring(F.col("more")))
    return done.select("id", F.size("more").alias("n_more"), F.size("less").alias("n_less"), F.size(g.close_ring(g.round_ring(F.col("less"), 3))).alias("n_closed"))


@query("s098_compactness", sql("SELECT id, round(4 * pi() * area / (perimeter * perimeter), 6) AS compactness FROM plot", "plot"))
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots(spark, sf_dir).select("id", F.round(g.compactness(g.area("rings"), g.perimeter(F.col("rings")[0])), 6).alias("compactness"))


_LASSO = [(10.0, 10.0), (60.0, 12.0), (55.0, 70.0), (30.0, 40.0), (12.0, 66.0)]


def _lasso_sql() -> str:
    terms = []
    for (px, py), (qx, qy) in zip(_LASSO, _LASSO[1:] + _LASSO[:1], strict=True):
        terms.append(f"((({py} > y) <> ({qy} > y)) AND x < ({qx} - {px})::DOUBLE * (y - {py}) / ({qy} - {py}) + {px})::INT")
    return f"SELECT id FROM point WHERE ({' + '.join(terms)}) % 2 = 1"


@query("s022_lasso", sql(_lasso_sql(), "point"))
def lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in _LASSO])
    box = F.col("x").between(10, 60) & F.col("y").between(10, 70)
    return point(spark, sf_dir).filter(box).filter(g.inside_ring(F.col("x"), F.col("y"), ring)).select("id")


_ACTIVITY = "act AS (SELECT s_suppkey AS rid, CASE s_suppkey % 2 WHEN 0 THEN 'canvass' ELSE 'service' END AS kind, CAST(s_suppkey * 13 % 97 AS DOUBLE) AS rx, CAST(s_suppkey * 7 % 89 AS DOUBLE) AS ry FROM supplier)"


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("rid"), F.when(k % 2 == 0, "canvass").otherwise("service").alias("kind"), (k * 13 % 97).cast("double").alias("rx"), (k * 7 % 89).cast("double").alias("ry"))


@query("s040_radius_tiers", sql("SELECT id, kind, count(*) FILTER (d <= 4) AS tier_0, count(*) FILTER (d > 4 AND d <= 8) AS tier_1, count(*) FILTER (d > 8) AS tier_2 FROM (SELECT id, kind, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS d FROM point, act) WHERE d <= 12 GROUP BY id, kind", "point", more=_ACTIVITY))
def radius_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.tier_counts(point(spark, sf_dir), activities(spark, sf_dir), [4.0, 8.0, 12.0])


@query("s041_nearest_centre", sql("SELECT id, grp, round(min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) AS distance FROM point JOIN (SELECT n_nationkey AS grp, CAST(n_nationkey * k * 5 % 97 AS DOUBLE) AS cx, CAST(n_nationkey * k * 3 % 89 AS DOUBLE) AS cy FROM nation, (SELECT unnest([1, 2, 3]) AS k)) USING (grp) GROUP BY id, grp", "point"))
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grp"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("k"))
    centres = n.select("grp", (F.col("grp") * F.col("k") * 5 % 97).cast("double").alias("cx"), (F.col("grp") * F.col("k") * 3 % 89).cast("double").alias("cy"))
    return spatial.nearest_centre(point(spark, sf_dir), centres, "grp").select("id", "grp", F.round("distance", 6).alias("distance"))


@query("s041_nearest_of_many", sql("SELECT id, grp, round(min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) AS distance FROM point JOIN (SELECT p_partkey % 25 AS grp, CAST(p_partkey * 7 % 97 AS DOUBLE) + p_size / 64.0 AS cx, CAST(p_partkey * 11 % 89 AS DOUBLE) AS cy FROM part) USING (grp) GROUP BY id, grp", "point"))
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are the centres of their group, a twenty-fifth of them in each."""
    k = F.col("p_partkey")
    centres = table(spark, sf_dir, "part").select((k % 25).alias("grp"), ((k * 7 % 97).cast("double") + F.col("p_size") / 64.0).alias("cx"), (k * 11 % 89).cast("double").alias("cy"))
    return spatial.nearest_centre(point(spark, sf_dir), centres, "grp").select("id", "grp", F.round("distance", 6).alias("distance"))


_ADJ = "adj AS (SELECT a.id AS src, b.id AS dst, count(*) AS shared FROM corner a JOIN corner b ON a.x = b.x AND a.y = b.y AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2)"


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.adjacency(topology.vertices(shapes(spark, sf_dir)))


@query("s042_adjacency", sql("SELECT src, dst, shared FROM adj", "corner", more=_ADJ))
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacent(spark, sf_dir)


@query("s043_adjacency_by_edge", sql("SELECT src, dst, 1.0::DOUBLE AS length FROM adj", "corner", more=_ADJ))
def adjacency_by_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.adjacency_by_edge(topology.edges(shapes(spark, sf_dir)))


@query("s043_adjacency_by_overlap", sql("SELECT a.id AS src, b.id AS dst, CASE WHEN a.j = b.j THEN 1 ELSE least(a.x, b.x) + 2 - greatest(a.x, b.x) END::DOUBLE AS length FROM brick a JOIN brick b ON a.id < b.id AND (a.j = b.j AND abs(a.x - b.x) = 2 OR abs(a.j - b.j) = 1 AND abs(a.x - b.x) < 2)", "brick"))
def adjacency_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks share whole short sides and halves of long ones, where no corner of the one is a corner of the other's side."""
    out = topology.adjacency_by_overlap(brick(spark, sf_dir).select("id", g.parse_wkt("geometry").alias("rings")), 1.5)
    return out.select("src", "dst", F.round("length", 6).alias("length"))


@query("s044_candidate_pairs", sql("SELECT a.id AS a, b.id AS b FROM cell a JOIN cell b ON a.id < b.id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1", "cell"))
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.candidate_pairs(shapes(spark, sf_dir))


_BORDER = 200


def _overlaps_sql() -> str:
    """Rectangles: corners of each inside the other, and sides of each that cross sides of the other; the outline is such a rectangle, with
    vertices along its sides, and a hole that is a rectangle too. Layers of more than 80,000 parts go on above the outline: squares there cross its sides
    and its hole's, and hold vertices of them. By the even-odd rule a rectangle has
    its left and lower side, and not the others."""
    hit = lambda p, q, x, y: f"({q}.x0 <= {p}.{x} AND {p}.{x} < {q}.x1 AND {q}.y0 <= {p}.{y} AND {p}.{y} < {q}.y1)::INT"
    inside = lambda p, q: " + ".join(hit(p, q, x, y) for x in ("x0", "x1") for y in ("y0", "y1"))
    cross = lambda a, b: " + ".join(f"({q}.x0 < {p}.{x} AND {p}.{x} < {q}.x1 AND {p}.y0 < {q}.{y} AND {q}.{y} < {p}.y1)::INT" for p, q in ((a, b), (b, a)) for x in ("x0", "x1") for y in ("y0", "y1"))
    return sql(
        f"SELECT a, b, inside_a, inside_b, crossings, CASE WHEN greatest(inside_a, inside_b) > 2 AND crossings > 2 THEN 'both' WHEN greatest(inside_a, inside_b) > 2 THEN 'corners' ELSE 'crossings' END AS label FROM ("
        f"SELECT a.id AS a, b.id AS b, {inside('a', 'b')} AS inside_a, {inside('b', 'a')} AS inside_b, {cross('a', 'b')} AS crossings FROM box a JOIN box b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 "
        f"UNION ALL SELECT -1, id, coalesce(n, 0), {inside('box', 'o')} - ({inside('box', 'h')}), {cross('box', 'o')} + {cross('box', 'h')} FROM box LEFT JOIN held USING (id), (SELECT -3.0 AS x0, -3.0 AS y0, 30.0 AS x1, 4003.0 AS y1) o, (SELECT 4.4 AS x0, -2.6 AS y0, 9.6 AS x1, 4000.4 AS y1) h"
        ") WHERE greatest(inside_a, inside_b) > 2 OR crossings > 2",
        "cell",
        more="box AS (SELECT id, i - s AS x0, i + 1 + 5 * s AS x1, j - s AS y0, j + 1 + 5 * s AS y1 FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 0.25::DOUBLE ELSE 0 END AS s FROM cell WHERE NOT (id % 7 = 0 AND i BETWEEN 1 AND 10))), "
        # the outline's vertices, and how many of them are in each box
        f"side_ AS (SELECT ax::DOUBLE + (bx - ax)::DOUBLE * k / {_BORDER} AS x, ay::DOUBLE + (by_ - ay)::DOUBLE * k / {_BORDER} AS y FROM (VALUES (-3, -3, 30, -3), (30, -3, 30, 4003), (30, 4003, -3, 4003), (-3, 4003, -3, -3)) s(ax, ay, bx, by_), (SELECT unnest(range({_BORDER})) AS k) "
        "UNION ALL SELECT x::DOUBLE, y::DOUBLE FROM (VALUES (4.4, -2.6), (4.4, 4000.4), (9.6, 4000.4), (9.6, -2.6)) h(x, y)), "
        "held AS (SELECT id, count(*) AS n FROM box JOIN side_ v ON x0 <= v.x AND v.x < x1 AND y0 <= v.y AND v.y < y1 GROUP BY id)",
    )


@query("s045_overlaps", _overlaps_sql())
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh square is moved and made larger, so that it covers corners of others; those of ten columns are left out, since the hole of an outline
    around the layer, with hundreds of vertices, ends there."""
    k = F.col("id")
    grown = F.transform(F.col("rings"), lambda r: F.transform(r, lambda p: g.point(p["x"] * 1.0 + F.when(k % 7 == 0, (p["x"] - k % 20) * 1.5 - 0.25).otherwise(0.0), p["y"] + F.when(k % 7 == 0, (p["y"] - F.floor(k / 20)) * 1.5 - 0.25).otherwise(0.0))))
    rows = shapes(spark, sf_dir).filter(~((k % 7 == 0) & (k % 20).between(1, 10))).select("id", grown.alias("rings"))
    steps = F.sequence(F.lit(0), F.lit(_BORDER - 1))

    def rectangle(x0: float, y0: float, x1: float, y1: float):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        side = lambda a, b: F.transform(steps, lambda i: g.point(F.lit(a[0]) + (b[0] - a[0]) * i / _BORDER, F.lit(a[1]) + (b[1] - a[1]) * i / _BORDER))
        return F.concat(*[side(a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])

    hole = F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in ((4.4, -2.6), (4.4, 4000.4), (9.6, 4000.4), (9.6, -2.6))])
    outline = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit(-1).cast("long").alias("id"), F.array(rectangle(-3.0, -3.0, 30.0, 4003.0), hole).alias("rings"))
    return spatial.overlaps(rows.select(k.cast("long").alias("id"), "rings").unionByName(outline))


@query("s046_point_in_shape", sql("SELECT c_custkey AS pid, p_partkey AS id FROM customer JOIN part ON p_partkey = (c_custkey * 3 % 20) + 20 * (c_custkey * 7 % 60)"))
def point_in_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("pid"), (k * 3 % 20 + 0.5).alias("px"), (k * 7 % 60 + 0.25).alias("py"))
    return spatial.containing(points, shapes(spark, sf_dir))


@query("s047_nearest_vertex", sql("SELECT id, rid, d AS distance FROM (SELECT id, rid, round(d, 6) AS d, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS n FROM (SELECT id, rid, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS d FROM point, act) WHERE d <= 5) WHERE n = 1", "point", more=_ACTIVITY))
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.nearest_within(point(spark, sf_dir), activities(spark, sf_dir), 5.0)
    return out.select("id", "rid", F.round("distance", 6).alias("distance"))


_CLOSE = "near AS (SELECT a.id AS src, b.id AS dst FROM point a JOIN point b ON a.grp = b.grp AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36)"
_WALK = "both_ AS (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e}), walk AS (SELECT {n} AS id, {n} AS reach FROM {t} UNION SELECT walk.id, both_.dst FROM walk JOIN both_ ON walk.reach = both_.src)"


@query("s150_density_clusters", "WITH RECURSIVE " + sql("SELECT p.id, CASE WHEN p.id IN (SELECT src FROM both_) THEN m END AS cluster FROM point p JOIN (SELECT id, min(reach) AS m FROM walk GROUP BY id) w ON p.id = w.id", "point", more=f"{_CLOSE}, {_WALK.format(e='near', n='id', t='point')}")[5:])
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dense_clusters(point(spark, sf_dir), 6.0, "grp")


@query("s148_two_hops", sql("SELECT start, id, min(h) AS hops FROM (SELECT s AS start, s AS id, 0 AS h FROM st UNION ALL SELECT s, b.dst, 1 FROM st JOIN both_ b ON b.src = s UNION ALL SELECT s, c.dst, 2 FROM st JOIN both_ b ON b.src = s JOIN both_ c ON c.src = b.dst) GROUP BY start, id", "corner", more=f"{_ADJ}, both_ AS (SELECT src, dst FROM adj UNION ALL SELECT dst, src FROM adj), st AS (SELECT id AS s FROM cell)"))
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.within_hops(adjacent(spark, sf_dir), cell(spark, sf_dir).select("id"), 2)


@query("s149_components_in_groups", "WITH RECURSIVE " + sql("SELECT grp, count(DISTINCT m) AS n_parts FROM (SELECT id, min(reach) AS m FROM walk GROUP BY id) JOIN cell USING (id) GROUP BY grp", "corner", more=f"{_ADJ}, same_ AS (SELECT src, dst FROM adj JOIN cell a ON a.id = src JOIN cell b ON b.id = dst WHERE a.grp = b.grp), {_WALK.format(e='same_', n='id', t='cell')}")[5:])
def components_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components_in_groups(cell(spark, sf_dir).select("id", "grp"), adjacent(spark, sf_dir))


@query("s151_degrees", sql("SELECT (SELECT count(*) FROM adj) AS edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, count(*) FILTER (d = 0) AS isolated FROM (SELECT (SELECT count(*) FROM adj WHERE src = id OR dst = id) AS d FROM cell)", "corner", more=_ADJ))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.degrees(cell(spark, sf_dir), adjacent(spark, sf_dir))
    return out.select("edges", F.round("avg_degree", 6).alias("avg_degree"), "max_degree", "isolated")


@query("s152_edge_smoothness", sql("SELECT round(avg((ln(1 + src % 13) - ln(1 + dst % 13)) * (ln(1 + src % 13) - ln(1 + dst % 13))), 6) AS smoothness FROM adj", "corner", more=_ADJ))
def edge_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = cell(spark, sf_dir).select("id", (F.col("id") % 13 + 1).cast("double").alias("value"))
    return graph.smoothness(adjacent(spark, sf_dir), values).select(F.round("smoothness", 6).alias("smoothness"))


_TYPES = ["C1", "C2", "C3", "C4"]
_PRIOR = f"prior AS (SELECT k AS key, t AS type, CAST((k * o) % 5 AS DOUBLE) AS p FROM (SELECT p_partkey AS k FROM part), (SELECT unnest({_TYPES}) AS t, unnest([1, 2, 3, 4]) AS o)), ok AS (SELECT k AS key, t AS type FROM (SELECT p_partkey AS k FROM part), (SELECT unnest({_TYPES}) AS t, unnest([1, 2, 3, 4]) AS o) WHERE (k + o) % 3 <> 0)"


def priors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(priors, valid types) of four types for each part."""
    keys = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").cast("long").alias("key"))
    full = keys.select("key", F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(i).alias("o")) for i, t in enumerate(_TYPES, 1)])))
    return full.select("key", "type", ((F.col("key") * F.col("o")) % 5).cast("double").alias("p")), full.filter((F.col("key") + F.col("o")) % 3 != 0).select("key", "type")


@query("s154_valid_priors", sql("SELECT ok.key, ok.type, round(CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 1 / count(*) OVER w END, 6) AS p FROM ok JOIN prior ON ok.key = prior.key AND ok.type = prior.type WINDOW w AS (PARTITION BY ok.key)", more=_PRIOR))
def valid_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.valid_priors(*priors(spark, sf_dir), ["key"]).select("key", "type", F.round("p", 6).alias("p"))


@query("s155_fallback_type", sql("SELECT id, key, arg_min(t, [CASE WHEN d >= 0 THEN 0 ELSE 1 END, abs(d)]) AS type FROM (SELECT c.id, c.key, ok.type AS t, CAST(ok.type[2:2] AS INT) - c.o AS d FROM (SELECT p_partkey AS id, p_partkey AS key, p_partkey % 4 + 1 AS o FROM part) c JOIN ok ON c.key = ok.key) GROUP BY id, key", more=_PRIOR))
def fallback_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("key"), F.concat(F.lit("C"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("type"))
    return graph.fallback_type(rows, priors(spark, sf_dir)[1], "key", _TYPES)


_MOVES = f"moves AS (SELECT from_type, type, w / sum(w) OVER (PARTITION BY from_type) AS p FROM (SELECT f AS from_type, t AS type, CAST((i * 3 + o * 2) % 7 + 1 AS DOUBLE) AS w FROM (SELECT unnest({_TYPES}) AS f, unnest([1, 2, 3, 4]) AS i), (SELECT unnest({_TYPES}) AS t, unnest([1, 2, 3, 4]) AS o)))"
#: One sweep: colours by the longest falling path of drawn numbers, then a step for each colour that sees the steps before.
_SWEEP = f"""{_ADJ}, {_PRIOR}, {_MOVES},
 good AS (SELECT ok.key, ok.type, CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 1 / count(*) OVER w END AS p FROM ok JOIN prior ON ok.key = prior.key AND ok.type = prior.type WINDOW w AS (PARTITION BY ok.key)),
 both_ AS (SELECT src, dst FROM adj UNION ALL SELECT dst, src FROM adj),
 drawn_ AS (SELECT id, {num.keyed_uniform_sql('labels', 'id')} AS u, {num.keyed_uniform_sql('labels-0', 'id')} AS draw FROM cell),
 fall AS (SELECT b.src, b.dst FROM both_ b JOIN drawn_ s ON s.id = b.src JOIN drawn_ d ON d.id = b.dst WHERE s.u < d.u OR s.u = d.u AND s.id < d.id),
 walk AS (SELECT id, 0 AS depth FROM cell UNION SELECT fall.dst, depth + 1 FROM walk JOIN fall ON fall.src = walk.id),
 colour AS (SELECT id, max(depth) AS c FROM walk GROUP BY id),
 state AS (
  SELECT 0 AS step, id, 'C' || (id % 4 + 1) AS type FROM cell
  UNION ALL
  SELECT s.step + 1, s.id, coalesce(n.type, s.type) FROM state s LEFT JOIN (
    SELECT id, min(type) AS type FROM (
      SELECT id, type, draw, sum(w) OVER (PARTITION BY id ORDER BY type) AS upto, sum(w) OVER (PARTITION BY id) AS whole FROM (
        SELECT c.id, g.type, d.draw, CASE WHEN k.degree IS NULL THEN g.p ELSE 0.5 * g.p + 0.5 * coalesce(q.q, 0) / k.degree END AS w
        FROM colour c JOIN good g ON g.key = c.id JOIN drawn_ d ON d.id = c.id
        LEFT JOIN (SELECT b.src AS id, count(*) AS degree FROM both_ b GROUP BY b.src) k ON k.id = c.id
        LEFT JOIN (SELECT b.src AS id, m.type, sum(m.p) AS q FROM both_ b JOIN state t ON t.id = b.dst JOIN moves m ON m.from_type = t.type GROUP BY b.src, m.type) q ON q.id = c.id AND q.type = g.type
        WHERE c.c = (SELECT max(step) FROM state) AND c.id % 10 <> 0))
    WHERE whole > 0 AND draw * whole < upto GROUP BY id) n ON n.id = s.id
  WHERE s.step <= (SELECT max(c) FROM colour))"""


@query("s153_blended_labels", "WITH RECURSIVE " + sql("SELECT id, id AS key, type, id % 10 = 0 AS frozen FROM state WHERE step = (SELECT max(c) + 1 FROM colour)", "corner", more=_SWEEP)[5:])
def blended_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of squares after a sweep, by what each neighbour's type leads to; every tenth is an anchor and keeps its own."""
    p, valid = priors(spark, sf_dir)
    good = materialize(graph.valid_priors(p, valid, ["key"]))
    nodes = cell(spark, sf_dir).select("id", F.col("id").alias("key"), F.concat(F.lit("C"), (F.col("id") % 4 + 1).cast("string")).alias("type"), (F.col("id") % 10 == 0).alias("frozen"))
    weights = [(f, t, float((i * 3 + o * 2) % 7 + 1)) for i, f in enumerate(_TYPES, 1) for o, t in enumerate(_TYPES, 1)]
    sums = {f: sum(w for g_, _, w in weights if g_ == f) for f in _TYPES}
    # the transition table of four types, four by four
    moves = table(spark, sf_dir, "region").limit(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("from_type"), F.lit(t).alias("type"), F.lit(w / sums[f]).alias("p")) for f, t, w in weights])))
    return graph.blend_labels(nodes, materialize(adjacent(spark, sf_dir)), good, moves, sweeps=1)


@query("s156_candidate_losses", sql("SELECT c AS candidate, round(avg(((s - t) / t) * ((s - t) / t)), 6) AS loss FROM (SELECT c, grp, sum(c * sqrt(area) * area) AS s, count(*) * 1000.0 AS t FROM (SELECT p_brand AS grp, CAST(p_size AS DOUBLE) AS area FROM part), (SELECT unnest([1.0, 2.0, 3.0, 5.0]::DOUBLE[]) AS c) GROUP BY c, grp) GROUP BY c"))
def candidate_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    areas = p.select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("area"))
    targets = areas.groupBy("grp").agg((F.count(F.lit(1)) * 1000.0).alias("target"))
    return graph.candidate_losses(areas, targets, [1.0, 2.0, 3.0, 5.0], lambda a: F.col("candidate") * F.sqrt(a)).select("candidate", F.round("loss", 6).alias("loss"))


@query("s157_vertices", sql("SELECT id, 0 AS ring, CAST(k AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM corner", "corner"))
def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.vertices(shapes(spark, sf_dir)).select("id", "ring", "pos", "x", "y")


@query("s158_shared_vertices", sql("SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, count(DISTINCT id) AS n_shapes FROM corner GROUP BY x, y HAVING count(DISTINCT id) > 1", "corner"))
def shared_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topology.vertices(shapes(spark, sf_dir))
    return topology.vertex_sharing(v).join(v.groupBy("key").agg(F.min("x").alias("x"), F.min("y").alias("y")), "key").select("x", "y", "n_shapes")


@query("s159_vertex_consistency", sql("SELECT count(*) AS n_shared, count(*) FILTER (m) AS n_apart FROM (SELECT bool_or(id % 10 = 0) AND bool_or(id % 10 <> 0) AS m FROM corner GROUP BY x, y HAVING count(DISTINCT id) > 1)", "corner"))
def vertex_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth square is a little off: its corners have the same keys as its neighbours', not the same places."""
    off = F.when(F.col("id") % 10 == 0, 0.0001).otherwise(0.0)
    moved = shapes(spark, sf_dir).select("id", F.transform("rings", lambda r: F.transform(r, lambda p: g.point(p["x"] + off, p["y"]))).alias("rings"))
    return topology.vertex_sharing(topology.vertices(moved)).agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("spread") > 1e-6).alias("n_apart"))


@query("s160_vertex_classes", sql("SELECT class, count(*) AS n FROM (SELECT CASE WHEN x = 0 THEN 'fixed' WHEN count(DISTINCT grp) > 1 THEN 'cross' WHEN count(DISTINCT id) > 1 THEN 'same' ELSE 'ordinary' END AS class FROM corner GROUP BY x, y) GROUP BY class", "corner"))
def vertex_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes(spark, sf_dir)
    v = topology.vertices(rows)
    return topology.vertex_classes(v, rows.select("id", "grp"), v.filter("x = 0")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("s161_outer_boundary", sql("SELECT grp, count(*) AS n_edges FROM (SELECT grp, k1, k2 FROM edge GROUP BY grp, k1, k2 HAVING count(*) = 1) GROUP BY grp", "edge"))
def outer_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes(spark, sf_dir)
    edge = topology.edges(rows).join(by_shuffle(rows.select("id", "grp")), "id")
    return topology.outer_edges(edge, ["grp"]).groupBy("grp").agg(F.count(F.lit(1)).alias("n_edges"))


@query("s162_gap_edges", sql("SELECT min(id) AS id, count(*) AS n FROM edge GROUP BY k1, k2 HAVING count(*) = 1", "edge"))
def gap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.outer_edges(topology.edges(shapes(spark, sf_dir)), []).select("id", F.lit(1).cast("long").alias("n"))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer without its inner squares at every fifth column and row, so with closed gaps."""
    return shapes(spark, sf_dir).filter(~((F.col("id") % 20 % 5 == 2) & (F.floor(F.col("id") / 20) % 5 == 2)))


_GONE = "gone AS (SELECT id FROM cell WHERE i % 5 = 2 AND j % 5 = 2)"


@query(
    "s163_loops",
    sql(
        "SELECT (SELECT count(*) FROM (SELECT k1 FROM edge WHERE id NOT IN (SELECT id FROM gone) GROUP BY k1, k2 HAVING count(*) = 1)) - 4 * (SELECT count(*) FROM gone) AS n_edges, true AS closed, CAST((SELECT count(*) FROM cell) AS DOUBLE) AS area, 0 AS n_breaks",
        "edge",
        more=_GONE,
    ),
)
def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The border of the layer as a loop in order; the loops around its gaps lie inside and are dropped."""
    ordered = topology.loops(topology.border(topology.directed_edges(holed(spark, sf_dir))))
    outer = ordered.filter("area > 0")
    # in order: the end of each edge is where the next one starts
    step = outer.select("loop", (F.col("place") - 1).alias("place"), F.col("a").alias("next_a"))
    breaks = outer.join(by_shuffle(step), ["loop", "place"], "left").groupBy("loop").agg(F.max("n_edges").alias("n_edges"), F.bool_and("closed").alias("closed"), F.max("area").alias("area"), F.count_if((F.col("place") < F.col("n_edges") - 1) & (F.col("b") != F.coalesce("next_a", F.lit("")))).cast("int").alias("n_breaks"))
    return breaks.select("n_edges", "closed", F.round("area", 6).alias("area"), "n_breaks")


@query(
    "s164_gap_owner",
    sql(
        "SELECT gap, id, shared FROM (SELECT m.id AS gap, c.id, count(*) AS shared, row_number() OVER (PARTITION BY m.id ORDER BY count(*) DESC, c.id) AS n FROM corner m JOIN corner c ON m.x = c.x AND m.y = c.y WHERE m.id IN (SELECT id FROM gone) AND c.id NOT IN (SELECT id FROM gone) GROUP BY m.id, c.id) WHERE n = 1",
        "corner",
        more=_GONE,
    ),
)
def gap_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which neighbour has most corners of each missing square."""
    gone = shapes(spark, sf_dir).join(holed(spark, sf_dir).select("id"), "id", "left_anti")
    gaps = topology.vertices(gone).select(F.col("id").alias("gap"), "key")
    return topology.gap_owner(gaps, topology.vertices(holed(spark, sf_dir)))


@query("s165_redundant_vertices", sql("SELECT '0.0,' || CAST(CAST(j AS DOUBLE) + 0.5 AS VARCHAR) AS key FROM cell WHERE i = 0", "cell"))
def redundant_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole layer, where squares of the first column have a midpoint on the left side, which no neighbour has."""
    with_middle = F.transform("rings", lambda r: F.concat(r, F.array(g.point(r[0]["x"], r[0]["y"] + 0.5), r[0])))
    widened = F.transform(with_middle, lambda r: F.concat(F.slice(r, 1, 4), F.slice(r, 6, 1)))
    return topology.redundant_vertices(shapes(spark, sf_dir).select("id", F.when(F.col("id") % 20 == 0, widened).otherwise(F.col("rings")).alias("rings")))


@query("s166_insertions", sql("SELECT id, 0 AS pos, i || '.0,' || (j + 1) || '.0' AS key, 0.5::DOUBLE AS t FROM cell c WHERE EXISTS (SELECT 1 FROM corner o WHERE o.id <> c.id AND o.x = c.i AND o.y = c.j + 1)", "corner"))
def insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of unit squares that lie inside the long sides of 1 x 2 blocks, one block from each square up."""
    rows = shapes(spark, sf_dir)
    v = topology.vertices(rows)
    b = F.col("rings")[0]
    long_side = rows.select("id", F.lit(0).alias("pos"), b[0]["x"].alias("x1"), b[0]["y"].alias("y1"), b[0]["x"].alias("x2"), (b[0]["y"] + 2).alias("y2"))
    return topology.insertions(v, long_side, 4.0)


_NEAR = 0.05


@query("s167_snap", f"WITH v AS (SELECT p_partkey AS id, p_partkey % 20 + (p_partkey % 3 - 1) * 0.01::DOUBLE + CASE WHEN p_partkey % 7 = 0 THEN 0.3 ELSE 0 END AS x, p_partkey // 20 % 10 + (p_partkey % 5 - 2) * 0.008::DOUBLE AS y FROM part) SELECT CAST(a.id AS BIGINT) AS id, round(avg(b.x), 6) AS sx, round(avg(b.y), 6) AS sy FROM v a JOIN v b ON abs(a.x - b.x) < {_NEAR} AND abs(a.y - b.y) < {_NEAR} GROUP BY a.id")
def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices lie around whole numbers, on both sides of the borders of any cells that begin there; some are apart from them."""
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select(k.cast("long").alias("id"), (k % 20 + (k % 3 - 1) * 0.01 + F.when(k % 7 == 0, 0.3).otherwise(0.0)).alias("x"), (F.floor(k / 20) % 10 + (k % 5 - 2) * 0.008).alias("y"))
    return topology.snap(v, _NEAR).select("id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("s168_dissolve", sql("SELECT grp, CAST(count(*) AS DOUBLE) AS area, CAST(sum(id) AS BIGINT) AS population, min(id) AS first_id, round(avg(i + 0.5), 6) AS cx, round(avg(j + 0.5), 6) AS cy FROM cell GROUP BY grp", "cell"))
def dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes(spark, sf_dir).select("id", "grp", g.area("rings").alias("area"), F.col("id").alias("population"), F.col("id").alias("first_id"), g.centroid(F.col("rings")[0]).alias("c")).select("*", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    return topology.dissolve(rows, ["grp"], ["area", "population"], ["first_id"], "id").select("grp", "area", "population", "first_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("s169_layer_statistics", sql("SELECT (SELECT count(*) FROM cell) + (SELECT count(*) FROM plot) AS shapes, (SELECT count(*) FROM corner) + (SELECT CAST(sum(CASE f WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 3 END) AS BIGINT) FROM plot) AS vertices, (SELECT count(*) FROM plot WHERE f = 0) AS holes, (SELECT count(*) FROM (SELECT x FROM corner GROUP BY x, y HAVING count(DISTINCT id) > 1)) AS shared_vertices", "corner", "plot"))
def layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares that touch, and apart from them plots of which some have holes."""
    away = plots(spark, sf_dir).select((-F.col("id") - 1).alias("id"), F.transform("rings", lambda r: F.transform(r, lambda p: g.point(p["x"] + 1000.5, p["y"]))).alias("rings"))
    return topology.layer_statistics(topology.vertices(shapes(spark, sf_dir).select("id", "rings").unionByName(away)))

"""Layers of shapes through two tables: their vertices and their edges. All else is counting by vertex or edge key."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from hustings.functions import geometry as g
from hustings.operators import grids
from hustings.operators.graph import connected_components
from hustings.shared import by_shuffle, materialize, spread


def vertices(shapes: DataFrame, digits: int = 3) -> DataFrame:
    """Rows (id, ring, pos, x, y, key) of shapes (id, rings); the closing vertex is dropped, keys are rounded coordinates."""
    rings = shapes.select("id", F.posexplode(g.open_rings("rings")).alias("ring", "r")).select("id", "ring", F.posexplode("r").alias("pos", "p"))
    key = F.concat_ws(",", F.round("p.x", digits).cast("string"), F.round("p.y", digits).cast("string"))
    return rings.select("id", "ring", "pos", "p.x", "p.y", key.alias("key"))


def edges(shapes: DataFrame, digits: int = 3) -> DataFrame:
    """Rows (id, ring, pos, k1, k2, length), k1 < k2: each vertex with the next of its ring, by array, without a window."""
    key = lambda p: F.concat_ws(",", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    opened = shapes.select("id", F.posexplode(g.open_rings("rings")).alias("ring", "r"))
    n = F.size("r")
    pairs = F.transform("r", lambda p, i: F.struct(p.alias("p"), F.get(F.col("r"), F.when(i + 1 < n, i + 1).otherwise(F.lit(0))).alias("q")))
    each = opened.select("id", "ring", F.posexplode(pairs).alias("pos", "e"))
    p, q = F.col("e.p"), F.col("e.q")
    out = each.select("id", "ring", "pos", F.least(key(p), key(q)).alias("k1"), F.greatest(key(p), key(q)).alias("k2"), g.distance(p["x"], p["y"], q["x"], q["y"]).alias("length"))
    return out.filter("k1 <> k2")


def adjacency(vertex: DataFrame, least: int = 2) -> DataFrame:
    """Rows (src, dst, shared), src < dst: shapes with so many vertices in common.

    A vertex joins the few shapes that meet there; shapes are named once a vertex.
    """
    once = vertex.select("id", "key").distinct()
    a, b = once.select(F.col("id").alias("src"), "key"), once.select(F.col("id").alias("dst"), "key")
    return a.join(by_shuffle(b), "key").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def adjacency_by_edge(edge: DataFrame) -> DataFrame:
    """Rows (src, dst, length), src < dst: shapes with whole edges in common, and how long these are together."""
    a, b = edge.select(F.col("id").alias("src"), "k1", "k2", "length"), edge.select(F.col("id").alias("dst"), "k1", "k2")
    return a.join(by_shuffle(b), ["k1", "k2"]).filter("src < dst").groupBy("src", "dst").agg(F.sum("length").alias("length"))


def adjacency_by_overlap(shapes: DataFrame, size: float = 1.0, digits: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """Rows (src, dst, length): also edges that lie on one line and overlap in part.

    Edges meet where they lie on the same line (direction and offset, rounded) and, along it, in the same stretch of one of the levels there are, each
    twice as long as the next, from ``size`` on; a pair of edges is measured in the first stretch that both have.
    """
    opened = shapes.select("id", F.explode(g.open_rings("rings")).alias("r"))
    n = F.size("r")
    pairs = F.transform("r", lambda p, i: F.struct(p.alias("p"), F.get(F.col("r"), F.when(i + 1 < n, i + 1).otherwise(F.lit(0))).alias("q")))
    each = opened.select("id", F.explode(pairs).alias("e"))
    dx, dy = F.col("e.q.x") - F.col("e.p.x"), F.col("e.q.y") - F.col("e.p.y")
    length = F.sqrt(dx * dx + dy * dy)
    each = each.withColumn("l", length).filter("l > 0")
    turn = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1).otherwise(1)
    ux, uy = turn * dx / F.col("l"), turn * dy / F.col("l")
    lined = each.select("id", F.round(ux, digits).alias("ux"), F.round(uy, digits).alias("uy"), F.round(ux * F.col("e.p.y") - uy * F.col("e.p.x"), digits).alias("off"), (ux * F.col("e.p.x") + uy * F.col("e.p.y")).alias("s"), (ux * F.col("e.q.x") + uy * F.col("e.q.y")).alias("t"))
    lined = lined.select("id", "ux", "uy", "off", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
    # an edge lies in the stretches of the level of its own length, two at most, and looks for longer edges in those of larger levels
    sized = materialize(lined.withColumn("own", grids.level_of(F.col("t") - F.col("s"), size)))
    stretch = lambda c: grids.cell_of(F.col(c), F.col("level"))
    in_cells = lambda df: df.withColumn("cell", F.explode(F.sequence(stretch("s"), stretch("t"))))
    line = ["ux", "uy", "off", "level", "cell"]
    a = in_cells(sized.withColumn("level", F.col("own"))).select(F.col("id").alias("a"), *line, F.col("s").alias("s1"), F.col("t").alias("t1"))
    b = in_cells(grids.at_levels(sized, grids.levels_in(sized, "own"), F.col("own"))).select(F.col("id").alias("b"), "own", *line, F.col("s").alias("s2"), F.col("t").alias("t2"))
    once = (F.col("own") < F.col("level")) | (F.col("a") < F.col("b"))
    both = a.join(by_shuffle(b), line).filter((F.col("a") != F.col("b")) & once & (F.col("cell") == F.greatest(stretch("s1"), stretch("s2"))))
    common = F.least("t1", "t2") - F.greatest("s1", "s2")
    return both.withColumn("c", common).filter(F.col("c") > tolerance).groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("c").alias("length"))


def vertex_sharing(vertex: DataFrame) -> DataFrame:
    """Rows (key, n_shapes, spread): vertices of several shapes and how far their coordinates are apart there."""
    shared = vertex.groupBy("key").agg(F.count_distinct("id").alias("n_shapes"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("spread"))
    return shared.filter("n_shapes > 1")


def vertex_classes(vertex: DataFrame, groups: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Rows (key, class): fixed on the outline, else cross (several groups meet), same (several shapes of one group), or ordinary."""
    counts = vertex.join(by_shuffle(groups), "id").groupBy("key").agg(F.count_distinct("id").alias("n"), F.count_distinct("grp").alias("g"))
    if outline is not None:
        counts = counts.join(by_shuffle(outline.select("key").distinct().withColumn("_fixed", F.lit(True))), "key", "left")
    else:
        counts = counts.withColumn("_fixed", F.lit(None).cast("boolean"))
    return counts.select("key", F.when(F.col("_fixed"), "fixed").when(F.col("g") > 1, "cross").when(F.col("n") > 1, "same").otherwise("ordinary").alias("class"))


def outer_edges(edge: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that only one shape of a group has: the group's border, or, without keys, the borders of gaps and of the layer."""
    return edge.groupBy(*keys, "k1", "k2").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"), F.min("length").alias("length")).filter("_n = 1").drop("_n")


def directed_edges(shapes: DataFrame, digits: int = 3) -> DataFrame:
    """Rows (id, ring, pos, a, b, x, y, turn) of shapes (id, rings): each edge in the direction of its ring, from key ``a`` at (x, y) to key ``b``;
    the sum of ``turn`` over a ring is its signed area."""
    key = lambda p: F.concat_ws(",", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    opened = shapes.select("id", F.posexplode(g.open_rings("rings")).alias("ring", "r"))
    n = F.size("r")
    pairs = F.transform("r", lambda p, i: F.struct(p.alias("p"), F.get(F.col("r"), F.when(i + 1 < n, i + 1).otherwise(F.lit(0))).alias("q")))
    each = opened.select("id", "ring", F.posexplode(pairs).alias("pos", "e"))
    p, q = F.col("e.p"), F.col("e.q")
    out = each.select("id", "ring", "pos", key(p).alias("a"), key(q).alias("b"), p["x"].alias("x"), p["y"].alias("y"), ((p["x"] * q["y"] - q["x"] * p["y"]) / 2).alias("turn"))
    return out.filter("a <> b")


def border(edge: DataFrame) -> DataFrame:
    """The directed edges that only one shape has."""
    once = edge.groupBy(F.least("a", "b").alias("_k1"), F.greatest("a", "b").alias("_k2")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*edge.columns)).alias("_e"))
    return once.filter("_n = 1").select(*[F.col(f"_e.{c}").alias(c) for c in edge.columns])


def loops(edge: DataFrame) -> DataFrame:
    """``edge`` (directed border edges) with loop, place, n_edges, closed and area: the edges of each loop, in order from its least one.

    An edge goes on with the edge that starts where it ends; where several do, with one of its own shape, then the least. Rings of shapes must turn
    one way (outer rings counter-clockwise, holes clockwise): then a loop around the layer has a positive area, and a loop around a gap, which
    lies inside of another, a negative one. Edges left over by a chain that does not close have closed = false.

    Places come by doubling: in each round an edge knows its distance to one twice as far behind, so a loop of n edges takes log2(n) rounds, each
    a join that is written to the shared folder. No loop is gathered in one task.
    """
    edge = materialize(edge.withColumn("e", F.xxhash64("a", "b", "id", "ring", "pos")))
    here, after = edge.select("e", "b", "id"), edge.select(F.col("a").alias("b"), F.col("e").alias("f"), F.col("id").alias("_fid"))
    next_ = here.join(by_shuffle(after), "b").groupBy("e").agg(F.min(F.struct(F.col("id") != F.col("_fid"), "f"))["f"].alias("f"))
    next_ = materialize(next_.groupBy("f").agg(F.min("e").alias("e")))  # one comes before each
    found = connected_components(next_, "e", "f")
    labelled = materialize(edge.select("e").join(by_shuffle(found.withColumnRenamed("id", "e")), "e", "left").select("e", F.coalesce("component", "e").alias("loop")))
    # pointers back, but for the loop's least edge, where its order begins
    back = labelled.join(by_shuffle(next_.select(F.col("f").alias("e"), F.col("e").alias("to"))), "e", "left")
    start = F.col("e") == F.col("loop")
    ends = F.coalesce("to", "e")
    now = materialize(back.select("e", "loop", F.when(start, F.col("e")).otherwise(ends).alias("to"), F.when(start | F.col("to").isNull(), 0).otherwise(1).cast("long").alias("place")))
    moved = True
    while moved:
        up = now.select(F.col("e").alias("to"), F.col("to").alias("_to"), F.col("place").alias("_place"))
        joined = materialize(now.join(by_shuffle(up), "to").select("e", "loop", F.col("_to").alias("to"), (F.col("place") + F.col("_place")).alias("place"), (F.col("to") != F.col("_to")).alias("_moved")))
        moved = not joined.filter("_moved").isEmpty()
        now = joined.drop("_moved")
    rows = edge.join(by_shuffle(now.select("e", "loop", "place", F.col("to").alias("_head"))), "e")
    followed = next_.select("e").distinct().withColumn("_followed", F.lit(True))
    rows = rows.join(by_shuffle(followed), "e", "left")
    closed = F.bool_and(F.coalesce("_followed", F.lit(False)) & (F.col("_head") == F.col("loop")))
    sums = rows.groupBy("loop").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("turn").alias("area"), closed.alias("closed"))
    return rows.join(by_shuffle(sums), "loop").select("loop", "place", *[c for c in edge.columns if c != "e"], "n_edges", "closed", "area")


def gap_owner(gap_vertices: DataFrame, vertex: DataFrame) -> DataFrame:
    """For each gap (gap, key) the shape with most of its vertices; ties by the least id."""
    shared = gap_vertices.join(vertex.select("id", "key").distinct(), "key").groupBy("gap", "id").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("gap").agg(F.max(F.struct("shared", (-F.col("id")).alias("o"))).alias("b"))
    return best.select("gap", (-F.col("b.o")).alias("id"), "b.shared")


def redundant_vertices(shapes: DataFrame, digits: int = 3) -> DataFrame:
    """Rows (key): vertices with just two neighbours over all rings, in line with them, in rings of four vertices or more."""
    opened = shapes.select("id", F.posexplode(g.open_rings("rings")).alias("ring", "r")).filter(F.size("r") >= 4)
    n = F.size("r")
    each = opened.select(F.explode(F.transform("r", lambda p, i: F.struct(p.alias("p"), F.get(F.col("r"), F.when(i > 0, i - 1).otherwise(n - 1)).alias("a"), F.get(F.col("r"), F.when(i + 1 < n, i + 1).otherwise(F.lit(0))).alias("b")))).alias("e"))
    key = lambda p: F.concat_ws(",", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    p, a, b = F.col("e.p"), F.col("e.a"), F.col("e.b")
    line = (p["x"] - a["x"]) * (b["y"] - p["y"]) == (p["y"] - a["y"]) * (b["x"] - p["x"])
    # a vertex that is a corner of one ring is none of these, whatever its neighbours there
    near = F.explode(F.when(~line, F.array(F.lit(None).cast("string"))).otherwise(F.array(key(a), key(b))))
    counted = each.select(key(p).alias("key"), near.alias("near"), line.alias("line")).groupBy("key").agg(F.count_distinct("near").alias("n"), F.bool_and("line").alias("line"))
    return counted.filter("n = 2 and line").select("key")


#: Cells along an edge, at most twice as many.
ALONG = 32


def insertions(vertex: DataFrame, edge_points: DataFrame, size: float, tolerance: float = 1e-9) -> DataFrame:
    """Rows (id, pos, key, t): vertices of other shapes that lie on a shape's edge, up to ``tolerance`` beside it, in order along it; its ends are left out.

    ``edge_points`` has (id, pos, x1, y1, x2, y2). An edge goes to the cells that it crosses, not to those of its box; cells are ``size`` wide, or as
    much wider for a long edge that there are some ALONG of them. A vertex looks in its cell of each size that there is.
    """
    x1, y1, x2, y2, x, y = (F.col(c) for c in ("x1", "y1", "x2", "y2", "x", "y"))
    dx, dy = x2 - x1, y2 - y1
    sized = edge_points.filter((dx != 0) | (dy != 0)).withColumn("level", grids.level_of(F.greatest(F.abs(dx), F.abs(dy)) / ALONG, max(size, 4 * tolerance)))
    e = sized.select("id", "pos", "x1", "y1", "x2", "y2", "level", F.inline(grids.line_cells(x1, y1, x2, y2, F.col("level"))))
    points = grids.at_levels(vertex.select(F.col("id").alias("other"), "key", "x", "y"), grids.levels_in(sized))
    # a vertex beside an edge may lie in the next cell
    near = lambda v: F.array_distinct(F.array(grids.cell_of(v - tolerance, F.col("level")), grids.cell_of(v + tolerance, F.col("level"))))
    v = points.withColumn("cx", F.explode(near(x))).withColumn("cy", F.explode(near(y)))
    length = F.sqrt(dx * dx + dy * dy)
    t = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)
    on = F.abs((x - x1) * dy - (y - y1) * dx) <= tolerance * length
    inside = (t * length > tolerance) & ((1 - t) * length > tolerance)
    return e.join(by_shuffle(v), ["level", "cx", "cy"]).filter(F.col("id") != F.col("other")).withColumn("t", t).filter(on & inside).select("id", "pos", "key", F.round("t", 9).alias("t")).distinct()


def snap(vertex: DataFrame, tolerance: float) -> DataFrame:
    """Vertices (x, y) moved to the mean of their group: columns sx, sy. A group has a leader, and all others in it are nearer than ``tolerance`` to that
    one in x and in y; vertices that are all near each other, and to no other, are one group, wherever cell borders lie.

    Leaders are found in rounds: of the open places in a grid cell as wide as the tolerance, all near each other, the one with the least hash is a
    candidate, and a candidate before all candidates near it leads. Open places near a leader follow the nearest one, and the rest go on. A place
    meets one candidate or leader in each of nine cells, so a crowd costs no pairs.
    """
    places = vertex.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("order", F.struct(F.xxhash64("x", "y").alias("h"), F.col("x").alias("x"), F.col("y").alias("y")))
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    open_ = materialize(places.filter("x is not null and y is not null").withColumns({"_cx": cell("x"), "_cy": cell("y")}))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)]).cast("array<bigint>")
    shifted = lambda c: F.explode(F.transform(steps, lambda d: F.col(c) + d)).alias(c)
    spread = lambda df: df.select(F.col("order").alias("o"), shifted("_cx"), "_cy").select("o", "_cx", shifted("_cy"))
    near = (F.abs(F.col("x") - F.col("o.x")) < tolerance) & (F.abs(F.col("y") - F.col("o.y")) < tolerance)
    led = None
    while not open_.isEmpty():
        best = open_.groupBy("_cx", "_cy").agg(F.min("order").alias("order")).withColumns({"x": F.col("order.x"), "y": F.col("order.y")})
        best = materialize(best)
        behind = best.join(spread(best), ["_cx", "_cy"]).filter(near & (F.col("o") < F.col("order"))).select("order").distinct()
        leaders = materialize(best.join(behind, "order", "left_anti"))
        far = (F.col("x") - F.col("o.x")) ** 2 + (F.col("y") - F.col("o.y")) ** 2
        found = open_.join(spread(leaders), ["_cx", "_cy"]).filter(near).groupBy("x", "y", "n").agg(F.min(F.struct(far.alias("d"), F.col("o")))["o"].alias("leader"))
        found = materialize(found)
        led = found if led is None else led.unionByName(found)
        open_ = materialize(open_.join(found.select("x", "y"), ["x", "y"], "left_anti"))
    if led is None:
        return vertex.withColumns({"sx": F.col("x").cast("double"), "sy": F.col("y").cast("double")})
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"s{c}")
    moved = led.join(led.groupBy("leader").agg(mean("x"), mean("y")), "leader").select("x", "y", "sx", "sy")
    return vertex.join(moved, ["x", "y"], "left").select(*vertex.columns, "sx", "sy")


def dissolve(shapes: DataFrame, keys: list[str], sums: list[str], firsts: list[str], order: str) -> DataFrame:
    """Attributes of groups: sums, values of the first member, and the centre weighted by area. Borders are outer_edges by the same keys."""
    area = F.col("area")
    return shapes.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums], *[F.min_by(c, order).alias(c) for c in firsts], (F.sum(F.col("cx") * area) / F.sum(area)).alias("cx"), (F.sum(F.col("cy") * area) / F.sum(area)).alias("cy"))


#: Vertices that a task counts.
DEALT = 500_000


def layer_statistics(vertex: DataFrame) -> DataFrame:
    """One row: shapes, vertices, holes and shared vertices of a layer.

    Vertices are made once and dealt by their number, by shape and by place, so that a task counts as many in any layer.
    """
    vertex = materialize(vertex.select("id", "ring", "key"))
    rings = spread(vertex.select("id", "ring"), "id", DEALT).groupBy("id").agg(F.count(F.lit(1)).alias("v"), F.count_distinct("ring").alias("r"))
    first = rings.agg(F.count(F.lit(1)).alias("shapes"), F.sum("v").alias("vertices"), F.sum(F.col("r") - 1).alias("holes"))
    places = spread(vertex.select("id", "key"), "key", DEALT).groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = places.filter("least <> most").agg(F.count(F.lit(1)).alias("shared_vertices"))
    return first.crossJoin(F.broadcast(shared))


def ordered_ring(edge: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each vertex around its ring, by its edges' stored order."""
    return edge.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "ring").orderBy("pos")))

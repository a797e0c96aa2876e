"""Operators on edge tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from hustings.shared import by_shuffle, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (id, component) for every id that has an edge to another; the component is the smallest id that can be reached.

    Each round gives every id its smallest neighbour (or itself) as parent, follows parents twice, and contracts the edges to their parents,
    until no edge is left. A star is done in two rounds and a long path in a logarithm of its length, near enough; every round is a few joins
    and sums with partial results, written to the shared folder. Null ends, loops and repeated edges count for nothing.
    """
    a, b = F.col(src), F.col(dst)
    left = materialize(edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p")))
        for _ in range(2):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(by_shuffle(up), "p").select("id", F.col("pp").alias("p"))
        parent = materialize(parent)
        if labels is None:
            labels = parent.select("id", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("id").alias("component"), "p")
            labels = labels.join(by_shuffle(up), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = materialize(labels)
        pa, pb = parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved = left.join(by_shuffle(pa), "a").join(by_shuffle(pb), "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = materialize(moved)
    return labels if labels is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Rows (start, id, hops): what is reached from each start in so many steps at most, and in how many; the start itself in none."""
    step = both_ways(edges)
    reached = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        front = reached.filter(F.col("hops") == k - 1).join(step, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), F.lit(k).alias("hops")).distinct()
        reached = reached.unionByName(front.join(reached.select("start", "id"), ["start", "id"], "left_anti"))
    return reached


def components_in_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (grp, n_parts): connected parts of each group of nodes (id, grp), by the edges inside the group."""
    inside = edges.join(nodes.select(F.col("id").alias("src"), F.col("grp").alias("_g")), "src").join(nodes.select(F.col("id").alias("dst"), "grp"), "dst").filter("_g = grp").select("src", "dst")
    found = connected_components(inside)
    return nodes.join(found, "id", "left").groupBy("grp").agg(F.count_distinct(F.coalesce("component", "id")).alias("n_parts"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, average and largest degree, nodes without an edge."""
    degree = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    each = nodes.select("id").join(degree, "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return each.agg((F.sum("d") / 2).cast("long").alias("edges"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"), F.count_if(F.col("d") == 0).alias("isolated"))


def smoothness(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One row: the mean over edges of the squared difference of the logarithms at their ends."""
    log = F.ln(F.greatest(F.col("value"), F.lit(1e-6)))
    a, b = values.select(F.col("id").alias("src"), log.alias("a")), values.select(F.col("id").alias("dst"), log.alias("b"))
    return edges.join(a, "src").join(b, "dst").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("smoothness"))


def valid_priors(priors: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """Priors (keys, type, p) of the valid types of each key only, scaled to a sum of 1; a key whose valid types have none gets equal shares."""
    kept = valid.join(by_shuffle(priors), [*keys, "type"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    sums = kept.groupBy(*keys).agg(F.sum("p").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return kept.join(by_shuffle(sums), keys).select(*keys, "type", F.when(F.col("_s") > 0, F.col("p") / F.col("_s")).otherwise(1 / F.col("_n")).alias("p"))


def fallback_type(rows: DataFrame, valid: DataFrame, key: str, chain: list[str]) -> DataFrame:
    """Rows with their type if it is valid for their key, else the nearest valid one along the chain: down first, then up."""
    place = {t: i for i, t in enumerate(chain)}
    at = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col(c))
    options = rows.join(valid.select(key, F.col("type").alias("_v")), key)
    gap = at("_v") - at("type")
    order = F.struct(F.when(gap >= 0, 0).otherwise(1), F.abs(gap))
    return options.groupBy("id", key).agg(F.min_by("_v", order).alias("type"))


def colour_rounds(nodes: DataFrame, edges: DataFrame, seed: str = "colours") -> DataFrame:
    """Rows (id, colour): a colour from 0 for each node, so that no two neighbours have the same.

    A number drawn by the seed and the id orders the nodes. In each round the open nodes that come before all of their open neighbours get the round's
    number, at once; so the rounds are as many as the longest falling path of numbers, a logarithm of the nodes where degrees are bounded. Every round
    is written to the shared folder; a node meets its neighbours only as partial minima.
    """
    from hustings.functions.numbers import keyed_uniform

    order = nodes.select("id", keyed_uniform(seed, "id").alias("p")).distinct()
    ends = order.select(F.col("id").alias("src"), F.struct("p", "id").alias("ps")), order.select(F.col("id").alias("dst"), F.struct("p", "id").alias("pd"))
    left = materialize(both_ways(edges).filter("src <> dst").distinct().join(by_shuffle(ends[0]), "src").join(by_shuffle(ends[1]), "dst"))
    open_, done, colour = materialize(order.select("id")), None, 0
    while not open_.isEmpty():
        behind = left.groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("pd") < F.col("ps")).alias("b")).filter("b")
        told = materialize(open_.join(by_shuffle(behind), "id", "left").select("id", F.col("b").isNull().alias("first")))
        first, open_ = told.filter("first").select("id"), told.filter("not first").select("id")
        coloured = first.withColumn("colour", F.lit(colour))
        done = coloured if done is None else done.unionByName(coloured)
        left = materialize(left.join(by_shuffle(first.withColumnRenamed("id", "src")), "src", "left_anti").join(by_shuffle(first.withColumnRenamed("id", "dst")), "dst", "left_anti"))
        colour += 1
    return done if done is not None else open_.select("id", F.lit(0).alias("colour"))


def blend_step(nodes: DataFrame, edges: DataFrame, priors: DataFrame, moves: DataFrame, weight: float, seed: str, colour: int) -> DataFrame:
    """Nodes (id, key, type, frozen, colour) after those of one colour have drawn a new label.

    A node's distribution is its key's prior blended with the average of what its neighbours' types lead to (``moves``: from_type, type, p),
    ``weight`` of it; one type is drawn by a number that depends on the seed and the node. Frozen nodes keep theirs.
    """
    from hustings.functions.numbers import keyed_uniform
    from hustings.operators.windows import inverse_cdf

    mine = nodes.filter((F.col("colour") == colour) & ~F.col("frozen")).select("id", "key")
    near = both_ways(edges).join(by_shuffle(mine.select(F.col("id").alias("src"))), "src").join(by_shuffle(nodes.select(F.col("id").alias("dst"), F.col("type").alias("from_type"))), "dst")
    counts = near.groupBy(F.col("src").alias("id"), "from_type").agg(F.count(F.lit(1)).alias("n"))
    pulled = counts.join(moves, "from_type").groupBy("id", "type").agg((F.sum(F.col("p") * F.col("n"))).alias("q"))
    total = counts.groupBy("id").agg(F.sum("n").alias("degree"))
    options = mine.join(by_shuffle(priors), "key").join(by_shuffle(pulled), ["id", "type"], "left").join(by_shuffle(total), "id", "left")
    blended = F.when(F.col("degree").isNull(), F.col("p")).otherwise((1 - weight) * F.col("p") + weight * F.coalesce("q", F.lit(0.0)) / F.col("degree"))
    drawn = inverse_cdf(options.withColumn("w", blended), ["id"], "type", "w", keyed_uniform(seed, "id"), "type").withColumnRenamed("type", "_new")
    return nodes.join(by_shuffle(drawn), "id", "left").select("id", "key", F.coalesce("_new", "type").alias("type"), "frozen", "colour")


def blend_labels(nodes: DataFrame, edges: DataFrame, priors: DataFrame, moves: DataFrame, weight: float = 0.5, sweeps: int = 3, stop_at: float = 0.0, seed: str = "labels") -> DataFrame:
    """Nodes (id, key, type, frozen) with new types, after sweeps over all nodes, until a sweep changes at most a share ``stop_at`` of them.

    A sweep goes through the colours of :func:`colour_rounds`. Nodes of a colour are no neighbours, so they draw at once (:func:`blend_step`), and those of
    the next colour see what they drew, as in a sweep over one node after the other. Each step is written to the shared folder.
    """
    colours = materialize(colour_rounds(nodes, edges, seed))
    last = colours.agg(F.max("colour")).first()[0]
    now = materialize(nodes.select("id", "key", "type", "frozen").join(by_shuffle(colours), "id"))
    for k in range(sweeps):
        before = now
        for colour in range(0 if last is None else last + 1):
            now = materialize(blend_step(now, edges, priors, moves, weight, f"{seed}-{k}", colour))
        change = before.select("id", F.col("type").alias("_t")).join(by_shuffle(now), "id").agg(F.avg((F.col("_t") != F.col("type")).cast("double"))).first()[0]
        if (change or 0.0) <= stop_at:
            break
    return now.drop("colour")


def candidate_losses(areas: DataFrame, targets: DataFrame, candidates: list[float], density) -> DataFrame:
    """Rows (candidate, loss): mean squared relative error of each group's predicted population; ``density`` makes a column of area and candidate.

    Each area meets the few candidates in its own row; sums by candidate and group are partial first.
    """
    each = areas.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in candidates]))).withColumn("_p", density(F.col("area")) * F.col("area"))
    sums = each.groupBy("candidate", "grp").agg(F.sum("_p").alias("_p")).join(targets, "grp")
    return sums.groupBy("candidate").agg(F.avg(((F.col("_p") - F.col("target")) / F.col("target")) ** 2).alias("loss"))

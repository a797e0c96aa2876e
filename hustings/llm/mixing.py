"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import SPACE, documents, materialize, private_names, put_back, salt, salts_for, set_apart

WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    """Number of words between the six white-space characters; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+", -1))).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    Sources in code point order, null last, take the weights in turn; targets are in proportion to them and sum to ``share`` of all sizes, but
    none is above ``most`` times its source's size: what is over is shared again among the rest by weight. The sources that reach their limit
    are those with the least limit for their weight, so sorted by that, the level is found by running sums. One row a source; a source of size
    0 has target 0.
    """
    place = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * most
    rows = sizes.withColumn("__w", weight).withColumn("__limit", limit).withColumn("__level", F.col("__limit") / F.col("__w"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("__level", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    light = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    rows = rows.withColumn("__open", (F.sum("source_size").over(everything) * share - full) / light)
    # the first source, in order of level, that does not reach its limit sets the level of all that follow
    level = F.min(F.when(F.col("__open") <= F.col("__level"), F.struct(F.col("__level"), F.col("__open")))).over(everything)["__open"]
    return rows.select(source, "source_size", F.least(F.col("__limit"), F.coalesce(level * F.col("__w"), F.col("__limit"))).alias("target"))


@private_names
def mix_sources(docs: DataFrame, size: Column, source: str = "source", order: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``: how often the mix takes the row (0 or more, at most ``most`` rounded up).

    Every row of a source is expected target / source_size times. The expectations are summed along the source, ordered by size and then at
    random, from one offset drawn for the source; a row is taken once for each integer that its part of the sum crosses. So neighbours in size
    share the copies evenly, and the words taken come near the target. Offsets and order depend on the seed and the rows alone: reruns agree.
    Sizes are coalesced to 0. Repeated rows are sampled one by one; rows that tie in ``order`` get the same number of copies or one apart.

    Rows are ranked in groups of (source, size class, salt), so that no task has a whole source; the sums by group come first and are small.
    There are as many salts as it takes to rank about 100,000 rows at a time if all were of one source and size. The targets are found in one
    task that has a row for each source. Columns named size, source_size, target or copies in ``docs`` are replaced, all others pass through. A
    null source is one of its own. An empty table gives an empty one.
    """
    names = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in names]
    salts = salts_for(docs.count())
    sized = docs.select(*kept, F.coalesce(size, F.lit(0)).cast("long").alias("size"), salt(salts, F.lit(seed), *order).alias("__salt"))
    sized = sized.withColumn("__class", F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
    groups = materialize(sized.groupBy(source, "__class", "__salt").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size")))
    targets = source_targets(groups.groupBy(source).agg(F.sum("__size").alias("source_size")), source, weights, share, most)
    targets = targets.select(F.col(source).alias("__t_source"), "source_size", "target")
    before = Window.partitionBy(source).orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(targets, F.col(source).eqNullSafe(F.col("__t_source")))
    groups = groups.select(F.col(source).alias("__g_source"), F.col("__class").alias("__g_class"), F.col("__salt").alias("__g_salt"), "__base", "source_size", "target")
    joined = sized.join(groups, F.col(source).eqNullSafe(F.col("__g_source")) & (F.col("__class") == F.col("__g_class")) & (F.col("__salt") == F.col("__g_salt")), "left")
    within = Window.partitionBy(source, "__class", "__salt").orderBy(F.xxhash64(F.lit(seed), *order), *order)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col(source)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = joined.withColumn("__rank", F.col("__base") + F.row_number().over(within))
    copies = F.floor(F.col("__rank") * rate + offset) - F.floor((F.col("__rank") - 1) * rate + offset)
    return rows.select(*kept, "size", "source_size", "target", copies.cast("long").alias("copies"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by words."""
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("words")))
    mixed = mix_sources(sized, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by words: each row as often as the sample takes it, 0 to 2 times.

    Sources that the weights favour double at most, others shrink. A row without words has its source's rate like any other. Rows with a null
    source are a source; repeated rows are sampled one by one.

    An empty table gives an empty one.
    """
    inner, names = set_apart(docs)
    mixed = mix_sources(inner, n_words(F.col(names["text"])), names["source"], (names["doc_id"],))
    return put_back(mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), names)

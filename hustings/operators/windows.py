"""Operators that depend on an order of rows; the order is always a column, never the order of arrival."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from hustings.shared import materialize


def ranked_in_group(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 among the rows with the same ``keys`` (null is a key); without keys, among all rows.

    Rows are dealt by ranges of (keys, order) and written; each range numbers its own rows, from where the counts of the ranges before end. So a
    group of any size, or the whole table, is numbered by many tasks; what runs in one task is a sum over a group's ranges. Rows that tie in
    ``order`` come in any order. ``order`` may be expressions, with asc() or desc().
    """
    parts = [F.col(k) for k in keys]
    at = materialize(rows.repartitionByRange(*parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_n")
    bases = counts.select(*[f"_k{i}" for i in range(len(keys))], "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    others = [c for c in rows.columns if c != name]
    return at.join(bases, same).select(*others, (F.col("_base") + place).cast("long").alias(name))


def with_previous(rows: DataFrame, keys: list[str], order: list[Column | str], columns: list[str], rank: str = "_rank") -> DataFrame:
    """``rows`` with ``rank`` and, of the row before in the group, each of ``columns`` as prev_{column}; the first row of a group has nulls."""
    at = materialize(ranked_in_group(rows, keys, order, rank))
    last = at.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(rank) + 1).alias("_after"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    same = F.col(rank) == F.col("_after")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return at.join(last, same, "left").select(*at.columns, *[f"prev_{c}" for c in columns])


def group_max(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The largest value of the group on each of its rows: partial maxima first, then a join, so a large group is no single task."""
    most = rows.groupBy(*keys).agg(F.max(value).alias(name))
    return rows.join(most, keys, "left")


def rescale_to(rows: DataFrame, keys: list[str], value: Column, weight: Column, target: str, name: str) -> DataFrame:
    """``value`` so that its weighted sum over the group is the group's ``target``; groups with a sum of 0 keep their values."""
    sums = rows.groupBy(*keys).agg(F.sum(value * weight).alias("_sum"))
    joined = rows.join(sums, keys, "left")
    return joined.withColumn(name, F.when(F.col("_sum") > 0, value * F.col(target) / F.col("_sum")).otherwise(value)).drop("_sum")


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by partial minima of (order, row)."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_f"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in rows.columns])


def padded(number: Column, digits: int) -> Column:
    """``number`` with zeros in front up to so many digits; a longer number stays whole (lpad alone would cut it)."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), "0")


def clockwise_ids(rows: DataFrame, keys: list[str], x: Column, y: Column, cx: Column, cy: Column, prefix: Column, digits: int = 3, start: float = 1.5707963267948966, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with new_id: prefix and number, by angle around (cx, cy) clockwise from ``start``; ties from the centre out, then by place, then by ``ties``."""
    angle = F.pmod(F.lit(start) - F.atan2(y - cy, x - cx), F.lit(6.283185307179586))
    ranked = ranked_in_group(rows, keys, [F.round(angle, 9), (x - cx) * (x - cx) + (y - cy) * (y - cy), x, y, *ties], "_place")
    return ranked.withColumn("new_id", F.concat(prefix, padded(F.col("_place"), digits))).drop("_place")


def suffixed_keys(rows: DataFrame, key: str, order: list[str], name: str = "key") -> DataFrame:
    """Repeated keys as key, key_2, key_3, in the given order."""
    n = F.col("_place")
    return ranked_in_group(rows, [key], order, "_place").withColumn(name, F.when(n > 1, F.concat_ws("_", F.col(key), n.cast("string"))).otherwise(F.col(key))).drop("_place")


def stretched(rows: DataFrame, first: Column, last: Column, name: str, block: int = 10_000) -> DataFrame:
    """A row for each number from ``first`` to ``last``; a long stretch is made in blocks, so that no row holds an array of more than ``block``."""
    blocks = rows.withColumn("_from", F.explode(F.when(last >= first, F.sequence(first, last, F.lit(block).cast("long")))))
    return blocks.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + block - 1, last)))).drop("_from")


def gaps(used: DataFrame, group: str, number: str) -> DataFrame:
    """Rows (group, first, last, free): stretches of numbers from 1 that ``used`` lacks below its numbers, and how many are free before each.

    Distinct numbers are held against the one before in their group; no list of all numbers is made, however large they are.
    """
    distinct = used.select(F.col(group).alias("_g"), F.col(number).cast("long").alias("_n")).filter("_n >= 1").distinct()
    prev = F.coalesce("prev__n", F.lit(0))
    at = with_previous(distinct, ["_g"], ["_n"], ["_n"]).filter(F.col("_n") > prev + 1)
    return at.select(F.col("_g").alias(group), (prev + 1).alias("first"), (F.col("_n") - 1).alias("last"), (prev - (F.col("_rank") - 1)).alias("free"))


def free_ids(used: DataFrame, group: str, number: str, wanted: DataFrame, count: str, digits: int = 3) -> DataFrame:
    """Rows (group, new_id): for each group of ``wanted`` its ``count`` smallest unused numbers from 1, as group and number."""
    distinct = used.select(group, F.col(number).cast("long").alias("_n")).filter("_n >= 1").distinct()
    most = distinct.groupBy(group).agg(F.max("_n").alias("_max"), F.count(F.lit(1)).alias("_used"))
    # behind the largest number all are free
    behind = wanted.join(most, group, "left").select(group, count, (F.coalesce("_max", F.lit(0)) + 1).alias("first"), F.lit(None).cast("long").alias("last"), (F.coalesce("_max", F.lit(0)) - F.coalesce("_used", F.lit(0))).alias("free"))
    open_ = gaps(used, group, number).join(wanted.select(group, count), group).select(group, count, "first", "last", "free").unionByName(behind)
    upto = F.col("first") + F.col(count).cast("long") - F.col("free") - 1
    found = stretched(open_.filter(F.col("free") < F.col(count)), F.col("first"), F.least(F.col("last"), upto), "_n")
    return found.select(group, F.concat(F.col(group).cast("string"), F.lit("_"), padded(F.col("_n"), digits)).alias("new_id"))


def earliest_free_slot(rows: DataFrame, keys: list[str], order: str, ready: Column, duration: Column, slots: Column) -> DataFrame:
    """Rows (keys, order, slot, done): in order, each row takes the slot of its group that is free first (the first of equals), not before it is ready.

    Times are seconds. The slots of a group are the most that a row of it names. Rows come sorted by group and order, and a task holds one heap of slots
    while they pass; so a group costs its rows times the logarithm of its slots, and is in no place as a whole.
    """
    most = rows.groupBy(*keys).agg(F.max(slots).cast("int").alias("_s"))
    items = rows.select(*keys, F.col(order), ready.cast("double").alias("_r"), duration.cast("double").alias("_d")).join(most, keys)
    kinds = dict(rows.select(*keys, order).dtypes)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        for batch in batches:
            group = list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True))
            taken, done = [], []
            for key, at, takes, s in zip(group, *[batch.column(n + i).to_pylist() for i in (1, 2, 3)], strict=True):
                if key != now:
                    now, heap = key, [(0.0, i) for i in range(s)]
                free, slot = heap[0]
                end = max(free, at) + takes
                heapq.heapreplace(heap, (end, slot))
                taken.append(slot)
                done.append(end)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(taken, pa.int32()), pa.array(done, pa.float64())], names=[*keys, order, "slot", "done"])

    ordered = items.select(*keys, order, "_r", "_d", "_s").repartition(*keys).sortWithinPartitions(*keys, order)
    return ordered.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keys, order)], "slot int, done double"]))


def runs_by_region(rows: DataFrame, order: str, region: str, group: list[str]) -> DataFrame:
    """Rows (group, run, region, first, last, n): neighbours in order with the same region make a run."""
    at = materialize(with_previous(rows.select(*group, order, region), group, [order], [order, region], "_r"))
    starts = at.filter((F.col("_r") == 1) | ~F.col(region).eqNullSafe(F.col(f"prev_{region}")))
    starts = materialize(ranked_in_group(starts, group, [order], "run"))
    # a run ends where the next begins; the last one, with its group
    key = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    following = starts.select(*key, (F.col("run") - 1).alias("_run"), F.col(f"prev_{order}").alias("_last"), F.col("_r").alias("_next"))
    whole = at.groupBy(*group).agg(F.max(order).alias("_end"), F.count(F.lit(1)).alias("_size")).select(*key, "_end", "_size")
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    runs = starts.join(following, same & (F.col("run") == F.col("_run")), "left").drop(*[f"_g{i}" for i in range(len(group))]).join(whole, same)
    last, next_ = F.coalesce("_last", "_end"), F.coalesce("_next", F.col("_size") + 1)
    return runs.select(*group, "run", region, F.col(order).alias("first"), last.alias("last"), (next_ - F.col("_r")).alias("n"))


def inverse_cdf(rows: DataFrame, keys: list[str], order: str, weight: str, uniform: Column, name: str) -> DataFrame:
    """One row a key: the category, in order, where the running share of weights first passes ``uniform``; weights need not sum to 1."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_c", F.sum(weight).over(upto)).withColumn("_t", F.sum(weight).over(w)).withColumn("_u", uniform)
    return marked.filter((F.col("_t") > 0) & (F.col("_u") * F.col("_t") < F.col("_c"))).groupBy(*keys).agg(F.min_by(name, order).alias(name))

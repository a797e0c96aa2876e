"""Draws that depend on keys alone, and their reconciliation to exact totals; all row arithmetic, so without any shuffle."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from hustings.functions.numbers import keyed_normal, once


def gated_draw(seed: str, mean: Column, sd: Column, keys: list[Column | str], low: float | None, high: float | None, attempts: int = 10, reference: Column | None = None) -> tuple[Column, Column]:
    """(value, unresolved): the first of ``attempts`` draws that is in range, else the last; whether none was.

    With a ``reference`` the range is for the draw over it, and a reference of 0 is never out of range.
    """

    def good(v: Column) -> Column:
        metric = v if reference is None else F.when(reference != 0, v / reference).otherwise(0.0)
        ok = F.lit(True)
        ok = ok & (metric >= low) if low is not None else ok
        ok = ok & (metric <= high) if high is not None else ok
        return ok if reference is None else ok | (reference == 0)

    # one draw in the plan, whatever the number of attempts: it is made anew only until one is in range
    def attempt(now: Column, k: Column) -> Column:
        value = F.when(now["ok"], now["v"]).otherwise(keyed_normal(seed, mean, sd, *keys, k))
        return F.transform(F.array(value), lambda v: F.struct(v.alias("v"), good(v).alias("ok")))[0]

    found = F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), F.struct(F.lit(0.0).alias("v"), F.lit(False).alias("ok")), attempt)
    return found["v"], ~found["ok"]


def clamp(value: Column, reference: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, reference))


def reconcile_two(total: Column, other: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """a + b + other = total: the smaller keeps its draw, the larger (a on a tie) takes what is left."""
    return F.when(a >= b, total - b - other).otherwise(a), F.when(a >= b, b).otherwise(total - a - other)


def reconcile(values: Column, total: Column) -> Column:
    """An array of parts of a total that add up to it: in ascending order (ties by place) each keeps its draw or what is left; the last takes the rest."""
    none = F.array().cast("array<struct<i:int,v:bigint>>")

    def shared(vs: Column) -> Column:
        ordered = F.array_sort(F.transform(vs, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        start = F.struct(total.cast("long").alias("left"), F.size(vs).alias("k"), none.alias("done"))

        def step(acc: Column, x: Column) -> Column:
            take = F.when(acc["k"] == 1, acc["left"]).otherwise(F.least(x["v"].cast("long"), acc["left"])).cast("long")
            return F.struct((acc["left"] - take).alias("left"), (acc["k"] - 1).alias("k"), F.concat(acc["done"], F.array(F.struct(x["i"].alias("i"), take.alias("v")))).alias("done"))

        return F.transform(F.array_sort(F.aggregate(ordered, start, step, lambda acc: acc["done"])), lambda x: x["v"])

    # the parts may be draws: they are made once
    return once(values, shared)


def residual_into_largest(values: Column, total: Column) -> Column:
    """The difference to the total goes to the first of the largest parts."""
    at = F.array_position(values, F.array_max(values)) - 1
    rest = total - F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    return F.transform(values, lambda v, i: F.when(i == at, v + rest).otherwise(v))

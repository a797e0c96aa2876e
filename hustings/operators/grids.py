"""Grid cells of many sizes as join keys. A cell of level k is 2 to the power of k wide, so that large things have few cells and small ones too."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: Things smaller than a cell of this level are in cells of this level.
LEAST = -40


def width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level.cast("double"))


def level_of(extent: Column, least: float | None = None) -> Column:
    """The least level whose cells are as wide as ``extent``, or as ``least``."""
    floor = F.lit(2.0**LEAST if least is None else least)
    return F.ceil(F.log2(F.greatest(extent, floor))).cast("int")


def cell_of(v: Column, level: Column) -> Column:
    return F.floor(v / width(level)).cast("long")


def levels_in(df: DataFrame, column: str = "level") -> list[int]:
    """The levels that there are: some dozens at most, since each is half as wide as the next."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def at_levels(df: DataFrame, levels: list[int], own: Column | None = None, name: str = "level") -> DataFrame:
    """Each row once for each of ``levels``, from ``own`` on where it is given: so small things meet large ones in the cells of these."""
    all_ = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    return df.withColumn(name, F.explode(all_ if own is None else F.filter(all_, lambda k: k >= own)))


def line_cells(x1: Column, y1: Column, x2: Column, y2: Column, level: Column) -> Column:
    """An array of (cx, cy): the cells that a segment crosses, column by column; as many as it is cells long, not as its box has.

    Cells that it comes near to by rounding are there too.
    """
    w = width(level)
    pad = w * 1e-9 + F.greatest(F.abs(x1), F.abs(x2), F.abs(y1), F.abs(y2)) * 1e-12
    x0, x9, y0, y9 = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    cell = lambda v: F.floor(v / w).cast("long")
    slope = F.coalesce((y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)), F.lit(0.0))
    at = lambda x: y1 + (x - x1) * slope

    def column(cx: Column) -> Column:
        a, b = F.greatest(x0, cx * w), F.least(x9, (cx + 1) * w)
        low = F.when(x1 == x2, y0).otherwise(F.greatest(y0, F.least(at(a), at(b))))
        high = F.when(x1 == x2, y9).otherwise(F.least(y9, F.greatest(at(a), at(b))))
        return F.transform(F.sequence(cell(F.least(low, y9) - pad), cell(F.greatest(high, y0) + pad)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(x0 - pad), cell(x9 + pad)), column))


def box_cells(x0: Column, y0: Column, x1: Column, y1: Column, level: Column) -> Column:
    """An array of (cx, cy): the cells that a box meets."""
    columns, rows = F.sequence(cell_of(x0, level), cell_of(x1, level)), F.sequence(cell_of(y0, level), cell_of(y1, level))
    return F.flatten(F.transform(columns, lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

"""Polygons as arrays of rings, rings as arrays of points (x, y); all by built-in array functions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .numbers import col, once

_DIGITS = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"
RINGS = "array<array<struct<x:double,y:double>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def parse_centroid(c: Column | str) -> Column:
    """Text such as "(1.5, 2)" as a point; null where it is something else."""
    found = lambda i: F.regexp_extract(col(c), rf"^\s*\(\s*({_DIGITS})\s*,\s*({_DIGITS})\s*\)\s*$", i).try_cast("double")
    return F.when(found(1).isNotNull(), point(found(1), found(2)))


def parse_wkt(c: Column | str) -> Column:
    """Rings of a POLYGON text, the outer first. Bad text gives no rings, never an error; points that are no numbers are left out."""
    body = F.regexp_extract(col(c), r"(?is)^\s*POLYGON\s*(?:Z\s*)?\(\s*\((.*)\)\s*\)\s*$", 1)
    none = F.array().cast(RINGS)

    def points(ring: Column) -> Column:
        numbers = F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+"))
        made = F.transform(numbers, lambda p: point(F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")))
        return F.filter(made, lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    rings = lambda b: F.filter(F.transform(F.split(b, r"\)\s*,\s*\("), points), lambda r: F.size(r) > 0)
    return once(body, lambda b: F.when(b == "", none).otherwise(F.coalesce(rings(b), none)))


def to_wkt(rings: Column | str) -> Column:
    """POLYGON text; whole numbers are written without a fraction. No rings give POLYGON EMPTY."""
    number = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", "), F.lit(")"))
    return F.when(F.size(col(rings)) > 0, F.concat(F.lit("POLYGON ("), F.array_join(F.transform(col(rings), ring), ", "), F.lit(")"))).otherwise("POLYGON EMPTY")


def close_ring(ring: Column) -> Column:
    """The first point once more at the end, unless it is there."""
    first = F.get(ring, F.lit(0))
    return F.when((F.size(ring) > 0) & (first != F.element_at(ring, -1)), F.concat(ring, F.array(first))).otherwise(ring)


def open_ring(ring: Column) -> Column:
    """Without the last point if it repeats the first."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def open_rings(rings: Column | str) -> Column:
    """All rings opened, to be exploded as they are: of a plain column that is exploded Spark makes a filter, and takes it below where the rows are dealt to tasks,
    so that one task of few reads all texts to find rows without rings."""
    return F.transform(col(rings), open_ring)


def round_ring(ring: Column, digits: int) -> Column:
    return F.transform(ring, lambda p: point(F.round(p["x"], digits), F.round(p["y"], digits)))


def _neighbours(ring: Column, f) -> Column:
    """``f`` of each point of an open ring and the next."""
    return once(ring, lambda r: F.zip_with(r, F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1)), f))


def simplify_ring(ring: Column) -> Column:
    """An open ring without the points that lie on the line of their neighbours; a ring of three points or fewer stays."""
    n = F.size(ring)

    def corner(p: Column, i: Column) -> Column:
        a, b = F.get(ring, F.when(i > 0, i - 1).otherwise(n - 1)), F.get(ring, F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])

    return F.when(n > 3, F.filter(ring, corner)).otherwise(ring)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Positive where the ring runs counter-clockwise."""
    return _sum(_neighbours(open_ring(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def is_clockwise(ring: Column) -> Column:
    return signed_area(ring) < 0


def area(rings: Column | str) -> Column:
    """The outer ring's area less the holes'."""
    sizes = F.transform(col(rings), lambda r: F.abs(signed_area(r)))
    return once(sizes, lambda s: F.when(F.size(s) > 0, 2 * F.get(s, F.lit(0)) - _sum(s)).otherwise(0.0))


def perimeter(ring: Column) -> Column:
    return _sum(_neighbours(open_ring(ring), lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))))


def centroid(ring: Column) -> Column:
    """Of the area inside a ring; the mean of its points where that is 0."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]

    def of(ring: Column) -> Column:
        x = _sum(_neighbours(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)))
        y = _sum(_neighbours(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)))
        n = F.size(ring)
        mean = point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n)
        return once(signed_area(ring) * 6, lambda a6: F.when(a6 != 0, point(x / a6, y / a6)).otherwise(mean))

    return once(open_ring(ring), of)


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the ring an odd number of times."""

    def crosses(p: Column, q: Column) -> Column:
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    hits = F.filter(_neighbours(open_ring(ring), crosses), lambda h: F.coalesce(h, F.lit(False)))
    return F.size(hits) % 2 == 1


def inside(x: Column, y: Column, rings: Column | str) -> Column:
    """In an odd number of the rings: inside the outer and outside the holes."""
    return F.size(F.filter(col(rings), lambda r: inside_ring(x, y, r))) % 2 == 1


def compactness(area: Column, perimeter: Column) -> Column:
    """1 for a circle, less for longer shapes; 0 without a border."""
    return once(perimeter, lambda p: F.when(p > 0, 4 * F.pi() * area / (p * p)).otherwise(0.0))


def distance(x0: Column, y0: Column, x1: Column, y1: Column, units: float = 1.0) -> Column:
    """Straight distance; ``units`` of the map make one of the result."""
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) / units

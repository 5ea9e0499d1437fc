"""Measures of rings, arrays of struct<x, y> without the repeated first vertex, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """array<struct<a, b>>: each vertex and the next one, the last one's being the first."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.when(F.size(ring) > 0, F.zip_with(ring, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return total(F.transform(edges(ring), lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]).cast("double"))) / 2


def area(ring: Column, holes: Column | None = None) -> Column:
    """Area by the shoelace formula, less that of the holes (an array of rings)."""
    own = F.abs(signed_area(ring))
    return own if holes is None else own - total(F.transform(holes, lambda h: F.abs(signed_area(h))))


def length(ring: Column) -> Column:
    return total(F.transform(edges(ring), lambda e: F.hypot((e["b"]["x"] - e["a"]["x"]).cast("double"), (e["b"]["y"] - e["a"]["y"]).cast("double"))))


def perimeter(ring: Column, holes: Column | None = None) -> Column:
    return length(ring) if holes is None else length(ring) + total(F.transform(holes, length))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        (ax, ay), (bx, by) = ((e[k]["x"].cast("double"), e[k]["y"].cast("double")) for k in "ab")
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def bounds(ring: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def rotated_rectangle(hull: Column) -> Column:
    """struct<area, length, breadth> of the least rectangle along an edge of a convex hull; ties go to the shorter one."""

    def along(e: Column) -> Column:
        dx, dy = (e["b"]["x"] - e["a"]["x"]).cast("double"), (e["b"]["y"] - e["a"]["y"]).cast("double")
        size = F.hypot(dx, dy)
        u = F.transform(hull, lambda p: ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / size)
        v = F.transform(hull, lambda p: ((p["y"] - e["a"]["y"]) * dx - (p["x"] - e["a"]["x"]) * dy) / size)
        w, h = F.array_max(u) - F.array_min(u), F.array_max(v) - F.array_min(v)
        return F.struct(F.round(w * h, 6).alias("area"), F.greatest(w, h).alias("length"), F.least(w, h).alias("breadth"))

    return F.array_min(F.transform(F.filter(edges(hull), lambda e: e["a"] != e["b"]), along))

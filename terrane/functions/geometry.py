"""Planar geometry on arrays of points (x, y) as columns, and coordinates between two common systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius of web Mercator.
RADIUS = 6378137.0


def _pairs(points: Column) -> Column:
    n = F.size(points)
    return F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def area(ring: Column) -> Column:
    """Area of a closed ring, in square units of its coordinates."""
    twice = F.aggregate(_pairs(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    return F.abs(twice) / 2


def length(line: Column) -> Column:
    """Length of a line, in units of its coordinates."""
    return F.aggregate(
        _pairs(line), F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], F.lit(2)) + F.pow(p["b"]["y"] - p["a"]["y"], F.lit(2)))
    )


def turn(o: Column, a: Column, b: Column) -> Column:
    """Above 0 if o, a, b turn to the left, 0 if they lie on a line."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def within(side: Column, p: Column) -> Column:
    """Whether a point of the side's line lies on the side."""
    return p["x"].between(F.least(side["a"]["x"], side["b"]["x"]), F.greatest(side["a"]["x"], side["b"]["x"])) & p["y"].between(
        F.least(side["a"]["y"], side["b"]["y"]), F.greatest(side["a"]["y"], side["b"]["y"])
    )


def meet(s: Column, t: Column) -> Column:
    """Whether two sides cross or touch."""
    turns = [turn(s["a"], s["b"], t["a"]), turn(s["a"], s["b"], t["b"]), turn(t["a"], t["b"], s["a"]), turn(t["a"], t["b"], s["b"])]
    crossed = (F.signum(turns[0]) * F.signum(turns[1]) < 0) & (F.signum(turns[2]) * F.signum(turns[3]) < 0)
    ends = [(s, t["a"]), (s, t["b"]), (t, s["a"]), (t, s["b"])]
    touched = [(turn == 0) & within(side, p) for turn, (side, p) in zip(turns, ends, strict=True)]
    return crossed | touched[0] | touched[1] | touched[2] | touched[3]


def doubles_back(s: Column, t: Column) -> Column:
    """Whether a side runs back over the side before it."""
    back = (s["b"]["x"] - s["a"]["x"]) * (t["b"]["x"] - t["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (t["b"]["y"] - t["a"]["y"]) < 0
    return (turn(s["a"], s["b"], t["b"]) == 0) & back


def crosses_itself(ring: Column) -> Column:
    """Whether two sides of a closed ring have a point in common that is not their common corner; repeated points are one.

    Every side is held against every other, so rings of very many points take their square in time.
    """
    points = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    sides = F.transform(_pairs(points), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    last = F.size(sides) - 1

    def with_any(p: Column) -> Column:
        def bad(q: Column) -> Column:
            joined = (q["i"] == p["i"] + 1) | ((p["i"] == last) & (q["i"] == 0))
            apart = (q["i"] > p["i"] + 1) & ~((p["i"] == 0) & (q["i"] == last))
            return (joined & doubles_back(p["s"], q["s"])) | (apart & meet(p["s"], q["s"]))

        return F.exists(sides, bad)

    return F.exists(sides, with_any)


def is_valid_ring(ring: Column) -> Column:
    """Not null, closed, at least four points, some area, and no side that crosses, touches or runs back over another."""
    closed = (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return F.coalesce(closed & (area(ring) > 0) & ~crosses_itself(ring), F.lit(False))


def needs_reprojection(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def to_web_mercator(lon: Column, lat: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    x = F.radians(lon) * RADIUS
    y = F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * RADIUS
    return F.struct(x.alias("x"), y.alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    """EPSG:3857 to EPSG:4326."""
    lat = F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(1.5707963267948966))
    return F.struct(F.degrees(x / RADIUS).alias("x"), lat.alias("y"))

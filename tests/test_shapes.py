"""Well-known binary, and the validity of polygons against all pairs of sides."""

import itertools
import math
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from terrane.functions import wkb
from terrane.operators import shapes


def _shape(kind, parts, z=False, m=False, members=()):
    point = lambda p: {"x": float(p[0]), "y": float(p[1]), "z": float(p[2]) if z else None, "m": float(p[-1]) if m else None}
    return {"kind": kind, "z": z, "m": m, "parts": [[[point(p) for p in ring] for ring in part] for part in parts], "members": list(members)}


def _random_shape(rng, kind, z, m, depth=0):
    point = lambda: tuple(rng.uniform(-1e6, 1e6) for _ in range(2 + z + m))
    line = lambda low: [point() for _ in range(rng.randint(low, 6))]
    one = {1: lambda: [[point()]], 2: lambda: [line(1)], 3: lambda: [line(0) for _ in range(rng.randint(1, 3))]}
    if kind <= 3:
        return _shape(kind, [one[kind]()] if rng.random() < 0.8 else [], z, m)
    if kind <= 6:
        return _shape(kind, [one[kind - 3]() for _ in range(rng.randint(0, 4))], z, m)
    inner = [wkb.write(_random_shape(rng, rng.randint(1, 7 if depth < 2 else 6), z, m, depth + 1), rng.random() < 0.5) for _ in range(rng.randint(0, 3))]
    return _shape(7, [], z, m, inner)


@pytest.mark.parametrize("little", [True, False])
def test_round_trip(spark, little):
    rng = random.Random(1)
    made = [_random_shape(rng, kind, z, m) for kind in range(1, 8) for z in (False, True) for m in (False, True) for _ in range(4)]
    assert all(wkb.parse(wkb.write(s, little)) == s for s in made)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(made)] + [(10_000, None)], f"id int, s {wkb.SCHEMA}").repartition(3)
    out = df.withColumn("b", wkb.encode(F.col("s"), little)).withColumn("again", wkb.decode(F.col("b")))
    assert out.where("not (again <=> s)").count() == 0 and out.where("b is null").count() == 1


def test_other_writers():
    """The flags of the other dialect, a reference number, parts of the other byte order, and what is no shape."""
    flagged = struct.pack("<BII3d", 1, 0x80000000 | 0x20000000 | 1, 4326, 1.0, 2.0, 3.0)
    assert wkb.parse(flagged) == _shape(1, [[[(1, 2, 3)]]], z=True)
    mixed = struct.pack("<BII", 1, 4, 2) + struct.pack(">BI2d", 0, 1, 5, 6) + struct.pack("<BI2d", 1, 1, 7, 8)
    assert wkb.parse(mixed) == _shape(4, [[[(5, 6)]], [[(7, 8)]]])
    whole = wkb.write(_shape(3, [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]))
    for bad in (None, b"", b"\x02", whole[:-1], whole + b"\0", b"\x01\x08\0\0\0", struct.pack("<BII", 1, 2, 2**31), struct.pack("<BII", 1, 4, 1) + whole):
        assert wkb.parse(bad) is None


def _star(rng, n, radius=1.0, x=0.0, y=0.0, rough=0.3):
    ring = [(x + radius * r * math.cos(2 * math.pi * k / n), y + radius * r * math.sin(2 * math.pi * k / n)) for k, r in ((k, 1 - rough * rng.random()) for k in range(n))]
    return ring + ring[:1]


_SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
_HOLE = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]


def _at(ring, x, y):
    return [(a + x, b + y) for a, b in ring]


CASES = {
    "square": (3, [[_SQUARE]], None), "hole": (3, [[_SQUARE, _HOLE]], None), "two holes": (3, [[_SQUARE, _HOLE, _at(_HOLE, 4, 4)]], None),
    "hole at a corner": (3, [[_SQUARE, [(0, 5), (3, 4), (3, 6), (0, 5)]]], None), "holes that touch": (3, [[_SQUARE, _HOLE, _at(_HOLE, 2, 2)]], None),
    "hole that touches twice": (3, [[_SQUARE, [(0, 5), (5, 3), (10, 5), (5, 7), (0, 5)]]], "rings touch twice"),
    "hole outside": (3, [[_SQUARE, _at(_HOLE, 20, 0)]], "hole outside"), "hole across": (3, [[_SQUARE, _at(_HOLE, 7, 0)]], "rings cross"),
    "hole on a side": (3, [[_SQUARE, [(0, 2), (3, 2), (3, 4), (0, 4), (0, 2)]]], "rings cross"), "hole in a hole": (3, [[_SQUARE, [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1)], _HOLE]], "holes nested"),
    "hole twice": (3, [[_SQUARE, _HOLE, _HOLE]], "rings cross"), "bow tie": (3, [[[(0, 0), (2, 2), (2, 0), (0, 3), (0, 0)]]], "self"),
    "spike": (3, [[[(0, 0), (2, 0), (2, 2), (2, 5), (2, 2), (0, 2), (0, 0)]]], "self"), "touches itself": (3, [[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]], "self"),
    "open": (3, [[[(0, 0), (1, 0), (1, 1), (0, 1)]]], "ring"), "no area": (3, [[[(0, 0), (1, 1), (2, 2), (0, 0)]]], "ring"), "repeated point": (3, [[[(0, 0), (1, 0), (1, 0), (1, 1), (0, 0)]]], None),
    "two parts": (6, [[_SQUARE], [_at(_SQUARE, 20, 0)]], None), "parts at a corner": (6, [[_SQUARE], [_at(_SQUARE, 10, 10)]], None),
    "parts side by side": (6, [[_SQUARE], [_at(_SQUARE, 10, 0)]], "rings cross"), "part in a hole": (6, [[_SQUARE, [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1)]], [_HOLE]], None),
    "part in a part": (6, [[_SQUARE], [_HOLE]], "parts overlap"), "parts across": (6, [[_SQUARE], [_at(_SQUARE, 5, 5)]], "rings cross"),
    "no polygon": (6, [], "empty"), "empty": (3, [], "empty"), "point": (1, [[[(1, 2)]]], None), "no point": (1, [], "empty"), "line": (2, [[[(1, 2), (3, 4)]]], None),
    "line of a point": (2, [[[(1, 2), (1, 2)]]], "empty"),
}


def test_validity_of_known_shapes(spark):
    rows = [(name, _shape(kind, parts)) for name, (kind, parts, _) in CASES.items()] + [("null", None)]
    df = spark.createDataFrame(rows, f"name string, s {wkb.SCHEMA}").selectExpr("*", "1 as part", "2 as d", "3 as ring")
    got = {r.name: (r.valid, r.reason) for r in shapes.validity(df, "name", "s").collect()}
    assert got == {name: (reason is None, reason) for name, (_, _, reason) in CASES.items()} | {"null": (False, "empty")}
    assert shapes.validity(df.limit(0), "name", "s").count() == 0


def _meets(a, b, c, d):
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    box = lambda o, p, q: min(o[0], p[0]) <= q[0] <= max(o[0], p[0]) and min(o[1], p[1]) <= q[1] <= max(o[1], p[1])
    sign = lambda v: (v > 0) - (v < 0)
    if sign(turn(a, b, c)) * sign(turn(a, b, d)) < 0 and sign(turn(c, d, a)) * sign(turn(c, d, b)) < 0:
        return True
    return any(turn(o, p, q) == 0 and box(o, p, q) for o, p, q in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))


def test_random_rings_against_all_pairs(spark):
    rng = random.Random(7)
    rings = [_star(rng, rng.randint(4, 40)) for _ in range(40)]
    for _ in range(120):  # corners moved at random, on a coarse grid and on none
        ring = _star(rng, rng.randint(4, 25))[:-1]
        for _ in range(rng.randint(0, 2)):
            ring[rng.randrange(len(ring))] = (rng.uniform(-1, 1), rng.uniform(-1, 1))
        ring = [(round(x * 4), round(y * 4)) for x, y in ring] if rng.random() < 0.4 else ring
        ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
        rings.append(ring + ring[:1])
    want = []
    for ring in rings:
        sides = list(itertools.pairwise(ring))
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in sides)
        ok = len(ring) >= 4 and area != 0
        for (i, s), (j, t) in itertools.combinations(enumerate(sides), 2):
            if j - i == 1 or (i == 0 and j == len(sides) - 1):
                u, v = (s, t) if j - i == 1 else (t, s)
                back = (u[1][0] - u[0][0]) * (v[1][1] - u[0][1]) == (u[1][1] - u[0][1]) * (v[1][0] - u[0][0])
                ok &= not (back and (u[1][0] - u[0][0]) * (v[1][0] - v[0][0]) + (u[1][1] - u[0][1]) * (v[1][1] - v[0][1]) < 0)
            else:
                ok &= not _meets(*s, *t)
        want.append(ok)
    df = spark.createDataFrame([(i, _shape(3, [[ring]])) for i, ring in enumerate(rings)], f"id int, s {wkb.SCHEMA}")
    got = {r.id: r.valid for r in shapes.validity(df, "id", "s").collect()}
    assert [got[i] for i in range(len(rings))] == want and 20 < sum(want) < len(want) - 20


def test_large_rings(spark):
    """A ring of 100,000 points, and one of which two sides cross far from each other in order."""
    rng, n = random.Random(3), 100_000
    good = _star(rng, n, 1000.0, rough=1e-5)
    bad = list(good)
    bad[10], bad[60_010] = bad[60_010], bad[10]
    bad[-1] = bad[0]
    df = spark.createDataFrame([(i, wkb.write(_shape(3, [[ring]]))) for i, ring in enumerate((good, bad))], "id int, b binary").withColumn("s", wkb.decode(F.col("b")))
    pairs = shapes.meetings(shapes.rings(df.where("id = 0"), "id", "s"), "id")
    assert pairs.count() == 0
    began = time.time()
    assert {r.id: r.valid for r in shapes.validity(df, "id", "s").collect()} == {0: True, 1: False}
    assert time.time() - began < 300


def test_area_and_length(spark):
    rows = [(name, _shape(kind, parts)) for name, (kind, parts, _) in CASES.items()]
    df = spark.createDataFrame(rows, f"name string, s {wkb.SCHEMA}").select("name", wkb.area(F.col("s")).alias("a"), wkb.length(F.col("s")).alias("l"), wkb.n_points(F.col("s")).alias("n"))
    got = {r.name: (r.a, r.l, r.n) for r in df.collect()}
    assert got["two holes"] == (92.0, 56.0, 15) and got["two parts"] == (200.0, 80.0, 10) and got["point"] == (0.0, 0.0, 1)
    assert got["line"][0] == 0.0 and abs(got["line"][1] - 8**0.5) < 1e-12 and got["no polygon"] == (0.0, 0.0, 0)

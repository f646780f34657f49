"""Validity of polygons of any size, by an equality join of their sides.

A polygon is valid if its rings are closed, have some area and touch neither themselves nor each other but in single
points, its holes lie within its outer ring and apart from each other, and, of several polygons, their insides are
apart. Every side is put into the squares of a grid that it touches, which are as wide as the shape's sides are long, and
sides are held against those of the same square only. So a ring of n points takes some n pairs, unless its sides crowd in few squares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry, wkb
from terrane.session import cut


#: What may be wrong, the first of which is told.
REASONS = ("ring", "self", "rings cross", "rings touch twice", "hole outside", "holes nested", "parts overlap")


def rings(shapes: DataFrame, key: str, shape: str) -> DataFrame:
    """key, part, ring, points (repeated points once) of each ring of polygons."""
    per = shapes.where(F.col(shape)["kind"].isin(wkb.POLYGON, wkb.MULTI_POLYGON)).select(key, F.posexplode(F.col(shape)["parts"]).alias("part", "rings"))
    per = per.select(key, "part", F.posexplode("rings").alias("ring", "all"))
    apart = F.filter("all", lambda p, i: (i == 0) | (p["x"] != F.get("all", i - 1)["x"]) | (p["y"] != F.get("all", i - 1)["y"]))
    return per.select(key, "part", "ring", F.transform(apart, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def sides(found: DataFrame, key: str) -> DataFrame:
    """key, part, ring, i, n, ax, ay, bx, by: the sides of each ring, in order, of n."""
    pairs = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = found.select(key, "part", "ring", F.greatest(F.size("points") - 1, F.lit(0)).alias("n"), F.posexplode(pairs).alias("i", "s"))
    return out.select(key, "part", "ring", "i", "n", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _in_squares(of: DataFrame, key: str) -> DataFrame:
    """The sides with the squares (u, v) that they touch. Squares are as wide as the shape's sides are long on average; longer sides are
    looked at in pieces, of which there are no more than sides."""
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    box = of.groupBy(key).agg(F.avg(size).alias("d"), F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"))
    cut = of.join(box, key).withColumn("pieces", F.greatest(F.lit(1), F.ceil(size / F.col("d"))).cast("int"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    on = lambda a, b, k: F.when(k == F.col("pieces"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * k / F.col("pieces"))

    def span(n: str) -> Column:
        """Squares of a piece along an axis, a little more than it takes, so that rounding leaves none out."""
        ends, low = (on(f"a{n}", f"b{n}", F.col("k")), on(f"a{n}", f"b{n}", F.col("k") + 1)), F.col(f"{n}0")
        more = F.col("d") * 1e-6 + F.greatest(F.abs(ends[0]), F.abs(low)) * 1e-14
        return F.sequence(F.floor((F.least(*ends) - more - low) / F.col("d")), F.floor((F.greatest(*ends) + more - low) / F.col("d")))

    out = cut.withColumn("u", F.explode(span("x"))).withColumn("v", F.explode(span("y")))
    return out.select(key, "part", "ring", "i", "n", "ax", "ay", "bx", "by", "u", "v").distinct()


def _side(prefix: str) -> Column:
    at = lambda n: F.struct(F.col(f"{prefix}.{n}x").alias("x"), F.col(f"{prefix}.{n}y").alias("y"))
    return F.struct(at("a").alias("a"), at("b").alias("b"))


def meetings(found: DataFrame, key: str) -> DataFrame:
    """Pairs of sides of a shape that have a point in common which is not a common corner of neighbours: key, both sides' rings, and
    the point if they only touch there (null if they cross or lie on each other)."""
    placed = cut(_in_squares(sides(found, key), key))
    x, y = placed.alias("x"), placed.alias("y")
    order = lambda p: F.struct(F.col(f"{p}.part"), F.col(f"{p}.ring"), F.col(f"{p}.i"))
    met = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") == F.col("y.v")) & (order("x") < order("y")))
    s, t = _side("x"), _side("y")
    same = (F.col("x.part") == F.col("y.part")) & (F.col("x.ring") == F.col("y.ring"))
    following, closing = F.col("y.i") == F.col("x.i") + 1, (F.col("x.i") == 0) & (F.col("y.i") == F.col("y.n") - 1)
    beside = same & (following | closing)
    back = F.when(following, geometry.doubles_back(s, t)).otherwise(geometry.doubles_back(t, s))
    bad = met.where(F.when(beside, back).otherwise(geometry.meet(s, t)))
    ends = [(s, t["a"]), (s, t["b"]), (t, s["a"]), (t, s["b"])]
    on = [(geometry.turn(side["a"], side["b"], p) == 0) & geometry.within(side, p) for side, p in ends]
    # sides on one line have more than a point in common if ends of theirs that are apart lie on both
    points = F.array_distinct(F.filter(F.array(*[F.when(o, p) for o, (_, p) in zip(on, ends, strict=True)]), lambda p: p.isNotNull()))
    places = [F.col(f"{p}.{n}").alias(f"{n}_{k}") for k, p in ((1, "x"), (2, "y")) for n in ("part", "ring")]
    return bad.select(F.col(f"x.{key}").alias(key), *places, F.when(~beside & (F.size(points) == 1), F.get(points, F.lit(0))).alias("point")).distinct()


def inside(points: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Points (key, tag, x, y) with the rings of their shape that hold them: key, tag, part, ring. A point on a ring counts as within or not.

    Each point meets the sides of those rings whose box holds it.
    """
    edge = sides(of, key).select(key, "part", "ring", "ax", "ay", "bx", "by")
    box = edge.groupBy(key, "part", "ring").agg(
        F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1")
    )
    near = points.join(box, key).where("x between x0 and x1 and y between y0 and y1").drop("x0", "x1", "y0", "y1")
    met = near.join(edge, [key, "part", "ring"]).where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    return met.where(right).groupBy(key, "tag", "part", "ring").agg((F.count("*") % 2).alias("odd")).where("odd = 1").drop("odd")


def validity(shapes: DataFrame, key: str, shape: str) -> DataFrame:
    """key, valid, reason for each row; ``key`` tells the shapes apart, ``shape`` is one of :mod:`terrane.functions.wkb`.

    Polygons: see above. Lines are valid with two unlike points, points and collections if they are not empty. A null shape is not
    valid. Rings of a polygon may touch each other in one point; chains of more than two rings that close around a piece of
    the inside are not looked for.

    What several tests ask for (decoded shapes, rings, sides in squares, meetings, rings that hold others) is written to the checkpoint
    folder once; else each test would begin with the binary shapes again.
    """
    shapes = cut(shapes.select(key, shape))
    found = cut(rings(shapes, key, shape))
    closed = (F.size("points") >= 4) & (F.get("points", F.lit(0)) == F.get("points", F.size("points") - 1))
    faults = found.where(~closed | (geometry.area(F.col("points")) == 0)).select(key, F.lit("ring").alias("reason"))
    good = cut(found.join(faults.select(key).distinct(), key, "left_anti"))
    met = cut(meetings(good, key))
    own = (F.col("part_1") == F.col("part_2")) & (F.col("ring_1") == F.col("ring_2"))
    faults = faults.union(met.where(own).select(key, F.lit("self").alias("reason")))
    faults = faults.union(met.where(~own & F.col("point").isNull()).select(key, F.lit("rings cross").alias("reason")))
    # of one polygon, two rings that touch in two points cut off a piece of it
    twice = met.where(~own & (F.col("part_1") == F.col("part_2"))).groupBy(key, "part_1", "ring_1", "ring_2").agg(F.count_distinct("point").alias("points"))
    faults = faults.union(twice.where("points > 1").select(key, F.lit("rings touch twice").alias("reason")))
    # where rings do not cross, two of three points that are no corners tell on which side all of a ring lies
    some = good.select(key, F.struct("part", "ring").alias("tag"), F.explode(_corners_and_middles()).alias("p")).select(key, "tag", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    marked = some.withColumn("nth", F.row_number().over(_by_tag(key))).withColumn("tag", F.struct("tag.part", "tag.ring", "nth")).drop("nth")
    held = inside(marked, good, key).where((F.col("tag.part") != F.col("part")) | (F.col("tag.ring") != F.col("ring")))
    held = held.groupBy(key, F.col("tag.part").alias("p"), F.col("tag.ring").alias("r"), "part", "ring").agg(F.count("*").alias("n"))
    total = marked.groupBy(key, F.col("tag.part").alias("p"), F.col("tag.ring").alias("r")).agg(F.count("*").alias("of"))
    mostly = cut(held.join(total, [key, "p", "r"]).where(F.col("n") * 2 > F.col("of")))
    holes = good.where("ring > 0").select(key, F.col("part").alias("p"), F.col("ring").alias("r"))
    shell = mostly.where("p = part and ring = 0").select(key, "p", "r")
    faults = faults.union(holes.join(shell, [key, "p", "r"], "left_anti").select(key, F.lit("hole outside").alias("reason")))
    faults = faults.union(mostly.where("p = part and r > 0 and ring > 0").select(key, F.lit("holes nested").alias("reason")))
    # an outer ring within another's, but not within one of its holes
    within = mostly.where("r = 0 and p <> part").groupBy(key, "p", "part").agg(F.max(F.col("ring") == 0).alias("shell"), F.max(F.col("ring") > 0).alias("hole"))
    faults = faults.union(within.where("shell and not hole").select(key, F.lit("parts overlap").alias("reason")))
    kind, s = F.col(shape)["kind"], F.col(shape)
    polygon = kind.isin(wkb.POLYGON, wkb.MULTI_POLYGON)
    filled = F.when(polygon | kind.isin(wkb.POINT, wkb.MULTI_POINT), wkb.n_points(s) > 0).when(kind == wkb.COLLECTION, F.size(s["members"]) > 0)
    two = F.forall(s["parts"], lambda part: F.exists(part, lambda line: F.exists(line, lambda p: (p["x"] != F.get(line, F.lit(0))["x"]) | (p["y"] != F.get(line, F.lit(0))["y"]))))
    filled = filled.when(kind.isin(wkb.LINE, wkb.MULTI_LINE), two & (F.size(s["parts"]) > 0))
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    reasons = faults.groupBy(key).agg(F.min_by("reason", rank).alias("reason"))
    out = shapes.select(key, F.coalesce(filled, F.lit(False)).alias("filled")).join(reasons, key, "left")
    reason = F.when(~F.col("filled"), "empty").otherwise(F.col("reason"))
    return out.select(key, reason.isNull().alias("valid"), reason.alias("reason"))


def _corners_and_middles() -> Column:
    """Middles of three sides of a ring, spread over it, by which it is placed: touching points are corners or few."""
    n = F.size("points") - 1
    middle = lambda i: F.struct(
        ((F.get("points", i)["x"] + F.get("points", i + 1)["x"]) / 2).alias("x"), ((F.get("points", i)["y"] + F.get("points", i + 1)["y"]) / 2).alias("y")
    )
    return F.array(middle(F.lit(0)), middle((n / 3).cast("int")), middle((n * 2 / 3).cast("int")))


def _by_tag(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key, "tag").orderBy("x", "y")

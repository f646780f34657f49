"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import cut, in_few


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Each node that any edge (a, b) touches, and the least node that can be reached from it: columns node, root.

    Further columns of ``edges`` (a grid id, say) tell separate graphs apart and come back. Alternates the large-star and
    small-star steps until no edge changes; the number of rounds grows with the logarithm of the longest chain. Every
    round is a grouped minimum, which combines before the shuffle, and a join on the node, whose heavy keys Spark
    splits. Self loops and repeated edges are allowed; no edges give no rows.
    """
    keys = [c for c in edges.columns if c not in ("a", "b")]
    edges = cut(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(edges, keys)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        rows = 2 * mark[0]
        edges = cut(in_few(_small_star(in_few(_large_star(in_few(edges, rows), keys, rows), rows), keys, rows), rows))
        before, mark = mark, _mark(edges, keys)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(edges: DataFrame, keys: list[str]) -> tuple:
    """Tells two sets of edges apart: count and the sum of a hash of each row."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, keys: list[str], rows: int) -> DataFrame:
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("v")).select(*keys, "u", F.least("v", "u").alias("m"))
    joined = both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
    return in_few(joined, rows)  # an edge for each edge: repeated ones go in the other step


def _small_star(edges: DataFrame, keys: list[str], rows: int) -> DataFrame:
    least = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    joined = edges.join(least, [*keys, "a"]).where("b <> m")
    both = joined.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(*keys, "a", F.col("m").alias("b")))
    return in_few(both, rows).distinct()

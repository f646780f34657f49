"""Smoothing of a grid (stage 2): anisotropic diffusion, difference, change mask, statistics, report."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import predicates as P
from terrane.operators import diffusion
from terrane.plans.text import formatted, joined, wrapped
from terrane.session import cut
from terrane.sources.files import SMOOTHING_OUTPUTS, output_names

DIFFERENCE_NODATA = -9999.0
VERSION = "2"


@dataclass
class Parameters:
    iterations: int = 5
    strength: float = 0.20
    edge_threshold: float = 1.0
    resolution_scale: bool = True


#: Parts into which a round cuts what is left of the interval that holds a grid's middle values.
PARTS = 4096
#: Grids of so many are known in a round at most, so that they can be broadcast (some 60 bytes each).
MOST_GRIDS = 200_000


def elevation_statistics(cells: DataFrame, nodata: float | None) -> DataFrame:
    """Valid cells, their mean and exact median, a row for each grid.

    The median by selection, for all grids at once: a round counts the values of the interval that holds a grid's two middle
    ranks in :data:`PARTS` equal parts, and goes on within the part where the ranks are, from its least to its greatest value.
    If they are in two parts, they are the greatest value of one and the least of the next; if a part holds one
    value, they are that. So a task holds counts, never a grid's values, and two or three scans do for most grids.
    """
    keys = [c for c in ("grid_id",) if c in cells.columns]
    grid = F.col("grid_id") if keys else F.lit(0)
    valid = cells.where(P.is_valid(F.col("z"), nodata)).select(grid.alias("grid_id"), "z")
    per = valid.groupBy("grid_id").agg(F.count("*").alias("valid_cells"), F.avg("z").alias("mean_elevation"), F.min("z").alias("low"), F.max("z").alias("high"))
    # one, two: the middle ranks among the values of the interval from low to high
    per = cut(per.withColumn("one", F.floor((F.col("valid_cells") + 1) / 2)).withColumn("two", F.floor(F.col("valid_cells") / 2) + 1))
    found, left = per.where("low = high").select("grid_id", F.col("low").alias("m1"), F.col("low").alias("m2")), per.where("low < high")
    while grids := left.count():
        found, left = _narrowed(found, valid, left, grids)
    out = per.join(found, "grid_id").select("grid_id", "valid_cells", "mean_elevation", ((F.col("m1") + F.col("m2")) / 2).alias("median_elevation"))
    return out.select(*keys, "valid_cells", "mean_elevation", "median_elevation")


def _narrowed(found: DataFrame, valid: DataFrame, left: DataFrame, grids: int) -> tuple[DataFrame, DataFrame]:
    """One round: the grids whose middle values are found now, too, and the narrower intervals of the others."""
    bounds = left.select("grid_id", "low", "high")
    near = valid.join(F.broadcast(bounds) if grids <= MOST_GRIDS else bounds, "grid_id").where("z between low and high")
    # halves, as the whole width of an interval may be more than a number holds
    share = (F.col("z") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
    counted = near.groupBy("grid_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("z").alias("least"), F.max("z").alias("most"))
    so_far = Window.partitionBy("grid_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("last", F.sum("n").over(so_far)).withColumn("before", F.col("last") - F.col("n")).join(left.select("grid_id", "one", "two"), "grid_id")
    holds = lambda rank: (F.col("before") < F.col(rank)) & (F.col(rank) <= F.col("last"))
    at = placed.groupBy("grid_id").agg(
        *[F.max(F.when(holds(rank), F.struct("part", "before", "least", "most"))).alias(f"in_{rank}") for rank in ("one", "two")], F.first("one").alias("one"), F.first("two").alias("two")
    )
    apart = F.col("in_one.part") < F.col("in_two.part")
    done = cut(at.withColumn("done", apart | (F.col("in_one.least") == F.col("in_one.most"))))
    now = done.where("done").select("grid_id", F.col("in_one.most").alias("m1"), F.when(apart, F.col("in_two.least")).otherwise(F.col("in_one.most")).alias("m2"))
    rest = done.where("not done").select(
        "grid_id", F.col("in_one.least").alias("low"), F.col("in_one.most").alias("high"), (F.col("one") - F.col("in_one.before")).alias("one"), (F.col("two") - F.col("in_one.before")).alias("two")
    )
    return found.union(now), rest


def smooth(cells: DataFrame, p: Parameters, nodata: float | None, res_x: float, res_y: float, name: str = "", crs: str | None = None) -> dict[str, DataFrame]:
    """All results by name: smoothed (z, smoothed, diff, changed for each cell), difference, mask, statistics,
    provenance (one JSON text a grid), report (lines)."""
    P.check_smoothing(p.iterations, p.strength, p.edge_threshold)
    cells = cells if "grid_id" in cells.columns else cells.withColumn("grid_id", F.lit(name))
    if cells.where(P.is_valid(F.col("z"), nodata)).isEmpty():
        raise ValueError("the grid has no valid cell")
    factor = 1.0
    if p.resolution_scale:
        factor = cells.sparkSession.range(1).select(P.resolution_factor(F.lit(float(res_x)), F.lit(float(res_y)))).first()[0]
    out = diffusion.diffuse(cells, nodata, p.iterations, p.strength * factor, p.edge_threshold)
    changes = cut(diffusion.difference(out, nodata, P.change_tolerance(p.edge_threshold)))
    stats = cut(diffusion.change_statistics(changes).join(elevation_statistics(cells, nodata).drop("valid_cells"), "grid_id"))
    scaled = (lambda v: F.lit(v) if p.resolution_scale else F.lit(None).cast("double"))
    stats = stats.select(
        "*", scaled(res_x).alias("resolution_x"), scaled(res_y).alias("resolution_y"), scaled((res_x + res_y) / 2).alias("mean_resolution"),
        F.lit(factor).alias("resolution_scale_factor"), F.lit(p.strength * factor).alias("effective_diffusion"),
    )
    return {
        "smoothed": changes,
        "difference": changes.select("grid_id", "r", "c", F.when(F.col("changed") == 255, DIFFERENCE_NODATA).otherwise(F.col("diff")).cast("float").alias("diff")),
        "mask": changes.select("grid_id", "r", "c", "changed"),
        "statistics": stats,
        "provenance": stats.select("grid_id", _provenance(p, stats.columns, name, crs).alias("provenance")),
        "report": report(stats, p, name, crs),
    }


NO_CRS = "The grid has no coordinate system: cell sizes are taken as they are, in unknown units."


def names_of(name: str) -> dict[str, str]:
    """Names of the outputs by kind."""
    return output_names(name or "grid", SMOOTHING_OUTPUTS)


def _provenance(p: Parameters, columns: list[str], name: str, crs: str | None):
    warnings = F.array(F.lit(NO_CRS)) if crs is None else F.array().cast("array<string>")
    exact = {"changed_percentage": 6, "maximum_absolute_change": 6, "mean_absolute_change": 6, "minimum_change": 6, "maximum_change": 6}
    return F.to_json(
        F.struct(
            F.lit("terrane smoothing").alias("tool"), F.lit("smoothing").alias("algorithm_id"), F.lit(VERSION).alias("version"),
            F.lit(2).alias("stage"), F.current_timestamp().cast("string").alias("timestamp"), F.col("grid_id").alias("input"),
            F.struct(*[F.lit(v).alias(k) for k, v in dataclasses.asdict(p).items()]).alias("parameters"),
            F.struct(*[F.lit(v).alias(k) for k, v in names_of(name).items()]).alias("outputs"),
            F.struct(*[(F.bround(c, exact[c]).alias(c) if c in exact else F.col(c)) for c in columns if c != "grid_id"]).alias("statistics"),
            warnings.alias("warnings"),
        ),
        {"pretty": "true"},
    )


def report(stats: DataFrame, p: Parameters, name: str = "", crs: str | None = None) -> DataFrame:
    """The report's lines: grid_id, line_no, line."""
    nothing = F.array().cast("array<string>")
    meaning = (
        F.when(F.col("changed_cells") == 0, "No cell changed: the grid is even, or the edge threshold holds every step back.")
        .when(F.col("changed_percentage") < 50, "Fewer than half of the cells changed; flat areas were even already.")
        .otherwise("Most cells changed; compare the difference with the accuracy of the source.")
    )
    lines = F.concat(
        joined("SMOOTHING REPORT  ", F.col("grid_id")),
        F.array(F.lit("PARAMETERS"), *[F.lit(f"  {k}: {v}") for k, v in dataclasses.asdict(p).items()]),
        joined("RESULTS"),
        joined("  valid cells: ", formatted("%d", "valid_cells"), ", mean ", formatted("%.4f", "mean_elevation"), ", median ", formatted("%.4f", "median_elevation")),
        joined("  effective strength: ", formatted("%.6f", "effective_diffusion"), ", scale factor ", formatted("%.6f", "resolution_scale_factor")),
        joined("  changed: ", formatted("%d", "changed_cells"), " (", formatted("%.4f", "changed_percentage"), " % of valid cells)"),
        joined("  largest change: ", formatted("%.6f", "maximum_absolute_change"), ", mean ", formatted("%.6f", "mean_absolute_change")),
        joined("  range of change: ", formatted("%.6f", "minimum_change"), " to ", formatted("%.6f", "maximum_change")),
        F.array(F.lit("OUTPUTS"), *[F.lit(f"  {k}: {v}") for k, v in names_of(name).items()]),
        F.concat(joined("INTERPRETATION"), F.transform(wrapped(meaning), lambda x: F.concat(F.lit("  "), x))),
        F.concat(joined("WARNINGS"), wrapped(F.lit(NO_CRS))) if crs is None else nothing,
        F.array(F.lit("REFERENCES"), F.lit("  Perona and Malik (1990): scale-space and edge detection using anisotropic diffusion")),
    )
    return stats.select("grid_id", F.posexplode(lines).alias("line_no", "line"))

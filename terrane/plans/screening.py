"""Screening of a grid: stage 0 finds, classes and fills voids; stage 1 flags local outliers.

Everything is a lazy DataFrame; the reports are rows of text made of one row of statistics. The table of regions is a
result of its own; report and provenance list the first ``MOST_LISTED`` large regions of a grid and say how many there are.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import predicates as P
from terrane.operators import voids
from terrane.operators.tile_table import from_tiles
from terrane.plans.text import formatted, joined, wrapped
from terrane.session import cut
from terrane.sources.files import SCREENING_OUTPUTS, output_names

#: Large regions of a grid that report and provenance list; the table of regions has all.
MOST_LISTED = 100
VERSION = "2"


@dataclass
class Header:
    """What is known of a grid besides its cells."""

    width: int
    height: int
    nodata: float | None
    res_x: float = 1.0
    res_y: float = 1.0
    dtype: str = "float64"
    crs: str | None = None
    crs_is_geographic: bool = True
    name: str = ""
    left: float = 0.0
    top: float = 0.0


@dataclass
class Parameters:
    source_type: int = 0
    user_rmse: float = -1.0
    small_void: int = 10
    large_void: int = 100
    mad_window: int = 3
    mad_threshold: float = 3.0


@dataclass
class Stage0:
    screened: DataFrame
    summary: DataFrame
    regions: DataFrame


def stage0(cells: DataFrame, nodata: float | None, width: int, small: int = 10, large: int = 100, window: int | None = None, threshold: float = 3.0) -> Stage0:
    """Voids found, classed and filled. With a ``window`` the screened cells have their flag (artifact) too, of the same exchange."""
    parts = voids.region_parts(cells, nodata, width)
    table = voids.numbered_regions(voids.region_sizes(parts), small, large)
    if window:
        tiles = cut(voids.screened_tiles(cells, parts, nodata, small, large, window, threshold))
        screened = from_tiles(tiles, {"z": "data", "void_class": "void_class:short", "artifact": "artifact:short"})
    else:
        screened = voids.screened_cells(cells, parts, nodata, small, large)
    return Stage0(screened, voids.void_summary(cells, table, nodata), table)


def artifact_rate(artifacts: DataFrame) -> DataFrame:
    """A row for each grid: cells, flagged cells, their percentage of all cells (rounded, and as it is), the band."""
    keys = [c for c in ("grid_id",) if c in artifacts.columns]
    got = artifacts.groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if(F.col("artifact") == 1).alias("cells_flagged"))
    got = got.withColumn("pct", F.col("cells_flagged") / F.col("cells") * 100)
    got = got.withColumn("cells_flagged_pct", F.bround("pct", 4))
    return got.withColumn("band", P.artifact_band(F.col("cells_flagged_pct")))


def screen(cells: DataFrame, header: Header, p: Parameters) -> dict[str, DataFrame]:
    """All results by name: screened, artifacts, regions, summary, provenance (one JSON text a grid), report (lines)."""
    window = P.check_screening(p.small_void, p.large_void, p.mad_window, p.mad_threshold)
    spark = cells.sparkSession
    cells = cells if "grid_id" in cells.columns else cells.withColumn("grid_id", F.lit(header.name))
    found = stage0(cells, header.nodata, header.width, p.small_void, p.large_void, window, p.mad_threshold)
    artifacts = found.screened.select("grid_id", "r", "c", "artifact")
    rmse = P.with_rmse(spark.createDataFrame([(p.source_type, float(p.user_rmse))], "code int, user_rmse double"), P.source_types(spark)).drop("code")
    regions = cut(found.regions)
    nth = F.row_number().over(Window.partitionBy("grid_id").orderBy("region_id"))
    first = regions.where(F.col("void_class") == P.LARGE).withColumn("nth", nth).where(F.col("nth") <= MOST_LISTED)
    large = first.groupBy("grid_id").agg(
        F.sort_array(F.collect_list(F.struct("region_id", "size_cells", "row_min", "row_max", "col_min", "col_max"))).alias("large_void_regions")
    )
    stats = (
        found.summary.join(artifact_rate(artifacts), "grid_id").join(large, "grid_id", "left").join(F.broadcast(rmse), F.lit(True))
        .withColumn("source_label", F.lit(dict((c, x) for c, x, _ in P.SOURCE_TYPES)[p.source_type]))
        .withColumn("note", P.source_notes(F.lit(p.source_type)))
        .withColumn("steps", P.next_steps(F.col("large_regions"), F.lit(header.crs_is_geographic), F.col("pct")))
        .withColumn("warnings", _warnings(header))
    )
    stats = cut(stats)
    return {
        "screened": found.screened.drop("artifact"), "artifacts": artifacts, "regions": regions, "summary": stats,
        "provenance": stats.select("grid_id", _provenance(header, dataclasses.replace(p, mad_window=window)).alias("provenance")),
        "report": report(stats, header, p),
    }


def _warnings(header: Header):
    return F.array_compact(
        F.array(
            F.lit("no coordinate system: taken to be geographic") if header.crs is None else F.lit(None).cast("string"),
            F.lit("geographic coordinates: distances are not in metres") if header.crs is not None and header.crs_is_geographic else F.lit(None).cast("string"),
            F.when(F.col("pct") > 5.0, "many cells are flagged").when(F.col("pct") > 1.0, "some cells are flagged"),
        )
    )


def names_of(header: Header) -> dict[str, str]:
    """Names of the outputs by kind."""
    return output_names(header.name or "grid", SCREENING_OUTPUTS)


def _provenance(header: Header, p: Parameters):
    return F.to_json(
        F.struct(
            F.lit("terrane screening").alias("tool"), F.lit("screening").alias("algorithm_id"), F.lit(VERSION).alias("version"),
            F.lit("0 and 1").alias("stages"), F.col("grid_id").alias("input"),
            F.struct(*[F.lit(v).alias(k) for k, v in names_of(header).items()]).alias("outputs"), F.current_timestamp().cast("string").alias("timestamp"),
            F.struct(*[F.lit(v).alias(k) for k, v in dataclasses.asdict(p).items()]).alias("parameters"),
            F.struct(
                F.lit(header.crs).alias("crs"), F.lit(header.crs_is_geographic).alias("crs_is_geographic"),
                F.lit(header.res_x).alias("resolution_x"), F.lit(header.res_y).alias("resolution_y"), F.lit(header.width).alias("width"),
                F.lit(header.height).alias("height"), F.lit(str(header.nodata)).alias("nodata"), F.lit(header.dtype).alias("dtype"),
                F.col("rmse").alias("vertical_accuracy_rmse"), F.col("rmse_source").alias("vertical_accuracy_source"),
                F.struct(
                    "total_void_cells", F.bround("void_pct", 4).alias("void_pct"), F.col("small_cells").alias("small_interpolated"),
                    F.col("medium_cells").alias("medium_flagged"), F.col("large_cells").alias("large_reported"), "large_regions", "large_void_regions",
                ).alias("void_summary"),
            ).alias("stage_0"),
            F.struct(
                F.col("source_label").alias("source_type"), F.col("note").alias("source_note"),
                F.struct(
                    F.lit(p.mad_window).alias("window_size"), F.lit(p.mad_threshold).alias("threshold_sigma"), "cells_flagged", "cells_flagged_pct"
                ).alias("mad_filter"),
            ).alias("stage_1"),
            "warnings", F.array().cast("array<string>").alias("errors"),
        ),
        {"pretty": "true"},
    )


_MEANING = {
    "none": "No cell stands out from its surroundings.", "very_low": "Very few cells stand out; most are noise.",
    "low": "Few cells stand out; look at them where they lie together.", "moderate": "A fair number of cells stand out; review them before going on.",
    "high": "Many cells stand out; the source may be of a kind that the settings do not fit.",
}


def report(stats: DataFrame, header: Header, p: Parameters) -> DataFrame:
    """The report's lines: grid_id, line_no, line."""
    region = lambda x: F.format_string(
        "  region %d: %d cells, rows %d to %d, columns %d to %d", x["region_id"], x["size_cells"], x["row_min"], x["row_max"], x["col_min"], x["col_max"]
    )
    nothing = F.array().cast("array<string>")
    meaning = F.coalesce(*[F.when(F.col("band") == k, F.lit(v)) for k, v in _MEANING.items()])
    more = F.col("large_regions") - MOST_LISTED
    lines = F.concat(
        joined("SCREENING REPORT  ", F.col("grid_id")),
        F.array(F.lit("PARAMETERS"), *[F.lit(f"  {k}: {v}") for k, v in dataclasses.asdict(p).items()]),
        joined("STAGE 0: DATA AND VOIDS"),
        joined("  cells: ", formatted("%d", "total_cells"), f", size {header.width} x {header.height}, nodata {header.nodata}"),
        joined("  vertical accuracy (RMSE): ", formatted("%.2f", "rmse"), " m, from ", F.col("rmse_source")),
        joined("VOID SUMMARY"),
        joined("  void cells: ", formatted("%d", "total_void_cells"), " (", formatted("%.4f", "void_pct"), " %) in ", formatted("%d", "regions"), " regions"),
        joined("  in small regions, filled where possible: ", formatted("%d", "small_cells")),
        joined("  in medium regions, flagged: ", formatted("%d", "medium_cells")),
        joined("  in large regions, reported: ", formatted("%d", "large_cells")),
        F.when(F.col("large_regions") > 0, joined("LARGE REGIONS: ", formatted("%d", "large_regions"))).otherwise(nothing),
        F.coalesce(F.transform("large_void_regions", region), nothing),
        F.when(more > 0, joined("  and ", more, " more in the table of regions")).otherwise(nothing),
        joined("STAGE 1: ARTIFACTS"),
        joined("  source: ", F.col("source_label"), ", note: ", F.col("note")),
        joined("  flagged: ", formatted("%d", "cells_flagged"), " (", formatted("%.4f", "cells_flagged_pct"), " % of all cells), rate: ", F.col("band")),
        F.transform(wrapped(meaning), lambda x: F.concat(F.lit("  "), x)),
        F.when(F.size("warnings") > 0, F.concat(joined("WARNINGS"), F.flatten(F.transform("warnings", wrapped)))).otherwise(nothing),
        joined("ERRORS: none"),
        F.array(F.lit("OUTPUTS"), *[F.lit(f"  {k}: {v}") for k, v in names_of(header).items()]),
        F.array(F.lit("VOID MASK: 0 data, 1 small, 2 medium, 3 large"), F.lit("ARTIFACT MASK: 0 no, 1 flagged")),
        F.concat(joined("NEXT STEPS"), F.transform("steps", lambda x: F.concat(F.lit("  "), x))),
        F.array(F.lit("REFERENCES"), F.lit("  Hampel (1974): the influence curve and its role in robust estimation")),
    )
    return stats.select("grid_id", F.posexplode(lines).alias("line_no", "line"))

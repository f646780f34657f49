"""Writing the results of a tool for one grid: rasters with their types and nodata values, provenance, report, views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.registry import tagged
from terrane.plans.screening import Header
from terrane.sources import files, geotiff

MASK_NODATA = 255.0
DIFFERENCE_NODATA = -9999.0


@dataclass
class Raster:
    """Where an output's cells are among the results, and how they are stored. nodata None: that of the input."""

    result: str
    column: str
    dtype: str
    nodata: float | None


#: By kind of output. Void and artifact masks have a value for every cell, so their nodata is never written.
SCREENING = {
    "screened": Raster("screened", "z", "float64", None), "void_mask": Raster("screened", "void_class", "uint8", MASK_NODATA),
    "artifacts": Raster("artifacts", "artifact", "uint8", MASK_NODATA),
}
SMOOTHING = {
    "smoothed": Raster("smoothed", "smoothed", "float32", None), "difference": Raster("difference", "diff", "float32", DIFFERENCE_NODATA),
    "mask": Raster("mask", "changed", "uint8", MASK_NODATA),
}
TOOLS = {"screening": (SCREENING, files.SCREENING_OUTPUTS), "smoothing": (SMOOTHING, files.SMOOTHING_OUTPUTS)}


def recoded(results: dict[str, DataFrame], kind: str, tool: str) -> DataFrame:
    """The cells of one raster as they are stored: r, c, value."""
    raster = TOOLS[tool][0][kind]
    store = {"uint8": "short", "float32": "float", "float64": "double"}[raster.dtype]
    return results[raster.result].select("r", "c", F.col(raster.column).cast(store).alias("value"))


def write_outputs(results: dict[str, DataFrame], tool: str, folder: str, header: Header, compression: int = geotiff.LZW) -> dict[str, str]:
    """Write all outputs of ``tool`` ("screening" or "smoothing") for the grid that ``header`` tells of; paths by kind.

    ``folder`` must be one that all executors share. Each raster is a folder of tiles (256 by 256, LZW); report and provenance are
    folders with a text file. Results become views too, but for those that ``load.<kind>`` switches off. All jobs carry the
    tool's tag.
    """
    rasters, ends = TOOLS[tool]
    names = files.output_names(header.name or "grid", ends)
    paths = {kind: f"{folder}/{name}" for kind, name in names.items()}
    epsg = int(header.crs.partition(":")[2]) if header.crs and header.crs.upper().startswith("EPSG:") else None
    spark = next(iter(results.values())).sparkSession
    with tagged(spark, f"hydrology:{tool}"):
        for kind, raster in rasters.items():
            geotiff.write_tiles(
                recoded(results, kind, tool), paths[kind], names[kind], "value", raster.dtype, header.nodata if raster.nodata is None else raster.nodata,
                res=(header.res_x, header.res_y), origin=(header.left, header.top), epsg=epsg, geographic=header.crs_is_geographic, compression=compression,
            )
        lines = results["report"].orderBy("grid_id", "line_no").select("line")
        lines.coalesce(1).write.mode("overwrite").text(paths["report"])
        results["provenance"].select("provenance").coalesce(1).write.mode("overwrite").text(paths["provenance"])
        stem = "".join(x if x.isalnum() else "_" for x in files.output_names(header.name or "grid", {"stem": ""})["stem"])
        files.load_views({kind: recoded(results, kind, tool) for kind in rasters} | {k: results[k] for k in ("report", "provenance")}, stem)
    return paths

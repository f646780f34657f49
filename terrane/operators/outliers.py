"""Local outliers by median absolute deviation (MAD).

A cell is flagged if abs(z - median) / MAD is above the threshold, both taken over the valid cells of the window around
it (itself included), with three valid cells at least and a MAD of 1e-10 at least. The MAD is not scaled. Void cells
are no part of any window and are never flagged; the voids are those of the unfilled grid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.predicates import is_void, void_array
from terrane.operators.tile_table import TILE, map_cells, map_tiles
from terrane.operators.tiles import halo_map

LEAST_MAD = 1e-10
LEAST_CELLS = 3


def _middle(stack: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median along the first axis of the n values that are numbers; NaN where there are none."""
    ordered = np.sort(stack, axis=0)  # NaN comes last
    low = np.take_along_axis(ordered, np.maximum((n - 1) // 2, 0)[None], axis=0)[0]
    high = np.take_along_axis(ordered, (n // 2)[None], axis=0)[0]
    return np.where(n > 0, np.where(n % 2 == 1, high, (low + high) * 0.5), np.nan)


def _windows(values: np.ndarray, flags: np.ndarray, window: int):
    """First row, centre values, number of values, median and MAD of the windows of a few rows at a time."""
    half = window // 2
    z = np.where(flags == 2, values, np.nan)
    views = np.lib.stride_tricks.sliding_window_view(z, (window, window))
    rows = max(1, (1 << 20) // max(1, views.shape[1] * window * window))
    with np.errstate(invalid="ignore", divide="ignore"):
        for at in range(0, views.shape[0], rows):
            part = views[at : at + rows]
            stack = part.reshape(*part.shape[:2], -1).transpose(2, 0, 1)
            n = (~np.isnan(stack)).sum(axis=0)
            median = _middle(stack, n)
            spread = np.abs(stack - median)
            # infinite values can make a deviation that is no number: then there is no MAD
            mad = np.where((~np.isnan(spread)).sum(axis=0) == n, _middle(spread, n), np.nan)
            yield at, part[:, :, half, half], n, median, mad


def outlier_flags(nodata: float | None, window: int, threshold: float):
    """A kernel that flags the outliers of a tile."""

    def kernel(values: np.ndarray, there: np.ndarray, halo: int) -> list[np.ndarray]:
        out = np.zeros((values.shape[0] - 2 * halo, values.shape[1] - 2 * halo), np.int16)
        for at, centre, n, median, mad in _windows(values, np.where(there & ~void_array(values, nodata), 2, 1), window):
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.abs(centre - median) / mad
                out[at : at + len(n)] = (n >= LEAST_CELLS) & (mad >= LEAST_MAD) & (score > threshold)
        return [out]

    return kernel


def _statistics(window: int):
    def kernel(values: np.ndarray, flags: np.ndarray, halo: int) -> list[np.ndarray]:
        out = [np.zeros((values.shape[0] - 2 * halo, values.shape[1] - 2 * halo)) for _ in range(3)]
        for at, _, *found in _windows(values, flags, window):
            for whole, part in zip(out, found, strict=True):
                whole[at : at + len(part)] = part
        return out

    return kernel


def flag_outliers(cells: DataFrame, nodata: float | None, window: int = 3, threshold: float = 3.0, tile: int = TILE) -> DataFrame:
    """The keys of every cell with artifact = 1 if it is flagged, else 0. ``window`` is odd. One shuffle of packed cells."""
    return map_cells(cells, outlier_flags(nodata, window, threshold), window // 2, {"artifact": "short"}, tile)


def flag_tiles(tiles: DataFrame, nodata: float | None, window: int = 3, threshold: float = 3.0, tile: int = TILE) -> DataFrame:
    """The same over a table of tiles: the tiles with a column artifact (16-bit integers)."""
    return map_tiles(tiles, outlier_flags(nodata, window, threshold), window // 2, {"artifact": "short"}, tile)


def window_values(cells: DataFrame, nodata: float | None, window: int = 3) -> DataFrame:
    """For each cell, the sorted values of the valid cells around it, for statistics in SQL: r, c, vals.

    Every valid cell is sent to all cells whose window holds it; use :func:`local_statistics` for large grids and windows.
    """
    half = window // 2
    keys = [c for c in ("grid_id",) if c in cells.columns]
    steps = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-half, half + 1) for j in range(-half, half + 1)])
    sent = cells.where(~is_void(F.col("z"), nodata) & ~F.isnan("z")).withColumn("step", F.explode(steps))
    sent = sent.select(*keys, (F.col("r") + F.col("step.dr")).alias("r"), (F.col("c") + F.col("step.dc")).alias("c"), "z")
    return sent.groupBy(*keys, "r", "c").agg(F.array_sort(F.collect_list("z")).alias("vals"))


def local_statistics(cells: DataFrame, nodata: float | None, window: int = 3, tile: int = TILE) -> DataFrame:
    """Median and MAD around each cell with data: r, c, z, n, med, mad. ``window`` is odd."""
    keys = [c for c in ("grid_id", "r", "c") if c in cells.columns]
    marked = cells.withColumn("__flag", F.when(is_void(F.col("z"), nodata), 1).otherwise(2)).withColumn("__void", F.col("__flag") == 1)
    out = halo_map(marked, _statistics(window), window // 2, tile, "__flag", ["n", "med", "mad"], ("z", "__void"))
    return out.where("not __void and n > 0").select(*keys, "z", F.col("n").cast("long").alias("n"), "med", F.nanvl("mad", F.lit(None)).alias("mad"))


def _median(values):
    n = F.size(values)
    return (F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))) / 2


def local_statistics_by_rows(cells: DataFrame, nodata: float | None, window: int = 3) -> DataFrame:
    """The same as :func:`local_statistics` in SQL, every cell being sent to all cells around it: for tests and small grids."""
    keys = [c for c in ("grid_id", "r", "c") if c in cells.columns]
    data = cells.where(~is_void(F.col("z"), nodata)).join(window_values(cells, nodata, window), keys)
    data = data.withColumn("med", _median(F.col("vals")))
    spread = F.array_sort(F.transform("vals", lambda x: F.abs(x - F.col("med"))))
    return data.select(*keys, "z", F.size("vals").cast("long").alias("n"), "med", _median(spread).alias("mad"))

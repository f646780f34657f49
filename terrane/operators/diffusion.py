"""Edge-preserving smoothing: explicit anisotropic diffusion on the valid cells of a grid.

In each step a cell moves by strength times the sum over its north, south, west and east neighbours of g * exp(-(g/k)^2), g being
the neighbour minus the cell. All neighbours are those of the step before; neighbours outside of the grid or without data
add nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.predicates import is_valid, valid_array
from terrane.operators.tile_table import TILE, from_tiles, laid_out, map_cells, map_tiles, to_tiles
from terrane.operators.tiles import halo_map

#: Steps that one shuffle serves: the halo is as wide as there are steps.
STEPS_AT_ONCE = 16


def diffusion_steps(n: int, strength: float, k: float, nodata: float | None, begun: bool = False):
    """A kernel of ``n`` steps. ``begun``: values are of an earlier round, in which cells that are not worked on became NaN."""
    k = max(k, 1e-12)

    def kernel(values: np.ndarray, there: np.ndarray, halo: int) -> list[np.ndarray]:
        x = values if begun else np.where(valid_array(values, nodata), values, np.nan)
        padded = np.pad(x, 1, constant_values=np.nan)
        core = padded[1:-1, 1:-1]
        sides = padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]
        with np.errstate(invalid="ignore", over="ignore"):
            for _ in range(n):
                total = None
                for side in sides:
                    g = side - core
                    flow = np.exp(-((np.abs(g) / k) ** 2)) * g
                    flow[np.isnan(flow)] = 0.0
                    total = flow if total is None else total + flow
                core[...] = core + strength * total
        inner = slice(halo, core.shape[0] - halo), slice(halo, core.shape[1] - halo)
        return [core[inner], values[inner]]

    return kernel


def _smoothed(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*keys, "z", F.coalesce(F.nanvl("x", F.lit(None)), "z").alias("smoothed"))


def diffuse(cells: DataFrame, nodata: float | None, steps: int = 5, strength: float = 0.2, k: float = 1.0, tile: int = TILE) -> DataFrame:
    """Every cell with its value z and its value after ``steps`` steps, smoothed (z where there is no valid value)."""
    keys = [c for c in ("grid_id", "r", "c") if c in cells.columns]
    if steps <= min(STEPS_AT_ONCE, tile):
        return _smoothed(map_cells(cells, diffusion_steps(steps, strength, k, nodata), steps, {"x": "double", "z": "double"}, tile), keys)
    return _smoothed(from_tiles(diffuse_tiles(to_tiles(cells, tile), nodata, steps, strength, k, tile), {"z": "data", "x": "x"}), keys)


def diffuse_tiles(tiles: DataFrame, nodata: float | None, steps: int = 5, strength: float = 0.2, k: float = 1.0, tile: int = TILE) -> DataFrame:
    """The same over a table of tiles: the tiles with a column x, the value after the steps, NaN where there is no valid value.

    A round of :data:`STEPS_AT_ONCE` steps exchanges strips only; between rounds the tiles are laid out anew.
    """
    now, left, begun = tiles, steps, False
    while left:
        n = min(left, STEPS_AT_ONCE, tile)
        left -= n
        out = map_tiles(now, diffusion_steps(n, strength, k, nodata, begun), n, {"x": "double", "z": "double"}, tile, ("first",) if begun else ())
        kept = [c for c in out.columns if c not in ("data", "x", "z", "first")]
        first = F.col("first" if begun else "data")
        if left:
            now, begun = laid_out(out.select(*kept, F.col("x").alias("data"), first.alias("first"))), True
    return out.select(*kept, first.alias("data"), "x")


def _sides(values: np.ndarray, flags: np.ndarray, halo: int) -> list[np.ndarray]:
    return [values[:-2, 1:-1], values[2:, 1:-1], values[1:-1, :-2], values[1:-1, 2:]]


def neighbours(cells: DataFrame, column: str = "x", tile: int = TILE) -> DataFrame:
    """A grid with the values to the north, south, west and east of each cell: columns n, s, w, e; null where there is none."""
    keys = [c for c in ("grid_id", "r", "c") if c in cells.columns]
    others = tuple(c for c in cells.columns if c not in keys)
    sent = cells if column == "z" else cells.withColumn("z", F.col(column)) if "z" not in cells.columns else cells.withColumnRenamed("z", "z__").withColumn("z", F.col(column))
    names = {c: "z__" if c == "z" and column != "z" else c for c in others}
    out = halo_map(sent, _sides, 1, tile, "1", ["n", "s", "w", "e"], tuple(names.values()))
    return out.select(*keys, *[F.col(names[c]).alias(c) for c in others], *[F.nanvl(x, F.lit(None)).alias(x) for x in ("n", "s", "w", "e")])


def neighbours_by_windows(cells: DataFrame, column: str = "x") -> DataFrame:
    """The same as :func:`neighbours` on a dense grid in SQL windows over whole rows and columns, for tests."""
    keys = [c for c in ("grid_id",) if c in cells.columns]
    down, across = Window.partitionBy(*keys, "c").orderBy("r"), Window.partitionBy(*keys, "r").orderBy("c")
    return cells.select(
        "*", F.lag(column).over(down).alias("n"), F.lead(column).over(down).alias("s"),
        F.lag(column).over(across).alias("w"), F.lead(column).over(across).alias("e"),
    )


def diffuse_by_windows(cells: DataFrame, nodata: float | None, steps: int = 1, strength: float = 0.2, k: float = 1.0) -> DataFrame:
    """The same as :func:`diffuse` on a dense grid in SQL windows, for tests."""
    keys = [c for c in ("grid_id", "r", "c") if c in cells.columns]
    now = cells.select(*keys, "z", F.when(is_valid(F.col("z"), nodata), F.col("z")).alias("x"))
    for _ in range(steps):
        near = neighbours_by_windows(now)
        flows = []
        for side in ("n", "s", "w", "e"):
            g = F.col(side) - F.col("x")
            flows.append(F.coalesce(F.exp(-F.pow(F.abs(g) / max(k, 1e-12), F.lit(2.0))) * g, F.lit(0.0)))
        now = near.select(*keys, "z", (F.col("x") + strength * (flows[0] + flows[1] + flows[2] + flows[3])).alias("x"))
    return now.select(*keys, "z", F.coalesce("x", "z").alias("smoothed"))


def difference(smoothed: DataFrame, nodata: float | None, tolerance: float) -> DataFrame:
    """diff (smoothed - z on valid cells, else 0), changed (1, 0, or 255 without data) of each cell."""
    valid = is_valid(F.col("z"), nodata)
    out = smoothed.withColumn("diff", F.when(valid, F.col("smoothed") - F.col("z")).otherwise(0.0))
    return out.withColumn("changed", F.when(~valid, 255).when(F.abs("diff") > tolerance, 1).otherwise(0).cast("short"))


def change_statistics(changes: DataFrame) -> DataFrame:
    """A row for each grid over its valid cells, from the result of :func:`difference`."""
    keys = [c for c in ("grid_id",) if c in changes.columns]
    ok = F.col("changed") != 255
    d = F.when(ok, F.col("diff"))
    return changes.groupBy(*keys).agg(
        F.count_if(ok).alias("valid_cells"), F.count_if(F.col("changed") == 1).alias("changed_cells"),
        F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("maximum_absolute_change"), F.coalesce(F.avg(F.abs(d)), F.lit(0.0)).alias("mean_absolute_change"),
        F.coalesce(F.min(d), F.lit(0.0)).alias("minimum_change"), F.coalesce(F.max(d), F.lit(0.0)).alias("maximum_change"),
    ).withColumn(
        "changed_percentage", F.coalesce(F.try_divide(F.col("changed_cells") * 100.0, F.col("valid_cells")), F.lit(0.0))
    )

"""Operators as table functions of SQL, for callers without the DataFrame interface.

    SELECT * FROM local_outliers(TABLE(cells) PARTITION BY tile, nodata => -9999D, window_size => 3, threshold => 3D)

:func:`register` makes them known to a session. What a kernel needs around its cells has to be in its partition, so the table is the view
that :func:`with_halo` makes of a table of cells: each cell once for every tile whose halo holds it. The functions take any
table with the columns r, c, z, tr and tc, whole numbers of any size and z any number; grid_id, if there is one, comes back as it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, ShortType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from terrane.operators.diffusion import diffusion_steps
from terrane.operators.outliers import outlier_flags
from terrane.operators.tiles import spread

TILE = 256
_NEEDED = ("r", "c", "z", "tr", "tc")


def with_halo(cells: DataFrame, halo: int, size: int = TILE) -> DataFrame:
    """Each cell with the tiles (tr, tc, and tile, their key with the grid's name) whose area, widened by the halo, holds it."""
    placed = cells.withColumn("tr", F.explode(spread(F.col("r"), halo, size))).withColumn("tc", F.explode(spread(F.col("c"), halo, size)))
    grid = [F.col("grid_id").cast("string")] if "grid_id" in cells.columns else []
    return placed.withColumn("tile", F.concat_ws("/", "tr", "tc", *grid))


def _analysed(table: AnalyzeArgument, name: str, kind) -> AnalyzeResult:
    """The columns of the result: those of the table that name a cell, z, and the function's own."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    columns = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in _NEEDED if c not in columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    grid = [StructField("grid_id", columns["grid_id"])] if "grid_id" in columns else []
    return AnalyzeResult(StructType([*grid, StructField("r", LongType()), StructField("c", LongType()), StructField("z", DoubleType()), StructField(name, kind)]))


class _OnTiles:
    """Gathers the cells of a partition, which is a tile with its halo, and runs a kernel at its end."""

    def _start(self, size: int) -> None:
        self.size, self.rows, self.grid = size, [], None

    def _add(self, row) -> None:
        if self.grid is None:
            self.grid = ("grid_id" in row, row["grid_id"] if "grid_id" in row else None, row["tr"], row["tc"])
        self.rows.append((row["r"], row["c"], float("nan") if row["z"] is None else row["z"]))

    def _run(self, kernel, halo: int):
        if not self.rows:
            return
        has_grid, grid, tr, tc = self.grid
        cells = np.array(self.rows, np.float64)
        r, c = cells[:, 0].astype(np.int64) - tr * self.size, cells[:, 1].astype(np.int64) - tc * self.size
        # cells of the halo lie from -halo on
        values = np.full((min(int(r.max()) + 1, self.size) + 2 * halo, min(int(c.max()) + 1, self.size) + 2 * halo), np.nan)
        there = np.zeros(values.shape, bool)
        values[r + halo, c + halo], there[r + halo, c + halo] = cells[:, 2], True
        out = kernel(values, there, halo)[0]
        for y, x, z in zip(r.tolist(), c.tolist(), cells[:, 2].tolist(), strict=True):
            if 0 <= y < self.size and 0 <= x < self.size:
                yield (*([grid] if has_grid else []), y + tr * self.size, x + tc * self.size, z, out[y, x].item())


class LocalOutliers(_OnTiles):
    """local_outliers(TABLE, nodata, window_size, threshold, size): artifact, 1 for each outlier."""

    @staticmethod
    def analyze(table: AnalyzeArgument, **_: AnalyzeArgument) -> AnalyzeResult:
        return _analysed(table, "artifact", ShortType())

    def eval(self, row, nodata=None, window_size=3, threshold=3.0, size=TILE):
        if not hasattr(self, "rows"):
            self._start(size)
            self.kernel, self.halo = outlier_flags(None if nodata is None else float(nodata), window_size, float(threshold)), window_size // 2
        self._add(row)

    def terminate(self):
        if hasattr(self, "rows"):
            yield from self._run(self.kernel, self.halo)


class Diffusion(_OnTiles):
    """diffusion(TABLE, nodata, steps, strength, k, size): smoothed, the value after the steps (z where there is no valid value)."""

    @staticmethod
    def analyze(table: AnalyzeArgument, **_: AnalyzeArgument) -> AnalyzeResult:
        return _analysed(table, "smoothed", DoubleType())

    def eval(self, row, nodata=None, steps=5, strength=0.2, k=1.0, size=TILE):
        if not hasattr(self, "rows"):
            self._start(size)
            step = diffusion_steps(steps, float(strength), float(k), None if nodata is None else float(nodata))
            self.kernel, self.halo = (lambda v, t, h: [np.where(np.isnan(x := step(v, t, h)[0]), v[h : v.shape[0] - h, h : v.shape[1] - h], x)]), steps
        self._add(row)

    def terminate(self):
        if hasattr(self, "rows"):
            yield from self._run(self.kernel, self.halo)


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session."""
    for name, cls in (("local_outliers", LocalOutliers), ("diffusion", Diffusion)):
        spark.udtf.register(name, F.udtf(cls))

"""Void cells: connected regions, their classes, and the filling of small ones.

Grids are cells (r, c, z and perhaps grid_id). Regions are joined along rows and columns (four neighbours). The grid is cut into tiles of
bounded size; each tile joins its own void cells in one task and gives a row for each part of a region that lies in it:
its size and bounds, which can be added up, the cells by which it touches the tile's borders, and all its cells, packed. Parts that touch no border
are regions. The others meet by an equality on the cells beside a border; the components of that small graph
are found by repeated grouped minima, and only these parts are added up by their region. Cells get the class of their part back in the
tile, so runs of cells are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.predicates import LARGE, MEDIUM, SMALL, is_void, void_array, void_class
from terrane.operators.graph import connected_components
from terrane.operators.outliers import outlier_flags
from terrane.operators.tile_table import TILE, marked_cells, marked_tiles, ranges
from terrane.session import cut


def _grid(df: DataFrame) -> DataFrame:
    return df.withColumn("grid_id", F.coalesce(F.col("grid_id").cast("string"), F.lit("")) if "grid_id" in df.columns else F.lit(""))


def void_runs(cells: DataFrame, nodata: float | None) -> DataFrame:
    """Maximal runs of void cells in a row: grid_id, r, c0, c1."""
    voids = _grid(cells).where(is_void(F.col("z"), nodata)).select("grid_id", "r", "c")
    row = Window.partitionBy("grid_id", "r").orderBy("c")
    return voids.withColumn("run", F.col("c") - F.row_number().over(row)).groupBy("grid_id", "r", "run").agg(
        F.min("c").alias("c0"), F.max("c").alias("c1")
    ).drop("run")


def _joined(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """The least run (by place) that each run is connected with. Runs are in order of r and c0."""
    wide = int(c1.max()) + 2
    # runs of the next row that overlap: from the first that ends at c0 or later to the last that begins at c1 or before
    low = np.searchsorted(r * wide + c1, (r + 1) * wide + c0)
    high = np.searchsorted(r * wide + c0, (r + 1) * wide + c1, "right")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(r)), count)
    b = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    label = np.arange(len(r))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


_SIDES = ("top", "bottom", "left", "right")
_PARTS = (
    "grid_id string, tr long, tc long, node long, size_cells long, row_min long, row_max long, col_min long, col_max long, "
    "top array<long>, bottom array<long>, left array<long>, right array<long>, starts binary, counts binary"
)


def _tile_parts(width: int, size: int):
    def of(key, table):
        tr, tc = key[1].as_py(), key[2].as_py()
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        if c.max() >= width or c.min() < 0:
            raise ValueError(f"a grid of {width} columns has no cell in column {c.max() if c.max() >= width else c.min()}")
        by = np.lexsort((c, r))
        r, c = r[by], c[by]
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (c[1:] > c[:-1] + 1)))
        r, c0, c1 = r[first], c[first], c[np.append(first[1:], len(c)) - 1]
        label = _joined(r, c0, c1)
        heads, part = np.unique(label, return_inverse=True)
        order = np.argsort(part, kind="stable")
        r, c0, c1, part = r[order], c0[order], c1[order], part[order]
        begin = np.searchsorted(part, np.arange(len(heads)))
        rows_of, cells_of = (lambda x, how: how.reduceat(x, begin)), c1 - c0 + 1
        columns = {
            "grid_id": [key[0].as_py()] * len(heads), "tr": [tr] * len(heads), "tc": [tc] * len(heads),
            "node": r[begin] * width + c0[begin], "size_cells": rows_of(cells_of, np.add), "row_min": rows_of(r, np.minimum), "row_max": rows_of(r, np.maximum),
            "col_min": rows_of(c0, np.minimum), "col_max": rows_of(c1, np.maximum),
        }
        lies = {"top": r == tr * size, "bottom": r == tr * size + size - 1, "left": c0 == tc * size, "right": c1 == tc * size + size - 1}
        for side in _SIDES:
            at = np.flatnonzero(lies[side])
            values = ranges(c0[at], cells_of[at]) if side in ("top", "bottom") else r[at]
            owner = np.repeat(part[at], cells_of[at]) if side in ("top", "bottom") else part[at]
            offsets = np.searchsorted(owner, np.arange(len(heads) + 1)).astype(np.int32)
            columns[side] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
        places, ends = ((r - tr * size) * size + c0 - tc * size).astype("<i4"), [*begin.tolist()[1:], len(r)]
        for name, x in (("starts", places), ("counts", cells_of.astype("<i4"))):
            columns[name] = [x[i:j].tobytes() for i, j in zip(begin.tolist(), ends, strict=True)]
        return pa.table(columns)

    return of


def region_parts(cells: DataFrame, nodata: float | None, width: int, tile: int = TILE) -> DataFrame:
    """A row for each part of a void region that lies in one tile; ``width``: columns of the widest grid.

    ``node`` is the part's first cell, as r * width + c; ``root`` the least of its region's, so regions are in the order of their first
    cells. A cell beyond the width stops the job: its number would be that of another cell. top, bottom, left and right: columns
    or rows of the cells at the tile's borders. starts, counts: runs of the part's cells within the tile, row by row.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    voids = _grid(cells).where(is_void(F.col("z"), nodata)).select("grid_id", long("r"), long("c"))
    parts = voids.groupBy("grid_id", F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc")).applyInArrow(_tile_parts(width, tile), _PARTS)
    parts = cut(parts.withColumn("inner", F.size(F.concat(*_SIDES)) == 0))

    def beside(one: str, other: str, line: str, step: F.Column) -> DataFrame:
        """Edges between parts of neighbouring tiles whose cells lie beside each other."""
        a = parts.select("grid_id", F.col("node").alias("b"), (F.col(line) + 1).alias("line"), step.alias("step"), F.explode(one).alias("at"))
        b = parts.select("grid_id", F.col("node").alias("a"), F.col(line).alias("line"), step.alias("step"), F.explode(other).alias("at"))
        return a.join(b, ["grid_id", "line", "step", "at"]).select("grid_id", "a", "b")

    edges = beside("bottom", "top", "tr", F.col("tc")).union(beside("right", "left", "tc", F.col("tr")))
    roots = connected_components(edges)
    border = parts.where("not inner").join(roots, ["grid_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    return parts.where("inner").withColumn("root", F.col("node")).unionByName(border)


def region_sizes(parts: DataFrame) -> DataFrame:
    """grid_id, root, size_cells and bounds of each region. Parts within a tile are as they are, the others are added up."""
    kept = ["grid_id", "root", "size_cells", "row_min", "row_max", "col_min", "col_max"]
    border = parts.where("not inner").groupBy("grid_id", "root").agg(
        F.sum("size_cells").alias("size_cells"), F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max")
    )
    return parts.where("inner").select(*kept).unionByName(border)


def classed_parts(parts: DataFrame, small: int = 10, large: int = 100) -> DataFrame:
    """The parts with the class of their region, void_class; only parts at borders are joined."""
    border = parts.where("not inner")
    whole = border.groupBy("grid_id", "root").agg(F.sum("size_cells").alias("whole"))
    found = border.join(whole, ["grid_id", "root"]).withColumn("void_class", void_class(F.col("whole"), small, large)).drop("whole")
    return parts.where("inner").withColumn("void_class", void_class(F.col("size_cells"), small, large)).unionByName(found)


def void_regions(cells: DataFrame, nodata: float | None, width: int, tile: int = TILE) -> DataFrame:
    """Runs, cut at the borders of tiles, with the region of each: grid_id, r, c0, c1, root (see :func:`region_parts`)."""

    def runs(batches):
        for batch in batches:
            for grid, tr, tc, starts, counts, root in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                at, n = (np.frombuffer(x, "<i4").astype(np.int64) for x in (starts, counts))
                c0 = tc * tile + at % tile
                yield pa.RecordBatch.from_pydict({"grid_id": [grid] * len(at), "r": tr * tile + at // tile, "c0": c0, "c1": c0 + n - 1, "root": [root] * len(at)})

    parts = region_parts(cells, nodata, width, tile).select("grid_id", "tr", "tc", "starts", "counts", "root")
    return parts.mapInArrow(runs, "grid_id string, r long, c0 long, c1 long, root long")


def _screened(nodata: float | None, window: int | None, threshold: float):
    """Filled values, classes and flags of a tile, of whose voids the classes are known."""

    def kernel(values: np.ndarray, there: np.ndarray, halo: int, classes: np.ndarray) -> list[np.ndarray]:
        inner = slice(halo, values.shape[0] - halo), slice(halo, values.shape[1] - halo)
        void = void_array(values, nodata)
        data, z, out = there & ~void, values[inner].copy(), classes.copy()
        known, total = np.zeros(z.shape, np.int64), np.zeros(z.shape)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if i or j:
                    near = tuple(slice(s.start + d, s.stop + d) for s, d in zip(inner, (i, j), strict=True))
                    known += data[near]
                    total += np.where(data[near], values[near], 0.0)
        small = classes == SMALL
        out[small & (known == 0)] = MEDIUM
        fill = small & (known > 0)
        z[fill] = total[fill] / known[fill]
        if window is None:
            return [z, out]
        half = window // 2
        around = slice(halo - half, values.shape[0] - halo + half), slice(halo - half, values.shape[1] - halo + half)
        return [z, out, *outlier_flags(nodata, window, threshold)(values[around], there[around], half)]

    return kernel


def screened_tiles(
    cells: DataFrame, parts: DataFrame, nodata: float | None, small: int = 10, large: int = 100, window: int | None = None, threshold: float = 3.0, tile: int = TILE
) -> DataFrame:
    """Tiles of the filled grid, with the classes of its cells (void_class) and, with a ``window``, the flags of outliers (artifact).

    Cells of small regions get the mean of the cells with data among the eight around them, in the input; those without any
    keep their value and have the medium class. Flags are of the input, too. One exchange of the grid, packed, serves all;
    of the regions only their parts' cells, packed, come along.
    """
    return _screening(marked_tiles, cells, parts, nodata, small, large, window, threshold, tile)


def screened_cells(
    cells: DataFrame, parts: DataFrame, nodata: float | None, small: int = 10, large: int = 100, window: int | None = None, threshold: float = 3.0, tile: int = TILE
) -> DataFrame:
    """The cells of :func:`screened_tiles`, without a table of tiles between: grid_id, r, c, z, void_class and perhaps artifact."""
    return _screening(marked_cells, cells, parts, nodata, small, large, window, threshold, tile)


def _screening(how, cells: DataFrame, parts: DataFrame, nodata: float | None, small: int, large: int, window: int | None, threshold: float, tile: int) -> DataFrame:
    names = {"void_class": "short"} | ({"artifact": "short"} if window else {})
    kernel = _screened(nodata, window, threshold)
    classed = classed_parts(parts, small, large).select("grid_id", "tr", "tc", "starts", "counts", "void_class")

    def run(values, there, halo, marks):
        classes = np.zeros((values.shape[0] - 2 * halo, values.shape[1] - 2 * halo), np.int16)
        for starts, counts, kind in marks:
            at = ranges(starts, counts)
            classes[at // tile, at % tile] = kind
        return kernel(values, there, halo, classes)

    return how(cells, classed, "void_class", run, max(1, (window or 1) // 2), names, tile)


def region_table(regions: DataFrame, small: int = 10, large: int = 100) -> DataFrame:
    """A row for each region: grid_id, region_id (from 1, in order of first cells), root, size_cells, bounds, void_class."""
    per = regions.groupBy("grid_id", "root").agg(
        F.sum(F.col("c1") - F.col("c0") + 1).alias("size_cells"), F.min("r").alias("row_min"), F.max("r").alias("row_max"),
        F.min("c0").alias("col_min"), F.max("c1").alias("col_max"),
    )
    return numbered_regions(per, small, large)


def numbered_regions(sizes: DataFrame, small: int = 10, large: int = 100) -> DataFrame:
    """Regions (see :func:`region_sizes`) with region_id, from 1 in the order of their first cells, and void_class."""
    return numbered(sizes, "root", "region_id").withColumn("void_class", void_class(F.col("size_cells"), small, large))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows of each grid from 1 in the order of ``key``, without gathering a grid in one task."""
    deals = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(deals, "grid_id", key).sortWithinPartitions("grid_id", key).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("part", F.shiftright("at", 33)))
    parts = placed.groupBy("grid_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("grid_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("grid_id", "part", (F.sum("n").over(before) - F.col("n") - F.col("first") + 1).alias("shift"))
    return placed.join(parts, ["grid_id", "part"]).withColumn(name, F.col("at") + F.col("shift")).drop("part", "at", "shift")


def void_summary(cells: DataFrame, table: DataFrame, nodata: float | None) -> DataFrame:
    """A row for each grid: cells, voids and their percentage, void cells by the class of their region, large regions."""
    whole = _grid(cells).groupBy("grid_id").agg(
        F.count("*").alias("total_cells"), F.count_if(is_void(F.col("z"), nodata)).alias("total_void_cells")
    )
    of = lambda k: F.sum(F.when(F.col("void_class") == k, F.col("size_cells")))
    per = table.groupBy("grid_id").agg(
        F.count("*").alias("regions"), of(SMALL).alias("small_cells"), of(MEDIUM).alias("medium_cells"), of(LARGE).alias("large_cells"),
        F.count_if(F.col("void_class") == LARGE).alias("large_regions"),
    )
    names = ["regions", "small_cells", "medium_cells", "large_cells", "large_regions"]
    pct = F.col("total_void_cells") / F.col("total_cells") * 100
    return whole.join(per, "grid_id", "left").select(
        "grid_id", "total_cells", "total_void_cells", pct.alias("void_pct"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]
    )

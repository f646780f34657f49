"""Tiles with halos: the way to run a neighbourhood kernel over a grid with one shuffle.

A kernel that looks ``halo`` cells around each cell needs nothing else of the grid. Each cell is sent to every tile
whose area, widened by the halo, holds it; the kernel runs on the dense tile and gives values for the tile's own area.
With tiles of 256 and a halo of 5, a cell is sent 1.08 times. A tile's size does not depend on the grid's.

Cells may carry a grid id, so that many grids are worked on at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
#: What a kernel gets: values (NaN where there is no cell), flags (0: no cell), and the halo; it returns the inner area,
#: or several such arrays.
Kernel = Callable[[np.ndarray, np.ndarray, int], np.ndarray | list[np.ndarray]]


def spread(place: Column, halo: int, tile: int) -> Column:
    """Tiles along an axis whose part, widened by the halo, holds a place."""
    first = F.greatest(place - halo, F.lit(0)).cast("long")
    return F.sequence(F.floor(first / tile), F.floor((place + halo) / tile))


def halo_map(
    cells: DataFrame, kernel: Kernel, halo: int, tile: int = TILE, flag: str = "1", name: str | list[str] = "out", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Run ``kernel`` over ``cells`` (r, c, z and perhaps grid_id); result: the same keys, ``carry`` and the kernel's values.

    ``flag`` is an SQL expression of a small integer that goes along with each cell, 1 or more. With a list of names, the
    kernel returns an array for each. Columns named in ``carry`` come back with their cells, so no join is needed for them.
    """
    keys, names = [c for c in ("grid_id",) if c in cells.columns], [name] if isinstance(name, str) else name
    sent = cells.select(*keys, "r", "c", "z", F.expr(flag).cast("byte").alias("flag"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    sent = sent.withColumn("tr", F.explode(spread(F.col("r"), halo, tile)))
    sent = sent.withColumn("tc", F.explode(spread(F.col("c"), halo, tile)))

    def run(key, table):
        tr, tc = key[-2].as_py(), key[-1].as_py()
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        r0, c0 = tr * tile - halo, tc * tile - halo
        # only as large as the part of the grid that is here
        high, wide = int(r.max()) - r0 + 1 + halo, int(c.max()) - c0 + 1 + halo
        high, wide = min(high, tile + 2 * halo), min(wide, tile + 2 * halo)
        values, flags = np.full((high, wide), np.nan), np.zeros((high, wide), np.int8)
        values[r - r0, c - c0] = table.column("z").to_numpy(zero_copy_only=False)
        flags[r - r0, c - c0] = table.column("flag").to_numpy()
        out = kernel(values, flags, halo)
        mine = (r >= tr * tile) & (r < (tr + 1) * tile) & (c >= tc * tile) & (c < (tc + 1) * tile)
        at = r[mine] - tr * tile, c[mine] - tc * tile
        columns = {k: pa.array([key[i]] * int(mine.sum()), key[i].type) for i, k in enumerate(keys)}
        columns |= {"r": r[mine], "c": c[mine]} | {x: table.column(f"carried_{x}").filter(pa.array(mine)) for x in carry}
        got = [out] if isinstance(name, str) else out
        return pa.table(columns | {n: pa.array(x[at].astype(np.float64), from_pandas=False) for n, x in zip(names, got, strict=True)})

    kinds = "".join(f"{k} {dict(cells.dtypes)[k]}, " for k in keys)
    more = "".join(f", {x} {dict(cells.dtypes)[x]}" for x in carry) + "".join(f", {n} double" for n in names)
    return sent.groupBy(*keys, "tr", "tc").applyInArrow(run, f"{kinds}r long, c long{more}")

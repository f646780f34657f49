"""Grids as tables of tiles, and kernels that look over the tiles' borders.

A row is a tile: tile (its key), grid_id, tr, tc, r0, c0, h, w and data (float64, row by row). Tiles have ``size`` by ``size``
cells, less at the grid's last rows and columns. ``present`` has a bit for each cell where a grid has holes, else it is null.

A kernel that looks ``halo`` cells around needs only strips of its eight neighbours: :func:`map_tiles` sends these, at most eight
small rows a tile, to the tiles, which stay where they are if they are laid out by their key (:func:`laid_out`). A table of
cells goes to tiles once, packed (:func:`to_tiles`); :func:`map_cells` does that, a kernel and the way back with one shuffle of
some eight bytes a cell. Nothing but a tile and its strips is ever in one place, whatever the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import ensure_checkpoint_dir

TILE = 256
#: Cells that a task packs at once: some 50 MB with all that is made of them, however large the grid is.
CELLS_AT_ONCE = 1 << 16
KEYS = "tile string, grid_id string, tr long, tc long, r0 long, c0 long, h int, w int"
SCHEMA = f"{KEYS}, data binary, present binary"
_KEY_NAMES = [part.split()[0] for part in KEYS.split(", ")]
#: What a kernel gets: values (NaN where there is no cell), which cells there are, and the halo; it returns an array of the inner
#: area for each name.
Kernel = Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]]
_TYPES = {"double": "<f8", "short": "<i2"}
_SIDES = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges that begin at ``starts`` and are ``counts`` long, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def key_of(grid_id: str, tr: int, tc: int) -> str:
    return f"{tr}/{tc}/{grid_id}"


# --- from cells to tiles, and back


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


_CHUNK = "tile string, grid_id string, tr long, tc long, starts binary, counts binary, data binary"


def _chunks(size: int, halo: int):
    """Cells packed by the tile that they belong to, or whose halo holds them: runs of places within the tile and its halo, and values."""
    side = size + 2 * halo

    def of(batches):
        for table in _gathered(batches, CELLS_AT_ONCE):
            grids = table.column("grid_id").combine_chunks().dictionary_encode()
            grids = grids.combine_chunks() if isinstance(grids, pa.ChunkedArray) else grids
            names, g = grids.dictionary.to_pylist(), grids.indices.to_numpy()
            r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
            z = table.column("z").to_numpy(zero_copy_only=False).astype(np.float64)
            tr, tc, lr, lc = r // size, c // size, r % size, c % size
            near_r = {-1: lr < halo, 0: True, 1: lr >= size - halo}
            near_c = {-1: lc < halo, 0: True, 1: lc >= size - halo}
            parts = [(np.arange(len(r)), 0, 0)] + [(np.flatnonzero(near_r[i] & near_c[j]), i, j) for i, j in _SIDES if halo]
            at = np.concatenate([k for k, _, _ in parts])
            to_r = np.concatenate([tr[k] + i for k, i, _ in parts])
            to_c = np.concatenate([tc[k] + j for k, _, j in parts])
            kept = (to_r >= 0) & (to_c >= 0)
            at, to_r, to_c = at[kept], to_r[kept], to_c[kept]
            place = (r[at] - to_r * size + halo) * side + c[at] - to_c * size + halo
            order = np.lexsort((place, to_c, to_r, g[at]))
            at, to_r, to_c, place = at[order], to_r[order], to_c[order], place[order]
            of_grid = g[at]
            new = np.append(True, (of_grid[1:] != of_grid[:-1]) | (to_r[1:] != to_r[:-1]) | (to_c[1:] != to_c[:-1]))
            run = np.flatnonzero(new | np.append(True, place[1:] != place[:-1] + 1))
            first, run_of = np.flatnonzero(new), np.append(run, len(at))
            values, lengths = z[at], np.diff(run_of)
            begin = np.searchsorted(run, first)
            rows = {name: [] for name in ("tile", "grid_id", "tr", "tc", "starts", "counts", "data")}
            for a, b, i, j in zip(first.tolist(), np.append(first[1:], len(at)).tolist(), begin.tolist(), np.append(begin[1:], len(run)).tolist(), strict=True):
                name, y, x = names[of_grid[a]], int(to_r[a]), int(to_c[a])
                starts, counts = place[run[i:j]].astype("<i4"), lengths[i:j].astype("<i4")
                for to, value in zip(rows.values(), (key_of(name, y, x), name, y, x, starts.tobytes(), counts.tobytes(), values[a:b].tobytes()), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_pydict(rows, _chunk_schema())

    return of


def _assembled(table: pa.Table, size: int, halo: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a tile with its halo, no larger than the part of the grid that is here."""
    side = size + 2 * halo
    places, values = [], []
    for starts, counts, data in zip(table["starts"].to_pylist(), table["counts"].to_pylist(), table["data"].to_pylist(), strict=True):
        places.append(ranges(np.frombuffer(starts, "<i4").astype(np.int64), np.frombuffer(counts, "<i4").astype(np.int64)))
        values.append(np.frombuffer(data, "<f8"))
    places, values = np.concatenate(places), np.concatenate(values)
    order = np.argsort(values, kind="stable")  # of repeated cells the greatest value stays, whichever came first
    rows, columns = places // side, places % side
    high, wide = min(side, int(rows.max()) + 1 + halo), min(side, int(columns.max()) + 1 + halo)
    out, there = np.full((high, wide), np.nan), np.zeros((high, wide), bool)
    out[rows[order], columns[order]] = values[order]
    there[rows, columns] = True
    return out, there


def _grid_cells(cells: DataFrame) -> DataFrame:
    grid = F.col("grid_id").cast("string") if "grid_id" in cells.columns else F.lit("")
    return cells.select(F.coalesce(grid, F.lit("")).alias("grid_id"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z"))


def _packed(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """Cells packed by tile. Spark sorts each task's cells by tile first, and spills what it must: so a tile's cells are in one
    piece or two a task, though only :data:`CELLS_AT_ONCE` of them are in Python at a time."""
    by_tile = F.shiftleft(F.floor(F.col("r") / size), 24).bitwiseXOR(F.floor(F.col("c") / size))
    return _grid_cells(cells).sortWithinPartitions(by_tile).mapInArrow(_chunks(size, halo), _CHUNK)


def _in_halo(size: int, halo: int) -> None:
    if not 0 <= halo <= size:
        raise ValueError("a halo is no wider than a tile")


def to_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of a table of cells (r, c, z, perhaps grid_id; rows and columns from 0). One shuffle of packed cells.

    Null values become NaN, and a null grid_id the empty one; of repeated cells the greatest value stays.
    """

    def of(key, table):
        values, there = _assembled(table, size, 0)
        return _tile_row(table["grid_id"][0].as_py(), table["tr"][0].as_py(), table["tc"][0].as_py(), size, values, there)

    return _packed(cells, size, 0).groupBy("tile").applyInArrow(of, SCHEMA)


BLOCKS = "grid_id string, r0 long, c0 long, h int, w int, data binary"


def blocks_to_tiles(blocks: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of blocks of any place and size (grid_id, r0, c0, h, w and data, as tiles have it), which are cut at the tiles' borders.

    One shuffle of the blocks' bytes; no cell becomes a row.
    """

    def cut(batches):
        for batch in batches:
            for b in batch.to_pylist():
                values = np.frombuffer(b["data"], "<f8").reshape(b["h"], b["w"])
                for tr in range(b["r0"] // size, (b["r0"] + b["h"] - 1) // size + 1):
                    for tc in range(b["c0"] // size, (b["c0"] + b["w"] - 1) // size + 1):
                        top, left = max(b["r0"], tr * size), max(b["c0"], tc * size)
                        part = values[top - b["r0"] : (tr + 1) * size - b["r0"], left - b["c0"] : (tc + 1) * size - b["c0"]]
                        starts = (np.arange(part.shape[0]) + top - tr * size) * size + left - tc * size
                        row = {"tile": key_of(b["grid_id"], tr, tc), "grid_id": b["grid_id"], "tr": tr, "tc": tc, "starts": starts.astype("<i4").tobytes()}
                        row |= {"counts": np.full(len(starts), part.shape[1], "<i4").tobytes(), "data": np.ascontiguousarray(part).tobytes()}
                        yield pa.RecordBatch.from_pylist([row], _chunk_schema())

    def of(key, table):
        values, there = _assembled(table, size, 0)
        return _tile_row(table["grid_id"][0].as_py(), table["tr"][0].as_py(), table["tc"][0].as_py(), size, values, there)

    read = blocks.where("h > 0 and w > 0").select(*[part.split()[0] for part in BLOCKS.split(", ")])
    return read.mapInArrow(cut, _CHUNK).groupBy("tile").applyInArrow(of, SCHEMA)


def _chunk_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in _CHUNK.split(", "))])


def _tile_row(grid_id: str, tr: int, tc: int, size: int, values: np.ndarray, there: np.ndarray | None) -> pa.Table:
    high, wide = values.shape
    whole = there is None or bool(there.all())
    row = [key_of(grid_id, tr, tc), grid_id, tr, tc, tr * size, tc * size, high, wide, np.ascontiguousarray(values, "<f8").tobytes(), None if whole else np.packbits(there).tobytes()]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[*_KEY_NAMES, "data", "present"])


def _present(bits: bytes | None, high: int, wide: int) -> np.ndarray:
    if bits is None:
        return np.ones((high, wide), bool)
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=high * wide).astype(bool).reshape(high, wide)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of tiles, of which one at a time becomes Python objects."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


def _block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    shape = row["h"], row["w"]
    return np.frombuffer(row["data"], "<f8").reshape(shape), _present(row["present"], *shape)


def from_tiles(tiles: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The cells of tiles: grid_id, r, c and for each of ``names`` (z from data, by default) the values of that binary column.

    Names that end in ``:short`` hold 16-bit integers. No shuffle.
    """
    names = names or {"z": "data"}
    kinds = {to: (name.partition(":")[0], name.partition(":")[2] or "double") for to, name in names.items()}

    def of(batches):
        for batch in batches:
            for row in _rows(batch):
                there = _present(row["present"], row["h"], row["w"])
                r, c = np.nonzero(there)
                columns = [pa.repeat(pa.scalar(row["grid_id"], pa.string()), len(r)), pa.array(r + row["r0"]), pa.array(c + row["c0"])]
                for name, kind in kinds.values():
                    columns.append(pa.array(np.frombuffer(row[name], _TYPES[kind]).reshape(there.shape)[r, c], from_pandas=False))
                yield pa.RecordBatch.from_arrays(columns, names=["grid_id", "r", "c", *kinds])

    read = tiles.select("grid_id", "r0", "c0", "h", "w", "present", *{name for name, _ in kinds.values()})
    return read.mapInArrow(of, "grid_id string, r long, c long" + "".join(f", {to} {kind}" for to, (_, kind) in kinds.items()))


# --- kernels


def map_cells(cells: DataFrame, kernel: Kernel, halo: int, names: dict[str, str], size: int = TILE) -> DataFrame:
    """Run ``kernel`` over a table of cells: its keys and a column for each of ``names`` (name: double or short). One shuffle.

    Each cell is sent, packed, to every tile whose halo holds it: 1.08 times with tiles of 256 and a halo of 5. Cells that
    are not there have no result.
    """
    _in_halo(size, halo)
    keys = [c for c in ("grid_id",) if c in cells.columns]
    kind = dict(cells.dtypes).get("grid_id", "string")

    def of(key, table):
        values, there = _assembled(table, size, halo)
        inner = there[halo : max(halo, there.shape[0] - halo), halo : max(halo, there.shape[1] - halo)]
        r, c = np.nonzero(inner)
        out = kernel(values, there, halo) if len(r) else [np.zeros(inner.shape)] * len(names)
        columns = {"grid_id": pa.repeat(table["grid_id"][0], len(r))} | {"r": r + table["tr"][0].as_py() * size, "c": c + table["tc"][0].as_py() * size}
        for (name, how), x in zip(names.items(), out, strict=True):
            columns[name] = pa.array(x[r, c].astype(_TYPES[how]), from_pandas=False)
        return pa.table(columns)

    schema = "grid_id string, r long, c long" + "".join(f", {n} {k}" for n, k in names.items())
    out = _packed(cells, size, halo).groupBy("tile").applyInArrow(of, schema)
    return out.select(*[F.col(k).cast(kind).alias(k) for k in keys], "r", "c", *names)


def laid_out(tiles: DataFrame) -> DataFrame:
    """Tiles dealt by their key and written to the shared checkpoint folder, so that no later join by key shuffles them.

    Adaptive execution would forget how they are dealt, so it is off while they are written.
    """
    spark = tiles.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tile").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


_STRIP = "tile string, r0 long, c0 long, h int, w int, data binary, present binary"


def _strips(size: int, halo: int):
    """What each of a tile's neighbours needs of it."""

    def of(batches):
        for batch in batches:
            rows = []
            for row in _rows(batch):
                values, there = _block(row)
                cut = {n: {-1: slice(0, min(halo, n)), 0: slice(0, n), 1: slice(size - halo, max(size - halo, n))} for n in values.shape}
                for i, j in _SIDES:
                    tr, tc = row["tr"] + i, row["tc"] + j
                    down, across = cut[row["h"]][i], cut[row["w"]][j]
                    part, has = np.ascontiguousarray(values[down, across]), there[down, across]
                    if tr >= 0 and tc >= 0 and has.any():
                        bits = None if has.all() else np.packbits(has).tobytes()
                        place = row["r0"] + down.start, row["c0"] + across.start
                        rows.append((key_of(row["grid_id"], tr, tc), *place, *part.shape, part.tobytes(), bits))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[part.split()[0] for part in _STRIP.split(", ")])

    return of


def strips(tiles: DataFrame, halo: int, size: int = TILE) -> DataFrame:
    """tile, strips: the parts of its neighbours that a tile's halo holds, with the place of each."""
    sent = tiles.select("grid_id", "tr", "tc", "r0", "c0", "h", "w", "data", "present").mapInArrow(_strips(size, halo), _STRIP)
    return sent.groupBy("tile").agg(F.collect_list(F.struct("r0", "c0", "h", "w", "data", "present")).alias("strips"))


def with_strips(row: dict, halo: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a tile with the strips around it. Behind holes at its end the tile is as large as they need."""
    around = row["strips"] or []
    high = max([row["h"], *(s["r0"] + s["h"] - row["r0"] - halo for s in around)])
    wide = max([row["w"], *(s["c0"] + s["w"] - row["c0"] - halo for s in around)])
    values, there = np.full((high + 2 * halo, wide + 2 * halo), np.nan), np.zeros((high + 2 * halo, wide + 2 * halo), bool)
    for part in (row, *around):
        block, has = _block(part)
        top, left = part["r0"] - row["r0"] + halo, part["c0"] - row["c0"] + halo
        at = slice(top, top + part["h"]), slice(left, left + part["w"])
        values[at] = np.where(has, block, np.nan)
        there[at] = has
    return values, there


def map_tiles(tiles: DataFrame, kernel: Kernel, halo: int, names: dict[str, str], size: int = TILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Run ``kernel`` over tiles: the tiles with a binary column for each of ``names`` (name: double or short).

    ``carry``: further binary columns that come along.

    Only strips are shuffled if the tiles are laid out (:func:`laid_out`), else each tile once, too.
    """
    _in_halo(size, halo)
    kept = [*_KEY_NAMES, "data", "present", *carry]

    def of(batches):
        for batch in batches:
            for row in _rows(batch):
                out = [x[: row["h"], : row["w"]] for x in kernel(*with_strips(row, halo), halo)]
                more = [np.ascontiguousarray(x, _TYPES[kind]).tobytes() for x, kind in zip(out, names.values(), strict=True)]
                columns = [pa.array([row[n]], batch.schema.field(n).type) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x], pa.binary()) for x in more]], names=[*kept, *names])

    joined = tiles.select(*kept)
    joined = joined.join(strips(tiles, halo, size).hint("merge"), "tile", "left") if halo else joined.withColumn("strips", F.array())
    return joined.mapInArrow(of, SCHEMA + "".join(f", {n} binary" for n in (*carry, *names)))


def _marked(cells: DataFrame, marks: DataFrame, mark: str, kernel, halo: int, size: int, result, schema: str) -> DataFrame:
    """What ``result`` makes of each tile's key row, the kernel's arrays and presence, with ``schema``; see :func:`marked_tiles`."""
    _in_halo(size, halo)
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "short": pa.int16()}
    kinds = [(name, arrow[kind]) for name, kind in (part.split() for part in schema.split(", "))]

    def of(key, table):
        table = table.sort_by("mark")
        given = table.filter(pc.is_null(table["data"]))
        table = table.filter(pc.is_valid(table["data"]))
        if not table.num_rows:
            return pa.schema(kinds).empty_table()
        values, there = _assembled(table, size, halo)
        inner = there[halo : max(halo, there.shape[0] - halo), halo : max(halo, there.shape[1] - halo)]
        if not inner.any():
            return pa.schema(kinds).empty_table()
        found = [(*(np.frombuffer(x, "<i4").astype(np.int64) for x in (m["starts"], m["counts"])), m["mark"]) for m in given.to_pylist()]
        out = kernel(values, there, halo, found)
        return result(table["grid_id"][0].as_py(), table["tr"][0].as_py(), table["tc"][0].as_py(), out, inner)

    packed = _packed(cells, size, halo).withColumn("mark", F.lit(None).cast("int"))
    key = F.concat_ws("/", F.col("tr").cast("string"), F.col("tc").cast("string"), F.col("grid_id"))
    told = marks.select(key.alias("tile"), "grid_id", "tr", "tc", "starts", "counts", F.lit(None).cast("binary").alias("data"), F.col(mark).cast("int").alias("mark"))
    return packed.unionByName(told).groupBy("tile").applyInArrow(of, schema)


def marked_tiles(cells: DataFrame, marks: DataFrame, mark: str, kernel, halo: int, names: dict[str, str], size: int = TILE) -> DataFrame:
    """Run ``kernel`` over a table of cells, of which some are marked: tiles with data and a binary column for each of ``names``.

    ``marks``: grid_id, tr, tc, starts, counts (runs of places in the tile, row by row) and the whole number ``mark``. The kernel gets
    (starts, counts, mark) of its tile besides, and returns new values and an array for each name. One shuffle of packed cells.
    """

    def result(grid_id, tr, tc, out, inner):
        row = _tile_row(grid_id, tr, tc, size, out[0], inner)
        for (name, kind), x in zip(names.items(), out[1:], strict=True):
            row = row.append_column(name, pa.array([np.ascontiguousarray(x, _TYPES[kind]).tobytes()], pa.binary()))
        return row

    return _marked(cells, marks, mark, kernel, halo, size, result, SCHEMA + "".join(f", {n} binary" for n in names))


def marked_cells(cells: DataFrame, marks: DataFrame, mark: str, kernel, halo: int, names: dict[str, str], size: int = TILE) -> DataFrame:
    """The cells of :func:`marked_tiles`, from the same task: grid_id, r, c, z and each of ``names``. Tiles that are asked for once
    need no second Python worker that takes them apart."""

    def result(grid_id, tr, tc, out, inner):
        r, c = np.nonzero(inner)
        columns = {"grid_id": pa.repeat(pa.scalar(grid_id, pa.string()), len(r)), "r": r + tr * size, "c": c + tc * size}
        for (name, kind), x in zip({"z": "double", **names}.items(), out, strict=True):
            columns[name] = pa.array(x[r, c].astype(_TYPES[kind]), from_pandas=False)
        return pa.table(columns)

    return _marked(cells, marks, mark, kernel, halo, size, result, "grid_id string, r long, c long, z double" + "".join(f", {n} {k}" for n, k in names.items()))

"""GeoTIFF files as tables of cells, and grids written as GeoTIFF tiles.

Files are read by the source ``grid_files``: large ones are split into ranges of their blocks (tiles or strips), and a
task reads its own blocks' bytes only. Where files lie in a store that only Spark's readers open, ``whole_files`` takes
them through ``binaryFile`` instead, a file in a task. Grids are written as a mosaic: one georeferenced file for each tile, made from the tile's cells
alone, so a grid of any size is written without gathering it. Classic TIFF and BigTIFF, one band (the first of several is read), strips or
tiles, uncompressed, LZW or deflate.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from terrane.operators.tile_table import BLOCKS, TILE, blocks_to_tiles

#: Fixed values of the format: tag numbers, and the sizes and codes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA_TEXT = 33550, 33922, 34264, 34735, 42113
MODEL_TYPE, GEOGRAPHIC_CRS, PROJECTED_CRS = 1024, 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Files of more bytes are read by several tasks.
SPLIT_BYTES = 64 << 20
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Samples by (format, bits); 64-bit integers above 2^53 lose their last digits in float64, as all samples become that.
KINDS = {
    (1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (2, 64): "i8",
    (3, 16): "f2", (3, 32): "f4", (3, 64): "f8",
}
#: How samples are stored: as they are, as differences along a row, or as differences of the bytes of floating-point numbers.
PLAIN, DIFFERENCES, BYTE_DIFFERENCES = 1, 2, 3


def unpack_bits(data: bytes) -> bytes:
    """Runs of bytes: a count of literal bytes less one, or of repeats of the next byte as 257 less that count."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


def samples_of(raw: bytes, dtype: np.dtype, predictor: int, rows: int, wide: int, many: int) -> np.ndarray:
    """The samples of a block, by row, column and band."""
    if predictor == BYTE_DIFFERENCES:
        size, n = dtype.itemsize, wide * many
        planes = np.frombuffer(raw, np.uint8, rows * n * size).reshape(rows, size * wide, many)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, n)  # the highest bytes of a row come first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, wide, many)
    block = np.frombuffer(raw, dtype, rows * wide * many).reshape(rows, wide, many)
    return np.cumsum(block, axis=1, dtype=dtype.newbyteorder("=")) if predictor == DIFFERENCES else block


_FAR = 1 << 62


@dataclass(frozen=True)
class Window:
    """Cells of the rows r0 to r1 and the columns c0 to c1, both included."""

    r0: int = 0
    r1: int = _FAR
    c0: int = 0
    c1: int = _FAR


def lzw_decode(data: bytes) -> bytes:
    out, table, width, code, bits, previous = [], [], 9, 0, 0, None
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(start)
    for byte in data:
        code, bits = (code << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        now, code = code >> bits, code & ((1 << bits) - 1)
        if now == 257:
            break
        if now == 256:
            table, width, previous = list(start), 9, None
            continue
        if previous is None:
            entry = table[now]
        else:
            entry = table[now] if now < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out.append(entry)
        previous = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, following, now = {bytes([i]): i for i in range(256)}, 9, 258, b""
    put(256, 9)
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more], following, now = following, following + 1, data[i : i + 1]
        if following == 4095:
            put(table[now], width)
            put(256, width)
            table, width, following, now = {bytes([k]): k for k in range(256)}, 9, 258, b""
        elif following + 1 > 1 << width:
            width += 1
    if now:
        put(table[now], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


class Tiff:
    """The first image of a file."""

    def __init__(self, data):
        """``data``: the bytes of a file, or a file opened for reading, of which only what is needed is read."""
        self.data = data
        head = self._bytes(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        kind = struct.unpack(self.order + "H", head[2:4])[0]
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = kind == 43  # BigTIFF: places and counts of 8 bytes
        self.tags = self._tags(struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0])
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height = one(WIDTH, 0), one(HEIGHT, 0)
        self.samples, self.compression, self.predictor = one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        kind = KINDS.get((one(SAMPLE_FORMAT, 1), one(BITS, 1)))
        floating = kind is not None and kind[0] == "f"
        if self.samples < 1 or kind is None or self.predictor not in ((PLAIN, BYTE_DIFFERENCES) if floating else (PLAIN, DIFFERENCES)):
            raise ValueError("no band, or a kind of samples that is not supported")
        self.dtype = np.dtype(self.order + kind)
        text = self.tags.get(NODATA_TEXT)
        self.nodata = float(text[0].split(b"\0")[0].strip() or b"nan") if text else None

    def _bytes(self, at: int, n: int) -> bytes:
        if isinstance(self.data, bytes):
            return self.data[at : at + n]
        self.data.seek(at)
        return self.data.read(n)

    def _tags(self, at: int) -> dict:
        place = "Q" if self.big else "I"  # of a place or a count
        lead, size = ("Q", 20) if self.big else ("H", 12)
        lead_size, place_size = struct.calcsize("=" + lead), struct.calcsize("=" + place)
        entries = struct.unpack(self.order + lead, self._bytes(at, lead_size))[0]
        table, out = self._bytes(at + lead_size, entries * size), {}
        for i in range(entries):
            entry = table[i * size : (i + 1) * size]
            tag, kind, n = struct.unpack(self.order + "HH" + place, entry[: 4 + place_size])
            if kind not in TYPES:
                continue
            form = f"{n}s" if kind == 2 else f"{n}{TYPES[kind]}"
            length, value = struct.calcsize(self.order + form), entry[4 + place_size :]
            if length > place_size:
                value = self._bytes(struct.unpack(self.order + place, value)[0], length)
            out[tag] = struct.unpack(self.order + form, value[:length])
        return out

    def header(self) -> dict:
        scale, matrix = self.tags.get(PIXEL_SCALE), self.tags.get(TRANSFORM)
        res = (abs(scale[0]), abs(scale[1])) if scale else (abs(matrix[0]), abs(matrix[5])) if matrix else (1.0, 1.0)
        keys = self.tags.get(GEO_KEYS, ())
        geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = geo.get(PROJECTED_CRS) or geo.get(GEOGRAPHIC_CRS)
        left, top = self.origin()
        return {
            "width": self.width, "height": self.height, "res_x": float(res[0]), "res_y": float(res[1]), "nodata": self.nodata,
            "dtype": self.dtype.newbyteorder("=").name, "band_count": self.samples, "crs": f"EPSG:{code}" if code else None,
            "crs_is_geographic": geo.get(MODEL_TYPE) == 2 if geo else True,
            "left": left, "top": top, "right": left + res[0] * self.width, "bottom": top - res[1] * self.height,
        }

    def origin(self) -> tuple[float, float]:
        tie, matrix = self.tags.get(TIEPOINT), self.tags.get(TRANSFORM)
        return (tie[3], tie[4]) if tie else (matrix[3], matrix[7]) if matrix else (0.0, 0.0)

    def _layout(self) -> tuple[int, int, int]:
        """Columns and rows of a block, and the number of blocks."""
        if TILE_OFFSETS in self.tags:
            wide, high = self.tags[TILE_WIDTH][0], self.tags[TILE_HEIGHT][0]
        else:
            wide, high = self.width, min(self.tags.get(ROWS_PER_STRIP, (self.height,))[0], self.height)
        return wide, high, -(-self.width // wide) * -(-self.height // high)

    def places(self, window: "Window", first: int = 0, last: int | None = None) -> list[int]:
        """Numbers of the blocks, from first to before last, that hold cells of the window."""
        wide, high, n = self._layout()
        across = -(-self.width // wide)
        k = np.arange(first, n if last is None else min(last, n))
        r, c = k // across * high, k % across * wide
        rows, columns = np.minimum(r + high, self.height), np.minimum(c + wide, self.width)
        return k[(r <= window.r1) & (rows > window.r0) & (c <= window.c1) & (columns > window.c0)].tolist()

    def blocks(self, first: int = 0, last: int | None = None, window: "Window | None" = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """First row, first column and values (float64) of each block, or of those from first to before last.

        With a window only the blocks that it touches are read, and cut to it.
        """
        apart, tiled = self.tags.get(PLANAR, (1,))[0] == 2, TILE_OFFSETS in self.tags
        wide, high, n = self._layout()
        places, counts = (self.tags[TILE_OFFSETS], self.tags[TILE_COUNTS]) if tiled else (self.tags[STRIP_OFFSETS], self.tags[STRIP_COUNTS])
        across = -(-self.width // wide)
        many = 1 if apart else self.samples
        for k in self.places(window or Window(), first, last):
            r, c = k // across * high, k % across * wide
            raw = self._bytes(places[k], counts[k])
            if self.compression == LZW:
                raw = lzw_decode(raw)
            elif self.compression in (DEFLATE, OLD_DEFLATE):
                raw = zlib.decompress(raw)
            elif self.compression == PACKBITS:
                raw = unpack_bits(raw)
            elif self.compression != NONE:
                raise ValueError(f"compression {self.compression} is not supported")
            rows = high if tiled else min(high, self.height - r)
            block = samples_of(raw, self.dtype, self.predictor, rows, wide, many)[: self.height - r, : self.width - c, 0]
            if window:
                top, left = max(0, window.r0 - r), max(0, window.c0 - c)
                block = block[top : max(top, min(block.shape[0], window.r1 + 1 - r)), left : max(left, min(block.shape[1], window.c1 + 1 - c))]
                r, c = r + top, c + left
            yield r, c, block.astype(np.float64)


def encode(
    values: np.ndarray, nodata: float | None = None, res: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0),
    epsg: int | None = None, geographic: bool = True, compression: int = LZW,
) -> bytes:
    """A file of tiles of 256 by 256 cells, those at the edges filled up with nodata (or 0)."""
    kinds = {"f": 3, "u": 1, "i": 2}
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[compression]
    high, wide = values.shape
    whole = np.full((-(-high // TILE) * TILE, -(-wide // TILE) * TILE), 0 if nodata is None else nodata).astype(values.dtype)
    whole[:high, :wide] = values
    strips = [pack(whole[r : r + TILE, c : c + TILE].tobytes()) for r in range(0, high, TILE) for c in range(0, wide, TILE)]
    tags = {
        WIDTH: ("I", [wide]), HEIGHT: ("I", [high]), BITS: ("H", [values.dtype.itemsize * 8]),
        COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), TILE_OFFSETS: ("I", [0] * len(strips)), SAMPLES: ("H", [1]),
        TILE_WIDTH: ("I", [TILE]), TILE_HEIGHT: ("I", [TILE]), TILE_COUNTS: ("I", [len(s) for s in strips]), SAMPLE_FORMAT: ("H", [kinds[values.dtype.kind]]),
        PIXEL_SCALE: ("d", [res[0], res[1], 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]),
    }
    if epsg is not None:
        tags[GEO_KEYS] = ("H", [1, 1, 0, 2, MODEL_TYPE, 0, 1, 2 if geographic else 1, GEOGRAPHIC_CRS if geographic else PROJECTED_CRS, 0, 1, epsg])
    if nodata is not None:
        tags[NODATA_TEXT] = ("s", repr(float(nodata)).encode() + b"\0")
    first = 8 + 2 + 12 * len(tags) + 4
    extra = sum(-(-len(_field(v)) // 2) * 2 for v in tags.values() if len(_field(v)) > 4)
    places = np.cumsum([first + extra, *map(len, strips)])[:-1]
    tags[TILE_OFFSETS] = ("I", places.tolist())
    head, tail = struct.pack("<4sIH", b"II*\0", 8, len(tags)), b""
    for tag in sorted(tags):
        form, values_ = tags[tag]
        data = _field(tags[tag])
        kind = {v: k for k, v in TYPES.items()}[form]
        head += struct.pack("<HHI", tag, kind, len(values_))
        if len(data) > 4:
            head += struct.pack("<I", first + len(tail))
            tail += data + b"\0" * (len(data) % 2)
        else:
            head += data.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + tail + b"".join(strips)


def _field(value) -> bytes:
    form, items = value
    return items if form == "s" else struct.pack(f"<{len(items)}{form}", *items)


_HEADER = (
    "path string, width long, height long, res_x double, res_y double, nodata double, dtype string, band_count int, crs string, "
    "crs_is_geographic boolean, left double, top double, right double, bottom double"
)


def _files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The files below ``path``; their contents are read only if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif*").load(path).select("path", *columns)


def read_headers(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """A row for each file, of whose bytes only the head is read (with ``whole_files``, for stores that only Spark's readers open, all)."""

    def of(batches):
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                if whole_files:
                    head = Tiff(batch.column(1)[i].as_py()).header()
                else:
                    store, place = _store(name)
                    with store.open_input_file(place) as file:
                        head = Tiff(file).header()
                yield pa.RecordBatch.from_pylist([{"path": name, **head}], schema)

    names = [part.split() for part in _HEADER.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])
    return _files(spark, path, *(["content"] if whole_files else [])).mapInArrow(of, _HEADER)


_CELLS = "grid_id string, r long, c long, z double"


def _cells_of(name: str, blocks) -> Iterator[pa.RecordBatch]:
    for r, c, block in blocks:
        high, wide = block.shape
        rows, columns = np.repeat(np.arange(r, r + high), wide), np.tile(np.arange(c, c + wide), high)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), block.size), pa.array(rows), pa.array(columns), pa.array(block.ravel())], names=["grid_id", "r", "c", "z"])


def _store(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class GridFiles(DataSource):
    """Cells of the files of a folder, or of one file."""

    @classmethod
    def name(cls) -> str:
        return "grid_files"

    def schema(self) -> str:
        return _CELLS

    def reader(self, schema) -> DataSourceReader:
        return _GridReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class _GridReader(DataSourceReader):
    """Reads the blocks that filters on rows, columns and grid_id leave, of the files that they leave."""

    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.window, self.names = Window(), None

    def pushFilters(self, filters):
        """Takes bounds on r and c, and names of grids. All filters go back to Spark, which applies them to the cells."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name == "grid_id" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif name in ("r", "c"):
                self._bound(name, f)
            yield f

    def _bound(self, name: str, f) -> None:
        if isinstance(f, In):
            low, high = (min(f.value), max(f.value)) if f.value else (_FAR, -1)
        elif isinstance(f, EqualTo):
            low = high = f.value
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low, high = f.value + isinstance(f, GreaterThan), _FAR
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            low, high = 0, f.value - isinstance(f, LessThan)
        else:
            return
        lowest, highest = f"{name}0", f"{name}1"
        self.window = replace(self.window, **{lowest: max(getattr(self.window, lowest), low), highest: min(getattr(self.window, highest), high)})

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((x for x in found if x.is_file and x.extension.lower() in ("tif", "tiff")), key=lambda x: x.path):
            if self.names is not None and f.path not in self.names:
                continue
            if f.size <= self.split_bytes:
                out.append(_Blocks(f.path, 0, None))
                continue
            with store.open_input_file(f.path) as file:  # only such files are opened here, and only their heads are read
                head = Tiff(file)
            n = head._layout()[2]
            step = max(1, n * self.split_bytes // f.size)
            wanted = {k // step for k in head.places(self.window)}
            out += [_Blocks(f.path, k * step, (k + 1) * step) for k in sorted(wanted)]
        return out or [_Blocks("", 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with _store(self.path)[0].open_input_file(partition.path) as file:
                yield from _cells_of(partition.path, Tiff(file).blocks(partition.first, partition.last, self.window))


def read_cells(spark: SparkSession, path: str, whole_files: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cells of all files: grid_id (the path), r, c, z.

    Filters on r, c and grid_id reach the files: other files are not opened, other blocks not read. That switches the session's
    ``spark.sql.python.filterPushdown.enabled`` on. ``whole_files``: for stores that only Spark's readers open.
    """
    if not whole_files:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(GridFiles)
        return spark.read.format("grid_files").option("split_bytes", split_bytes).load(path)

    def of(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _cells_of(name, Tiff(data.as_py()).blocks())

    return _files(spark, path, "content").mapInArrow(of, _CELLS)


class GridBlocks(GridFiles):
    """The same files block by block, whose cells stay packed."""

    @classmethod
    def name(cls) -> str:
        return "grid_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class _BlockReader(_GridReader):
    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.path:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            with _store(self.path)[0].open_input_file(partition.path) as file:
                for r, c, block in Tiff(file).blocks(partition.first, partition.last):
                    row = (partition.path, r, c, *block.shape, np.ascontiguousarray(block, "<f8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[part.split()[0] for part in BLOCKS.split(", ")])


def read_tiles(spark: SparkSession, path: str, size: int = TILE, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Tiles of all files (see :mod:`terrane.operators.tile_table`), grid_id being the path. Filters on grid_id reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridBlocks)
    return blocks_to_tiles(spark.read.format("grid_blocks").option("split_bytes", split_bytes).load(path), size)


class TileFiles(DataSource):
    """Sink of (name, content) rows as files of a folder.

    Tasks write to hidden folders of their own; when all have ended the files of the attempts that count get their names, and
    with mode ``overwrite`` earlier files of the same ``stem`` that are not among them go. A job that fails leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TileFiles(self.options["path"], self.options.get("stem", ""), overwrite)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _TileFiles(DataSourceWriter):
    def __init__(self, path: str, stem: str, overwrite: bool):
        self.path, self.stem, self.overwrite, self.run = path, stem, overwrite, f".{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        store, root = _store(self.path)
        folder, names = f"{root}/{self.run}/{uuid.uuid4().hex}", []
        for row in rows:
            if not names:
                store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(row.content)
            names.append(row.name)
        return _Written(folder, names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        written = [m for m in messages if m is not None]
        if self.overwrite:
            new = {name for m in written for name in m.names}
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.base_name not in new and re.fullmatch(re.escape(self.stem) + r"_\d+_\d+\.tif", f.base_name):
                    store.delete_file(f.path)
        for m in written:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.run}").type.name == "Directory":
            store.delete_dir(f"{root}/{self.run}")


def write_tiles(
    cells: DataFrame, path: str, stem: str, column: str = "z", dtype: str = "float64", nodata: float | None = None, tile: int = TILE,
    res: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0), epsg: int | None = None, geographic: bool = True,
    compression: int = LZW,
) -> None:
    """Write ``column`` of one grid's cells as files ``<stem>_<tile row>_<tile column>.tif`` in the shared folder ``path``.

    Cells without a value get nodata. Earlier files of this stem are replaced, those of tiles that are no more go.
    """

    def of(key, table):
        tr, tc = key[0].as_py(), key[1].as_py()
        r, c = table.column("r").to_numpy() - tr * tile, table.column("c").to_numpy() - tc * tile
        block = np.full((int(r.max()) + 1, int(c.max()) + 1), 0 if nodata is None else nodata, np.dtype(dtype))
        values = table.column("v").to_numpy(zero_copy_only=False).astype(np.float64)
        values[np.array(table.column("v").is_null())] = 0 if nodata is None else nodata
        block[r, c] = values.astype(dtype)
        corner = origin[0] + tc * tile * res[0], origin[1] - tr * tile * res[1]
        data = encode(block, nodata, res, corner, epsg, geographic, compression)
        return pa.table({"name": [f"{stem}_{tr}_{tc}.tif"], "content": pa.array([data], pa.binary())})

    cells.sparkSession.dataSource.register(TileFiles)
    placed = cells.select("r", "c", F.col(column).alias("v"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    files = placed.groupBy("tr", "tc").applyInArrow(of, "name string, content binary")
    files.write.format("tile_files").mode("overwrite").option("path", path).option("stem", stem).save()


def write_tile_table(
    tiles: DataFrame, path: str, stem: str, column: str = "data", kind: str = "double", dtype: str = "float64", nodata: float | None = None, size: int = TILE,
    res: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0), epsg: int | None = None, geographic: bool = True, compression: int = LZW,
) -> None:
    """Write a binary column (of ``kind`` double or short) of one grid's tiles as files like those of :func:`write_tiles`. No shuffle.

    Cells that are not there, and NaN, get nodata (0 without it, and NaN stays in floating-point files then).
    """

    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shape = row["h"], row["w"]
                values = np.frombuffer(row["v"], {"double": "<f8", "short": "<i2"}[kind]).reshape(shape).astype(np.float64)
                gone = np.zeros(shape, bool) if row["present"] is None else ~np.unpackbits(np.frombuffer(row["present"], np.uint8), count=values.size).astype(bool).reshape(shape)
                if nodata is not None or np.dtype(dtype).kind != "f":
                    gone |= np.isnan(values)
                block = np.where(gone, 0 if nodata is None else nodata, values).astype(dtype)
                corner = origin[0] + row["tc"] * size * res[0], origin[1] - row["tr"] * size * res[1]
                data = encode(block, nodata, res, corner, epsg, geographic, compression)
                yield pa.RecordBatch.from_pydict({"name": [f"{stem}_{row['tr']}_{row['tc']}.tif"], "content": pa.array([data], pa.binary())})

    tiles.sparkSession.dataSource.register(TileFiles)
    files = tiles.select("tr", "tc", "h", "w", "present", F.col(column).alias("v")).mapInArrow(of, "name string, content binary")
    files.write.format("tile_files").mode("overwrite").option("path", path).option("stem", stem).save()

"""Files of grids: what filters leave unread, kinds of samples, and what a second writing leaves."""

import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import diffusion, voids
from terrane.operators import tile_table as T
from terrane.plans import smoothing
from terrane.sources import geotiff

NODATA = -9999.0
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _write(path, z, **more):
    path.write_bytes(geotiff.encode(z, NODATA, compression=more.pop("compression", geotiff.DEFLATE), **more))


def _spoiled(path, keep):
    """Writes nonsense over all blocks but those whose (row, column) among the blocks is in ``keep``; reading one of these fails."""
    data = bytearray(path.read_bytes())
    tiff = geotiff.Tiff(bytes(data))
    across = -(-tiff.width // geotiff.TILE)
    for k, (place, n) in enumerate(zip(tiff.tags[geotiff.TILE_OFFSETS], tiff.tags[geotiff.TILE_COUNTS], strict=True)):
        if divmod(k, across) not in keep:
            data[place : place + n] = b"\xff" * n
    path.write_bytes(data)


def test_a_window_reads_its_blocks_only(spark, tmp_path):
    z = np.arange(1000.0 * 800).reshape(1000, 800)
    for name in ("a.tif", "b.tif"):
        _write(tmp_path / name, z)
        _spoiled(tmp_path / name, {(1, 1), (1, 2)})
    (tmp_path / "c.tif").write_bytes(b"II*\0 this is no image" * 9)
    window = (F.col("r").between(300, 310)) & (F.col("c") >= 400) & (F.col("c") < 520) & (F.col("grid_id") == str(tmp_path / "a.tif"))
    for split in (1 << 30, 1000):  # a file in a task, and every block
        cells = geotiff.read_cells(spark, str(tmp_path), split_bytes=split).where(window)
        got = {(x.r, x.c): x.z for x in cells.collect()}
        assert got == {(r, c): z[r, c] for r in range(300, 311) for c in range(400, 520)}
        if split == 1000:
            assert cells.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="decompress|not a TIFF"):
        geotiff.read_cells(spark, str(tmp_path / "a.tif")).where("r between 100 and 310").collect()
    two = geotiff.read_cells(spark, str(tmp_path)).where(F.col("grid_id").isin(str(tmp_path / "a.tif"), str(tmp_path / "b.tif"))).where("r > 255 and r <= 256 and c in (257, 258)")
    assert sorted((os.path.basename(x.grid_id), x.c) for x in two.collect()) == [(n, c) for n in ("a.tif", "b.tif") for c in (257, 258)]
    assert geotiff.read_cells(spark, str(tmp_path / "a.tif")).where("r > 5000").count() == 0


def test_windows_of_strips():
    """Blocks as wide as the grid, and windows that touch none, one or all."""
    z = np.arange(70.0 * 45).reshape(70, 45)
    tiff = geotiff.Tiff(geotiff.encode(z))
    for r0, r1, c0, c1 in ((0, 69, 0, 44), (5, 5, 7, 7), (60, 99, 40, 99), (80, 90, 0, 9)):
        out = np.zeros(z.shape)
        for r, c, block in tiff.blocks(window=geotiff.Window(r0, r1, c0, c1)):
            out[r : r + block.shape[0], c : c + block.shape[1]] = block
        want = np.zeros(z.shape)
        want[r0 : r1 + 1, c0 : c1 + 1] = z[r0 : r1 + 1, c0 : c1 + 1]
        assert (out == want).all()


@pytest.mark.parametrize("dtype", ["uint64", "int64", "float16"])
def test_wide_and_narrow_samples(dtype):
    z = (np.random.RandomState(3).rand(40, 30) * 1000).astype(dtype)
    tiff = geotiff.Tiff(geotiff.encode(z))
    ((_, _, block),) = tiff.blocks()
    assert (block == z.astype(float)).all() and tiff.header()["dtype"] == dtype


@pytest.mark.parametrize("dtype", ["<f4", ">f4", "<f8", "<f2"])
def test_differences_of_bytes(dtype):
    """Floating-point numbers whose bytes are put apart, highest first, and replaced by their differences along a row."""
    z = np.random.RandomState(5).normal(0, 100, (6, 9, 2)).astype(dtype)
    rows = []
    for line in z:
        planes = line.ravel().astype(np.dtype(dtype).newbyteorder(">")).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T.ravel()
        rows.append(planes.copy())
        rows[-1][2:] -= planes[:-2]  # two bands: the byte of the same band before
    got = geotiff.samples_of(b"".join(r.tobytes() for r in rows), np.dtype(dtype), geotiff.BYTE_DIFFERENCES, 6, 9, 2)
    assert (got.astype(float) == z.astype(float)).all()


def test_packed_bits():
    packed = bytes([2, 1, 2, 3, 0xFE, 9, 0x80, 0, 7, 0x81, 5])
    assert geotiff.unpack_bits(packed) == bytes([1, 2, 3, 9, 9, 9, 7]) + bytes([5]) * 128


def test_headers_of_large_files(spark, tmp_path):
    """Only the head is read: a file that ends behind it has a header."""
    z = np.zeros((600, 600))
    _write(tmp_path / "a b.tif", z, res=(2.0, 3.0))
    want = [tuple(r) for r in geotiff.read_headers(spark, str(tmp_path), whole_files=True).drop("path").collect()]
    data = (tmp_path / "a b.tif").read_bytes()
    (tmp_path / "a b.tif").write_bytes(data[: geotiff.Tiff(data).tags[geotiff.TILE_OFFSETS][0]])
    assert [tuple(r) for r in geotiff.read_headers(spark, str(tmp_path)).drop("path").collect()] == want


def _grid(spark, high, wide, value):
    return spark.range(high * wide).selectExpr(f"id div {wide} as r", f"id % {wide} as c", f"{value}D as z")


def test_a_smaller_grid_replaces_a_larger_one(spark, tmp_path):
    for high, value in ((40, 1.0), (10, 2.0)):
        geotiff.write_tiles(_grid(spark, high, high, value), str(tmp_path), "dem", tile=16)
        geotiff.write_tiles(_grid(spark, 5, 5, 3.0), str(tmp_path), "dem_other", tile=16)
    cells = geotiff.read_cells(spark, str(tmp_path))
    got = {os.path.basename(x.grid_id): (x.n, x.z) for x in cells.groupBy("grid_id").agg(F.count("*").alias("n"), F.max("z").alias("z")).collect()}
    assert got == {"dem_0_0.tif": (100, 2.0), "dem_other_0_0.tif": (25, 3.0)}
    assert sorted(os.listdir(tmp_path)) == ["dem_0_0.tif", "dem_other_0_0.tif"]


def test_a_failed_writing_leaves_the_files(spark, tmp_path):
    geotiff.write_tiles(_grid(spark, 20, 20, 1.0), str(tmp_path), "dem", tile=16)
    before = {name: (tmp_path / name).read_bytes() for name in os.listdir(tmp_path)}
    rows = spark.range(8).selectExpr("concat('dem_', id, '_0.tif') as name", "if(id = 7, cast(raise_error('no more') as binary), cast('x' as binary)) as content")
    with pytest.raises(Exception, match="no more"):
        rows.repartition(8).write.format("tile_files").mode("overwrite").option("path", str(tmp_path)).option("stem", "dem").save()
    assert {name: (tmp_path / name).read_bytes() for name in os.listdir(tmp_path)} == before


def test_regions_beyond_the_width(spark):
    """Two voids that a wrong width would give one number."""
    z = np.zeros((4, 8))
    z[0, 4] = z[1, 0] = NODATA
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(4) for c in range(8)], "r long, c long, z double")
    assert voids.region_table(voids.void_regions(cells, NODATA, 8)).count() == 2
    with pytest.raises(Exception, match="columns"):
        voids.void_regions(cells, NODATA, 4)


def test_one_rule_of_resolution(spark):
    cells = spark.range(9).selectExpr("id div 3 as r", "id % 3 as c", "cast(id as double) as z")
    for res, want in ((0.5, 1.0), (4.0, 0.25), (30.0, 0.1), (0.0, 1.0)):
        stats = smoothing.smooth(cells, smoothing.Parameters(), NODATA, res, res)["statistics"].first()
        assert stats.resolution_scale_factor == want and abs(stats.effective_diffusion - 0.2 * want) < 1e-12


@pytest.mark.parametrize("gone", ["xxhash", "terrane.llm"])
def test_queries_without_the_corpus_operators(gone):
    """A library that is not there takes the corpus operators with it, and nothing else."""
    code = (
        f"import sys, warnings\nsys.modules[{gone!r}] = None\nwarnings.simplefilter('ignore')\nimport __spark_entry__ as e\n"
        "names = e.queries()\nassert 'void_summary_g1' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)\nassert len(e.oracle_sql()) > 50"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)


def test_big_tiff_head():
    """Places and counts of eight bytes."""
    z = np.arange(6.0).reshape(2, 3)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 64), (259, 3, 1, 1), (273, 16, 1, 16 + 8 + 20 * 8 + 8), (277, 3, 1, 1), (279, 16, 1, 48), (339, 3, 1, 3)]
    data = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0) + z.tobytes()
    ((r, c, block),) = geotiff.Tiff(data).blocks(window=geotiff.Window(1, 1, 0, 1))
    assert (r, c, block.tolist()) == (1, 0, [[3.0, 4.0]])


@pytest.mark.parametrize("split", [1 << 30, 1000])
def test_files_to_tiles_and_back(spark, tmp_path, split):
    """A mosaic is read as tiles, worked on and written without a cell as a row; the cells are those of the way by cells."""
    rng = np.random.RandomState(2)
    z = rng.normal(0, 5, (300, 530)).round(2)
    z[rng.rand(*z.shape) < 0.05] = NODATA
    _write(tmp_path / "dem.tif", z)
    tiles = geotiff.read_tiles(spark, str(tmp_path / "dem.tif"), 100, split)
    assert tiles.agg(F.sum(F.col("h") * F.col("w")), F.count("*")).first() == (z.size, 18)
    out = diffusion.diffuse_tiles(tiles, NODATA, 2, 0.2, 4.0, 100)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Generate", "explode"))
    geotiff.write_tile_table(out, str(tmp_path / "out"), "smooth", "x", nodata=NODATA, size=100)
    cells = geotiff.read_cells(spark, str(tmp_path / "dem.tif"))
    geotiff.write_tiles(diffusion.diffuse(cells, NODATA, 2, 0.2, 4.0), str(tmp_path / "cells"), "smooth", "smoothed", nodata=NODATA, tile=100)
    names = sorted(os.listdir(tmp_path / "out"))
    assert names == sorted(os.listdir(tmp_path / "cells")) and len(names) == 18
    assert all((tmp_path / "out" / n).read_bytes() == (tmp_path / "cells" / n).read_bytes() for n in names)


def test_blocks_with_holes(spark):
    """Blocks of odd places and sizes, some of which are missing."""
    rows = [("g", r, c, h, w, np.arange(h * w, dtype="<f8").tobytes()) for r, c, h, w in ((0, 0, 5, 3), (0, 3, 5, 9), (7, 2, 4, 4), (3, 20, 0, 5))]
    got = T.from_tiles(T.blocks_to_tiles(spark.createDataFrame(rows, T.BLOCKS), 4))
    want = {(r + i, c + j): float(i * w + j) for _, r, c, h, w, _ in rows for i in range(h) for j in range(w)}
    assert {(x.r, x.c): x.z for x in got.collect()} == want

"""Tables of tiles against tables of cells, and against windows in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import diffusion, outliers
from terrane.operators import tile_table as T

NODATA = -9999.0


@pytest.fixture(scope="module")
def cells(spark):
    """Two grids of unlike sizes, one with holes, voids, NaN and infinite cells."""
    rng, rows = np.random.RandomState(4), []
    for name, high, wide in (("a", 37, 23), ("b", 9, 50), ("c", 1, 1)):
        z = rng.normal(0, 5, (high, wide)).round(3)
        z[rng.rand(high, wide) < 0.1] = NODATA
        if name == "b":
            z[3, 3], z[4, 20] = np.nan, np.inf
        rows += [(name, r, c, float(z[r, c])) for r in range(high) for c in range(wide) if name != "b" or (r * 7 + c) % 11]
    return spark.createDataFrame(rows, "grid_id string, r long, c long, z double").repartition(5).cache()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [4, 8, 256])
def test_round_trip(cells, size):
    tiles = T.to_tiles(cells, size)
    assert tiles.columns == [part.split()[0] for part in T.SCHEMA.split(", ")]
    assert _rows(T.from_tiles(tiles)) == _rows(cells.select("grid_id", "r", "c", "z"))
    shapes = tiles.where("grid_id = 'a'").groupBy().agg(F.sum(F.col("h") * F.col("w")), F.max("h"), F.max(F.col("r0") + F.col("h"))).first()
    assert tuple(shapes) == (37 * 23, min(size, 37), 37)


def test_odd_cells(spark):
    """Nulls, repeated cells, other names of columns, and no cells at all."""
    rows = [("g", 0, 0, 1.0), ("g", 0, 0, 3.0), ("g", 0, 0, 2.0), ("g", 0, 1, None), (None, 2, 2, 5.0)]
    df = spark.createDataFrame(rows, "grid_id string, r long, c long, z double").selectExpr("*", "'x' as tile", "1 as data")
    assert _rows(T.from_tiles(T.to_tiles(df))) == _rows(spark.createDataFrame([("g", 0, 0, 3.0), ("g", 0, 1, float("nan")), ("", 2, 2, 5.0)], "grid_id string, r long, c long, z double"))
    assert T.to_tiles(df.limit(0)).count() == 0 and T.from_tiles(T.to_tiles(df.limit(0))).count() == 0
    assert T.map_tiles(T.to_tiles(df.limit(0)), lambda v, t, h: [v], 0, {"x": "double"}).count() == 0
    with pytest.raises(ValueError):
        T.map_tiles(T.to_tiles(df, 4), lambda v, t, h: [v], 5, {"x": "double"}, 4)


def _sum_around(values, there, halo):
    """Sums over the window of the halo, and how many cells there are in it."""
    n = 2 * halo + 1
    views = [np.lib.stride_tricks.sliding_window_view(x, (n, n)).sum(axis=(2, 3)) for x in (np.where(there & np.isfinite(values), values, 0.0), there)]
    return [views[0], views[1].astype(np.int16)]


@pytest.mark.parametrize("halo", [1, 4])
def test_strips_are_the_neighbours(spark, cells, halo):
    """A kernel over laid-out tiles, over others, and over packed cells sees the same halo as an equality join of all cells around."""
    names = {"s": "double", "n": "short"}
    tiles = T.to_tiles(cells, 4)
    got = [T.from_tiles(T.map_tiles(t, _sum_around, halo, names, 4), {"s": "s", "n": "n:short"}) for t in (tiles, T.laid_out(tiles))]
    got.append(T.map_cells(cells, _sum_around, halo, names, 4))
    around = cells.select("grid_id", F.explode(F.sequence(F.col("r") - halo, F.col("r") + halo)).alias("r"), "c", "z")
    around = around.select("grid_id", "r", F.explode(F.sequence(F.col("c") - halo, F.col("c") + halo)).alias("c"), "z")
    finite = F.when(~F.isnan("z") & (F.abs("z") < float("inf")), F.col("z")).otherwise(0.0)
    want = cells.select("grid_id", "r", "c").join(around.groupBy("grid_id", "r", "c").agg(F.sum(finite).alias("s"), F.count("*").cast("short").alias("n")), ["grid_id", "r", "c"])
    key = lambda df: sorted((x.grid_id, x.r, x.c, round(x.s, 6), x.n) for x in df.collect())
    assert all(key(df) == key(want) for df in got)


@pytest.mark.parametrize("steps", [3, 40])
def test_diffusion_on_tiles(cells, steps):
    one = cells.where("grid_id = 'a'").drop("grid_id")
    tiles = T.laid_out(T.to_tiles(one, 8))
    got = T.from_tiles(diffusion.diffuse_tiles(tiles, NODATA, steps, 0.2, 4.0, 8), {"z": "data", "x": "x"})
    got = {(x.r, x.c): x.z if np.isnan(x.x) else x.x for x in got.collect()}
    for df in (diffusion.diffuse(one, NODATA, steps, 0.2, 4.0, 8), diffusion.diffuse(one, NODATA, steps, 0.2, 4.0)):
        assert {(x.r, x.c): x.smoothed for x in df.collect()} == got
    if steps == 3:
        assert all(abs(got[x.r, x.c] - x.smoothed) < 1e-9 for x in diffusion.diffuse_by_windows(one, NODATA, steps, 0.2, 4.0).collect())


@pytest.mark.parametrize("window", [3, 7])
def test_outliers_on_tiles(cells, window):
    got = T.from_tiles(outliers.flag_tiles(T.to_tiles(cells, 8), NODATA, window, 2.0, 8), {"artifact": "artifact:short"})
    assert _rows(got) == _rows(outliers.flag_outliers(cells, NODATA, window, 2.0)) and got.agg(F.sum("artifact")).first()[0] > 0


def _shuffled(spark, df):
    """Bytes that the stages of a write have shuffled, by the status store."""
    store = spark._jsparkSession.sparkContext().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in total().items() if stage not in before)


def test_only_strips_are_shuffled(spark):
    """Of a grid laid out in tiles, a kernel shuffles less than a tenth of what a table of cells takes to its tiles."""
    cells = spark.range(512 * 512).selectExpr("id div 512 as r", "id % 512 as c", "rand(3) as z")
    tiles = T.laid_out(T.to_tiles(cells))
    on_tiles = _shuffled(spark, diffusion.diffuse_tiles(tiles, NODATA, 5))
    as_rows = cells.withColumn("tr", F.col("r") / 256).repartition("tr").select("r", "c", "z")
    assert 0 < on_tiles < _shuffled(spark, as_rows) / 10
    assert on_tiles < _shuffled(spark, diffusion.diffuse(cells, NODATA, 5)) / 10

"""What a task holds at a time does not grow with the grid."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.functions import wkb
from terrane.operators import shapes, voids
from terrane.operators import tile_table as T
from terrane.plans import queries, screening


def _batches(cells: int, wide: int):
    for at in range(0, cells, 10_000):
        i = np.arange(at, min(cells, at + 10_000))
        yield pa.RecordBatch.from_pydict({"grid_id": [""] * len(i), "r": i // wide, "c": i % wide, "z": i / 7})


@pytest.mark.parametrize(("wide", "halo"), [(7, 5), (30, 1), (7, 1), (64, 5), (64, 1), (7, 2)])
def test_packing_holds_few_cells(wide, halo):
    """Half a million cells of a narrow grid, of which many are in halos."""
    tracemalloc.start()
    try:
        packed = sum(len(x) // 8 for batch in T._chunks(256, halo)(_batches(1 << 19, wide)) for x in batch.column("data").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert packed > 1 << 19 and peak < 40e6


def test_few_pieces_a_tile(spark):
    """Cells in no order: a task makes one piece of a tile's cells, or two where its share ends, and none is lost."""
    cells = spark.range(1 << 18).selectExpr("id div 7 as r", "id % 7 as c", "cast(id as double) as z").repartition(2)
    packed = T._packed(cells, 64, 1).where("tr >= 0 and tc >= 0").select("tile", F.spark_partition_id().alias("task"), F.length("data").alias("bytes"))
    tiles = (1 << 18) / (64 * 7)
    got = packed.agg(F.count("*"), F.sum("bytes") / 8).first()
    assert got[0] < 2 * tiles * 3.2 and got[1] >= 1 << 18  # own cells and those of the rows above and below


def test_shapes_are_read_once(spark):
    """However many tests of validity there are, the shapes behind them are made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        made.add(1)
        return i

    square = "array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 0D))))"
    rows = spark.range(5).select(counted("id").alias("key"), F.expr(f"named_struct('kind', {wkb.POLYGON}, 'parts', {square}, 'members', array())").alias("shape"))
    assert shapes.validity(rows, "key", "shape").where("valid").count() == 5 and made.value == 5


def test_screened_cells_come_of_one_worker(spark):
    """Tiles that are asked for once are not sent to a second Python worker in the same task; cells are those of the tiles."""
    rng = np.random.RandomState(6)
    z = rng.rand(40, 30)
    z[rng.rand(40, 30) < 0.4] = -9999.0
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(40) for c in range(30)], "r long, c long, z double").cache()
    screened = screening.stage0(cells, -9999.0, 30, 3, 9).screened
    plan = screened._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("FlatMapGroupsInArrow")]
    tiles = voids.screened_tiles(cells, voids.region_parts(cells, -9999.0, 30, 8), -9999.0, 3, 9, tile=8)
    again = T.from_tiles(tiles, {"z": "data", "void_class": "void_class:short"})
    assert "MapInArrow" not in after and sorted(map(str, screened.collect())) == sorted(map(str, again.collect()))


def test_class_cells_of_the_query_come_of_one_worker(spark):
    """void_class_cells_g3 takes its cells from the kernel's worker, and its grid comes in tiles' bands, all of it."""
    got = queries.queries()["void_class_cells_g3"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("FlatMapGroupsInArrow")
    assert below and "MapInArrow" not in above and "RepartitionByExpression [band" in below
    assert got.agg(F.count("*"), F.count_if(F.col("void_class") < 0)).first() == (1500 * 7, 0)

"""Table functions of SQL against the DataFrame form."""

import numpy as np
import pytest

from terrane.operators import diffusion, outliers
from terrane.plans import table_functions

NODATA = -9999.0


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.RandomState(8)
    rows = [(g, r, c, float(v)) for g in ("a", "b") for (r, c), v in np.ndenumerate(np.where(rng.rand(21, 13) < 0.1, NODATA, rng.normal(0, 3, (21, 13)).round(2)))]
    table_functions.register(spark)
    return spark.createDataFrame(rows, "grid_id string, r long, c long, z double").cache()


def test_local_outliers(spark, cells):
    table_functions.with_halo(cells, 2, 8).createOrReplaceTempView("wide_cells")
    got = spark.sql(f"SELECT grid_id, r, c, artifact FROM local_outliers(TABLE(wide_cells) PARTITION BY tile, nodata => {NODATA}D, window_size => 5, threshold => 2D, size => 8)")
    want = outliers.flag_outliers(cells, NODATA, 5, 2.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("artifact = 1").count() > 0


def test_diffusion(spark, cells):
    table_functions.with_halo(cells.where("grid_id = 'a'").drop("grid_id"), 3, 8).createOrReplaceTempView("wide_cells")
    got = spark.sql(f"SELECT * FROM diffusion(TABLE(wide_cells) PARTITION BY tile, nodata => {NODATA}D, steps => 3, k => 4D, size => 8)")
    assert got.columns == ["r", "c", "z", "smoothed"]
    want = diffusion.diffuse(cells.where("grid_id = 'a'").drop("grid_id"), NODATA, 3, 0.2, 4.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_what_is_asked_of_the_table(spark, cells):
    cells.createOrReplaceTempView("bare_cells")
    with pytest.raises(Exception, match="lacks tr, tc"):
        spark.sql("SELECT * FROM local_outliers(TABLE(bare_cells))").collect()
    table_functions.with_halo(cells.limit(0), 1).createOrReplaceTempView("no_cells")
    assert spark.sql("SELECT * FROM local_outliers(TABLE(no_cells) PARTITION BY tile)").count() == 0

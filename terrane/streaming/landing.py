"""Grids that land in a folder, screened as they come (an addition; the tools themselves are batch tools).

A neighbourhood needs the whole grid around it, so grids arrive as whole Parquet files of cells (grid_id, r, c, z) and each
micro-batch is screened by the batch plan. Files of one grid must arrive together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrane.plans import screening

CELLS = "grid_id string, r long, c long, z double"


def screen_landing(spark: SparkSession, folder: str, out: str, width: int, nodata: float | None, checkpoint: str, window: int = 3) -> StreamingQuery:
    """Screen what is in ``folder`` and what has come since the last run; results under ``out``/batch=<number>."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.persist()
        found = screening.stage0(batch, nodata, width, window=window)
        found.screened.write.mode("overwrite").parquet(f"{out}/cells/batch={number}")
        found.summary.write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(CELLS).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

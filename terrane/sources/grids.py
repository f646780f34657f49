"""Grids of elevation cells derived from the tables, for queries and tests.

A grid is a table of cells: r and c (rows downwards, columns to the right, from 0) and z. Grids are dense: cells
without data hold the nodata value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
COLUMNS_G1, DAYS_G2, LINES_G3 = 64, 30, 7


def embedding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector, its elements as columns; single voids by a rule, and two blocks of voids."""
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "e"))
    void = "(r * 7 + c * 13) % 97 = 0 or (r between 100 and 103 and c between 10 and 19) or (r between 200 and 219 and c between 20 and 39)"
    return cells.selectExpr("r", "cast(c as bigint) as c", f"if({void}, {NODATA}D, cast(e as double) * 100) as z")


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by days: the largest value of a day's events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("r"), F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("c"), "value"
    )
    return _dense(events.select("r", "c", F.col("value").alias("z"), F.lit(True).alias("row")), DAYS_G2)


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by line numbers: the largest price of a line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("r"), (F.col("l_linenumber") - 1).cast("long").alias("c"), F.col("l_extendedprice").alias("z"), F.lit(False).alias("row")
    )
    rows = spark.range(spark.read.parquet(f"{sf_dir}/orders.parquet").count())
    rows = rows.select(F.col("id").alias("r"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("z"), F.lit(True).alias("row"))
    return _dense(lines.unionByName(rows), LINES_G3)


#: Rows of a grid that are dealt together, as high as a tile.
BAND = 256


def _dense(found: DataFrame, width: int) -> DataFrame:
    """All cells of the rows that ``row`` tells to be of the grid, with ``width`` columns: the largest z found there, else nodata.

    Rows are dealt by the band of a tile's height that they lie in, so that a tile's cells are made in one task and packed in one piece.
    """
    at = lambda i: F.max(F.when((F.col("c") == i) & F.col("r").isNotNull(), F.col("z"))).alias(f"z{i}")
    dealt = found.withColumn("band", F.floor(F.col("r") / BAND)).repartition("band")
    rows = dealt.groupBy("band", "r").agg(F.max("row").alias("row"), *[at(i) for i in range(width)]).where("row")
    cells = rows.select("r", F.posexplode(F.array(*[F.coalesce(f"z{i}", F.lit(NODATA)) for i in range(width)])).alias("c", "z"))
    return cells.select("r", F.col("c").cast("long").alias("c"), "z")

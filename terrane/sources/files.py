"""Small readers and writers: JSON, CSV, vectors as GeoJSON or CSV, result views."""

from __future__ import annotations

import json
import logging
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans import settings

log = logging.getLogger("terrane")

RASTER_FORMATS, VECTOR_FORMATS = ("tif", "tiff"), ("geojson", "csv")
#: Kinds of results and the ends of their names.
SCREENING_OUTPUTS = {"screened": "_screened", "void_mask": "_void_mask", "artifacts": "_artifact_mask", "report": "_screening_report", "provenance": "_provenance"}
SMOOTHING_OUTPUTS = {"smoothed": "_smoothed", "difference": "_smoothing_difference", "mask": "_smoothing_mask", "report": "_smoothing_report", "provenance": "_smoothing_provenance"}


def output_names(source: str, outputs: dict[str, str]) -> dict[str, str]:
    stem = PurePosixPath(source).stem
    return {kind: stem + end for kind, end in outputs.items()}


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """None, and a line in the log, if the file is missing or is not JSON."""
    try:
        df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        df.limit(1).count()
        return df
    except PySparkException as e:
        log.warning("cannot read %s: %s", path, type(e).__name__)
        return None
    except Exception as e:  # errors of the JVM that have no class of their own
        log.warning("cannot read %s: %s", path, type(e).__name__)
        return None


def write_json(df: DataFrame, path: str) -> bool:
    try:
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
        return True
    except Exception as e:
        log.warning("cannot write %s: %s", path, type(e).__name__)
        return False


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A header line, and every value a string. None if the file is missing."""
    try:
        return spark.read.csv(path, header=True, inferSchema=False)
    except PySparkException as e:
        log.warning("cannot read %s: %s", path, type(e).__name__)
        return None


def geojson_lines(df: DataFrame, rings: str = "ring") -> DataFrame:
    """One GeoJSON feature of a polygon a line; ``rings`` is an array of (x, y), all other columns are properties."""
    points = F.transform(rings, lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    others = [c for c in df.columns if c != rings]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*others).alias("properties"))).alias("value"))


def write_vector(df: DataFrame, path: str, rings: str = "ring") -> bool:
    """By the name's end: GeoJSON (a feature a line) or CSV; any other end gives GeoJSON under that name.

    False, and a line in the log, if it cannot be written. Kinds that need a library which is no part of this (GeoPackage,
    shapefile) are refused, not written as something else.
    """
    kind = PurePosixPath(path).suffix.lstrip(".").lower()
    if kind in ("gpkg", "shp"):
        raise ValueError(f"vectors can be written as {VECTOR_FORMATS}, not as {kind!r}")
    try:
        if kind == "csv":
            df.withColumn(rings, F.to_json(rings)).write.mode("overwrite").csv(path, header=True)
        else:
            geojson_lines(df, rings).write.mode("overwrite").text(path)
        return True
    except Exception as e:
        log.warning("cannot write %s: %s", path, type(e).__name__)
        return False


def load_views(results: dict[str, DataFrame], stem: str) -> list[str]:
    """Make results visible as views ``<stem>_<kind>``, those that the settings do not switch off (``load.<kind>``)."""
    names = []
    for kind, df in results.items():
        if settings.get_bool(df.sparkSession, f"load.{kind}", True):
            df.createOrReplaceTempView(f"{stem}_{kind}")
            names.append(f"{stem}_{kind}")
    return names


def read_provenance(text: str) -> dict:
    return json.loads(text)

"""Settings under one prefix of the session's configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "terrane."
TRUE = ("true", "1", "yes")


def put(spark: SparkSession, key: str, value) -> None:
    spark.conf.set(PREFIX + key, str(value))


def get(spark: SparkSession, key: str, default=None):
    return spark.conf.get(PREFIX + key, None) if exists(spark, key) else default


def exists(spark: SparkSession, key: str) -> bool:
    return spark.conf.get(PREFIX + key, None) is not None


def get_bool(spark: SparkSession, key: str, default: bool = False) -> bool:
    value = get(spark, key)
    return default if value is None else str(value).lower() in TRUE


def get_as(kind, spark: SparkSession, key: str, default):
    """The setting as ``kind`` makes it of its text; the default if it is not there or makes no sense."""
    value = get(spark, key)
    try:
        return default if value is None else kind(value)
    except ValueError:
        return default


def get_int(spark: SparkSession, key: str, default: int = 0) -> int:
    return get_as(int, spark, key, default)


def get_float(spark: SparkSession, key: str, default: float = 0.0) -> float:
    return get_as(float, spark, key, default)


def get_string(spark: SparkSession, key: str, default: str | None = "") -> str | None:
    return get_as(str, spark, key, default)


def remove(spark: SparkSession, key: str) -> None:
    spark.conf.unset(PREFIX + key)


def export(spark: SparkSession) -> dict[str, str]:
    return {k.removeprefix(PREFIX): v for k, v in spark.conf.getAll.items() if k.startswith(PREFIX)}


def keys(spark: SparkSession) -> list[str]:
    return sorted(export(spark))


def clear(spark: SparkSession) -> None:
    for key in export(spark):
        remove(spark, key)

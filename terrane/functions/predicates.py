"""Predicates and rules on cells and parameters.

Spark takes NaN as equal to itself and larger than any number, so conditions on values that may be NaN say so.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16

#: Fixed values. Kinds of elevation sources: code, label, default vertical accuracy (RMSE, metres).
SOURCE_TYPES = [
    (0, "Auto-detect", None),
    (1, "LiDAR bare-earth (DTM)", 0.15),
    (2, "LiDAR surface model (DSM, uncorrected)", 0.40),
    (3, "SRTM (30m / 90m)", 4.00),
    (4, "Copernicus GLO-30", 4.00),
    (5, "FABDEM / FathomDEM / GEDTM30", 1.50),
    (6, "Aerial photogrammetry", 0.75),
    (7, "Unknown / Other", 5.00),
]
UNKNOWN_RMSE = 5.0

VALID, SMALL, MEDIUM, LARGE = 0, 1, 2, 3


def is_finite(z: Column) -> Column:
    return ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))


def is_void(z: Column, nodata: float | None) -> Column:
    """A cell without data: equal to nodata; without a nodata value, not finite; with NaN as nodata, none."""
    if nodata is None:
        return ~is_finite(z)
    return F.lit(False) if math.isnan(nodata) else z == F.lit(float(nodata))


def is_valid(z: Column, nodata: float | None) -> Column:
    """A cell that smoothing works on: finite and not nodata."""
    finite = is_finite(z)
    return finite if nodata is None or math.isnan(nodata) else finite & (z != F.lit(float(nodata)))


def void_array(z: np.ndarray, nodata: float | None) -> np.ndarray:
    """:func:`is_void` in kernels."""
    if nodata is None:
        return ~np.isfinite(z)
    return np.zeros(z.shape, bool) if math.isnan(nodata) else z == nodata


def valid_array(z: np.ndarray, nodata: float | None) -> np.ndarray:
    """:func:`is_valid` in kernels."""
    return np.isfinite(z) & ~void_array(z, nodata)


def void_class(size: Column, small: int = 10, large: int = 100) -> Column:
    return F.when(size <= small, SMALL).when(size <= large, MEDIUM).otherwise(LARGE)


def resolution_factor(res_x: Column, res_y: Column) -> Column:
    """By how much diffusion is weakened for coarse cells: 1 over the mean cell size, between 0.1 and 1."""
    mean = (res_x + res_y) / 2
    return F.when(mean <= 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.try_divide(F.lit(1.0), mean))))


def change_tolerance(k: float) -> float:
    """Differences up to this do not count as changes."""
    return max(EPSILON * 100, abs(k) * 1e-9)


def artifact_band(pct: Column) -> Column:
    """Band of the rate of flagged cells, in percent."""
    return (
        F.when(pct == 0, "none").when(pct < 0.1, "very_low").when(pct < 1, "low").when(pct < 5, "moderate").otherwise("high")
    )


def next_steps(large_regions: Column, is_geographic: Column, artifact_pct: Column) -> Column:
    """What should follow a screening, in order."""
    return F.array_compact(
        F.array(
            F.when(large_regions > 0, "treat_large_voids"),
            F.when(is_geographic, "reproject"),
            F.when(artifact_pct > 1, "review_artifacts"),
            F.when((large_regions <= 0) & (artifact_pct <= 1), "passed"),
        )
    )


def source_notes(code: Column) -> Column:
    return (
        F.when(code == 1, "bias_correction").when(code == 2, "lidar_ground_filter").when(code == 5, "bias_correction").otherwise("none")
    )


def source_types(spark) -> DataFrame:
    return spark.createDataFrame(SOURCE_TYPES, "code int, label string, default_rmse double")


def with_rmse(requests: DataFrame, types: DataFrame) -> DataFrame:
    """Vertical accuracy of each request (code, user_rmse): the user's if above 0, else the kind's, else that of unknown ones."""
    user = F.when(F.col("user_rmse") > 0, F.col("user_rmse"))
    kind = F.when(F.col("user_rmse") > 0, "user").when(F.col("code") == 0, "auto_default").otherwise("source_type")
    return requests.join(F.broadcast(types), "code", "left").select(
        "code", "user_rmse", F.coalesce(user, "default_rmse", F.lit(UNKNOWN_RMSE)).alias("rmse"), kind.alias("rmse_source")
    )


# checks of single values, as columns


def is_not_none(v: Column) -> Column:
    return v.isNotNull()


def is_not_empty_string(s: Column) -> Column:
    return F.coalesce(s.rlike(r"\S"), F.lit(False))


def _number(v: Column) -> Column:
    x = F.trim(v.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def is_positive_number(v: Column) -> Column:
    return F.coalesce(_number(v) > 0, F.lit(False))


def is_in_range(v: Column, low: Column, high: Column) -> Column:
    return F.coalesce(_number(v).between(low, high), F.lit(False))


def is_valid_epsg(v: Column) -> Column:
    """Codes from 1024 to 32767. Texts must be whole numbers; of numbers, a fraction is cut off."""
    text = F.trim(v.cast("string"))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    code = F.when(F.typeof(v).rlike("^(float|double|decimal)"), v.try_cast("double").try_cast("long")).otherwise(whole)
    return F.coalesce(code.between(1024, 32767), F.lit(False))


def check_screening(small: int, large: int, window: int, threshold: float) -> int:
    """Raise if parameters do not fit together; the window made odd."""
    if small >= large:
        raise ValueError(f"the small void limit ({small}) must be below the large one ({large})")
    if window < 1 or threshold <= 0:
        raise ValueError("window and threshold must be positive")
    return window + 1 if window % 2 == 0 else window


def check_smoothing(iterations: int, strength: float, edge: float) -> None:
    if iterations < 1:
        raise ValueError("iterations must be 1 or more")
    if not 0 < strength <= 0.25:
        raise ValueError("diffusion strength must be above 0 and at most 0.25")
    if edge <= 0:
        raise ValueError("edge threshold must be above 0")

"""Checks of tables as layers: grids of cells (r, c, z) and tables of shapes (a ring or a WKB geometry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans import settings

CELL_COLUMNS = ("r", "c", "z")
SHAPE_COLUMNS = ("ring", "geometry")
#: Kinds of shapes by the type number of well-known binary, single and multiple.
POINT, LINE, POLYGON = (1, 4), (2, 5), (3, 6)


def is_grid(layer) -> bool:
    """Whether this is a table of cells."""
    return isinstance(layer, DataFrame) and set(CELL_COLUMNS) <= set(layer.columns)


def is_shapes(layer) -> bool:
    """Whether this is a table of shapes."""
    return isinstance(layer, DataFrame) and any(c in layer.columns for c in SHAPE_COLUMNS)


def is_layer(layer) -> bool:
    return is_grid(layer) or is_shapes(layer)


def field_names(layer: DataFrame) -> list[str]:
    return list(layer.columns)


def has_field(layer, name: str) -> bool:
    """Whether a table of shapes has a column of this name; upper and lower case differ."""
    return is_shapes(layer) and name in layer.columns


def has_rows(layer) -> bool:
    """Whether a table of shapes has a row at least; reads no more than one."""
    return is_shapes(layer) and not layer.isEmpty()


def is_valid_path(spark: SparkSession, path: str | None, must_exist: bool = True) -> bool:
    """Whether a path is not blank and, if it must, exists in the store that Spark finds by its scheme."""
    if path is None or not path.strip():
        return False
    if not must_exist:
        return True
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def shape_type(wkb: Column) -> Column:
    """Type number of a well-known binary geometry (without its Z and M flags); null if it has none."""
    little = F.hex(F.substring(wkb, 1, 1)) == "01"
    at = lambda i: F.hex(F.substring(wkb, i, 1))
    digits = F.when(little, F.concat(at(5), at(4), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(4), at(5)))
    number = F.when(F.octet_length(wkb) >= 5, F.conv(digits, 16, 10).cast("long"))
    return (number.bitwiseAND(F.lit(0x0FFFFFFF)) % 1000).cast("int")


def is_point(wkb: Column) -> Column:
    return F.coalesce(shape_type(wkb).isin(*POINT), F.lit(False))


def is_line(wkb: Column) -> Column:
    return F.coalesce(shape_type(wkb).isin(*LINE), F.lit(False))


def is_polygon(wkb: Column) -> Column:
    return F.coalesce(shape_type(wkb).isin(*POLYGON), F.lit(False))


def views(spark: SparkSession, columns: tuple[str, ...] = ()) -> list[str]:
    """Names of all views that have these columns: ("r", "c", "z") finds grids, ("ring",) shapes."""
    names = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    return [n for n in names if set(columns) <= set(spark.table(n).columns)]


def view(spark: SparkSession, name: str, columns: tuple[str, ...] = ()) -> DataFrame | None:
    """The first view of that name that has these columns, or None."""
    found = [n for n in views(spark, columns) if n.lower() == name.lower()]
    return spark.table(found[0]) if found else None


def crs_of_code(code: int) -> str:
    if not 1024 <= int(code) <= 32767:
        raise ValueError(f"no EPSG code: {code}")
    return f"EPSG:{int(code)}"


def session_crs(spark: SparkSession) -> str | None:
    """The coordinate system that the setting ``crs`` names."""
    return settings.get_string(spark, "crs", None)


def crs_of(header: DataFrame) -> str | None:
    """The coordinate system in the first row of file headers."""
    row = header.select("crs").first()
    return row and row.crs

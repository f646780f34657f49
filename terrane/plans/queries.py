"""Queries over the derived grids, one for each operator, and the DuckDB SQL with the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import layers, wkb
from terrane.functions import predicates as P
from terrane.operators import diffusion, outliers, shapes, voids
from terrane.plans import outputs, screening, smoothing
from terrane.session import ensure_checkpoint_dir
from terrane.sources import geotiff
from terrane.sources.grids import NODATA, embedding_grid, event_grid, order_grid

GRIDS = {"g1": embedding_grid, "g2": event_grid, "g3": order_grid}
WIDTH = {"g1": 64, "g2": 30, "g3": 7}
EDGE = {"g1": 5.0, "g2": 10.0, "g3": 5000.0}
STRENGTH = 0.2
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- grids in SQL

_G1 = """g1 AS (SELECT r, c, CASE WHEN (r * 7 + c * 13) % 97 = 0 OR (r BETWEEN 100 AND 103 AND c BETWEEN 10 AND 19)
 OR (r BETWEEN 200 AND 219 AND c BETWEEN 20 AND 39) THEN CAST(-9999.0 AS DOUBLE) ELSE z END AS z
 FROM (SELECT vec_id AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) * 100 AS z FROM embeddings))"""
_G2 = """g2 AS (SELECT u.r, d.c, coalesce(f.z, CAST(-9999.0 AS DOUBLE)) AS z FROM (SELECT DISTINCT user_id AS r FROM events) u
 CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(30)) d
 LEFT JOIN (SELECT user_id AS r, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS c, max(value) AS z FROM events GROUP BY 1, 2) f
 ON f.r = u.r AND f.c = d.c)"""
_G3 = """g3 AS (SELECT u.r, d.c, coalesce(f.z, CAST(-9999.0 AS DOUBLE)) AS z FROM (SELECT CAST(range AS BIGINT) AS r FROM range((SELECT count(*) FROM orders))) u
 CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(7)) d
 LEFT JOIN (SELECT l_orderkey AS r, CAST(l_linenumber - 1 AS BIGINT) AS c, max(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2) f
 ON f.r = u.r AND f.c = d.c)"""
_WITH = {"g1": _G1, "g2": _G2, "g3": _G3}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _each(names, template: str | None = None, **more):
    """Register a query for each grid; ``{g}``, ``{grid}`` and the like stand for its name and SQL."""

    def add(f):
        for g in names:
            sql = template and template.format(g=g, grid=_WITH[g], width=WIDTH[g], k=EDGE[g], **more)
            _query(f.__name__.replace("_GRID", f"_{g}"), sql)(functools.partial(f, g))
        return f

    return add


# --- cells and voids


@_query("header_summary", f"WITH {_G1} SELECT CAST(max(c) + 1 AS BIGINT) AS width, CAST(max(r) + 1 AS BIGINT) AS height, count(*) AS cells FROM g1")
def header_summary(spark, d):
    return embedding_grid(spark, d).agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"), F.count("*").alias("cells"))


@_each(GRIDS, """WITH {grid} SELECT count(*) AS total_cells, count(*) FILTER (z = -9999.0) AS total_void_cells,
 round(100.0::DOUBLE * count(*) FILTER (z = -9999.0) / count(*), 6) AS void_pct FROM {g}""")
def void_detect_GRID(g, spark, d):
    n, v = F.count("*"), F.count_if(P.is_void(F.col("z"), NODATA))
    return GRIDS[g](spark, d).agg(n.alias("total_cells"), v.alias("total_void_cells"), F.round(v / n * 100, 6).alias("void_pct"))


@_query("void_mask_cells", f"WITH {_G2} SELECT r, c, z = -9999.0 AS void, CASE WHEN z <> -9999.0 THEN z END AS data FROM g2")
def void_mask_cells(spark, d):
    void = P.is_void(F.col("z"), NODATA)
    return event_grid(spark, d).select("r", "c", void.alias("void"), F.when(~void, F.col("z")).alias("data"))


@_each(["g1", "g3"], """WITH {grid} SELECT count(*) AS valid_cells, round(avg(z), 6) AS mean_elevation, round(median(z), 6) AS median_elevation
 FROM {g} WHERE z <> -9999.0 AND isfinite(z)""")
def valid_stats_GRID(g, spark, d):
    return smoothing.elevation_statistics(GRIDS[g](spark, d), NODATA).select(
        "valid_cells", F.round("mean_elevation", 6).alias("mean_elevation"), F.round("median_elevation", 6).alias("median_elevation")
    )


_RUNS = """runs AS (SELECT r, min(c) AS c0, max(c) AS c1 FROM (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS k
 FROM {g} WHERE z = -9999.0) GROUP BY r, k)"""


@_each(GRIDS, "WITH {grid}, " + _RUNS + " SELECT r, c0, c1 FROM runs")
def void_runs_GRID(g, spark, d):
    return voids.void_runs(GRIDS[g](spark, d), NODATA).select("r", "c0", "c1")


#: Regions by reachability from every run; each region's root is the least run that reaches it.
_REGIONS = _RUNS + """,
 node AS (SELECT r * {width} + c0 AS id, r, c0, c1 FROM runs),
 edge AS (SELECT a.id AS a, b.id AS b FROM node a JOIN node b ON b.r = a.r + 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
 both_ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
 reach AS (SELECT id AS root, id FROM node UNION SELECT reach.root, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.id WHERE reach.root < both_ways.b),
 member AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
 size AS (SELECT root, sum(c1 - c0 + 1) AS size_cells, min(r) AS row_min, max(r) AS row_max, min(c0) AS col_min, max(c1) AS col_max
  FROM member JOIN node USING (id) GROUP BY root),
 region AS (SELECT row_number() OVER (ORDER BY root) AS region_id, root, CAST(size_cells AS BIGINT) AS size_cells, row_min, row_max, col_min, col_max,
  CASE WHEN size_cells <= 10 THEN 1 WHEN size_cells <= 100 THEN 2 ELSE 3 END AS void_class FROM size),
 void_cell AS (SELECT r, unnest(range(c0, c1 + 1)) AS c, region_id, size_cells, void_class FROM node JOIN member USING (id) JOIN region USING (root))"""
_FILLS = """,
 fill AS (SELECT v.r, v.c, avg(n.z) AS fill FROM void_cell v JOIN {g} n ON n.r BETWEEN v.r - 1 AND v.r + 1 AND n.c BETWEEN v.c - 1 AND v.c + 1
  WHERE v.void_class = 1 AND n.z <> -9999.0 GROUP BY v.r, v.c),
 screened AS (SELECT g.r, g.c, coalesce(fill, g.z) AS z, CAST(CASE WHEN v.void_class IS NULL THEN 0 WHEN v.void_class = 1 AND fill IS NULL THEN 2
  ELSE v.void_class END AS SMALLINT) AS void_class FROM {g} g LEFT JOIN void_cell v ON v.r = g.r AND v.c = g.c LEFT JOIN fill f ON f.r = g.r AND f.c = g.c)"""


def _regions(g, spark, d):
    return voids.numbered_regions(voids.region_sizes(voids.region_parts(GRIDS[g](spark, d), NODATA, WIDTH[g])))


@_each(GRIDS, "WITH RECURSIVE {grid}, " + _REGIONS + " SELECT region_id, size_cells, row_min, row_max, col_min, col_max, CAST(void_class AS INTEGER) AS void_class FROM region")
def void_components_GRID(g, spark, d):
    return _regions(g, spark, d).select("region_id", "size_cells", "row_min", "row_max", "col_min", "col_max", "void_class")


@_each(GRIDS, "WITH RECURSIVE {grid}, " + _REGIONS + _FILLS + " SELECT r, c, void_class FROM screened")
def void_class_cells_GRID(g, spark, d):
    return screening.stage0(GRIDS[g](spark, d), NODATA, WIDTH[g]).screened.select("r", "c", "void_class")


@_each(GRIDS, "WITH RECURSIVE {grid}, " + _REGIONS + _FILLS + " SELECT void_class, count(*) AS cells FROM screened GROUP BY void_class")
def void_class_histogram_GRID(g, spark, d):
    return screening.stage0(GRIDS[g](spark, d), NODATA, WIDTH[g]).screened.groupBy("void_class").agg(F.count("*").alias("cells"))


@_each(GRIDS, "WITH RECURSIVE {grid}, " + _REGIONS + """ SELECT (SELECT count(*) FROM {g}) AS total_cells,
 (SELECT count(*) FROM {g} WHERE z = -9999.0) AS total_void_cells, count(*) AS regions,
 CAST(coalesce(sum(size_cells) FILTER (void_class = 1), 0) AS BIGINT) AS small_cells, CAST(coalesce(sum(size_cells) FILTER (void_class = 2), 0) AS BIGINT) AS medium_cells,
 CAST(coalesce(sum(size_cells) FILTER (void_class = 3), 0) AS BIGINT) AS large_cells, count(*) FILTER (void_class = 3) AS large_regions FROM region""")
def void_summary_GRID(g, spark, d):
    return screening.stage0(GRIDS[g](spark, d), NODATA, WIDTH[g]).summary.drop("grid_id", "void_pct")


@_query("large_void_regions", f"WITH RECURSIVE {_G1}, {_REGIONS.format(g='g1', width=64)} SELECT region_id, size_cells, row_min, row_max, col_min, col_max FROM region WHERE void_class = 3 ORDER BY region_id")
def large_void_regions(spark, d):
    return _regions("g1", spark, d).where("void_class = 3").orderBy("region_id").select(
        "region_id", "size_cells", "row_min", "row_max", "col_min", "col_max"
    )


@_each(GRIDS, "WITH RECURSIVE {grid}, " + _REGIONS + _FILLS + " SELECT r, c, round(z, 6) AS z FROM screened")
def void_fill_GRID(g, spark, d):
    return screening.stage0(GRIDS[g](spark, d), NODATA, WIDTH[g]).screened.select("r", "c", F.round("z", 6).alias("z"))


@_query("void_rollup", f"WITH {_G1}, {_G2}, a AS (SELECT 'g1' AS grid_id, z FROM g1 UNION ALL SELECT 'g2', z FROM g2) SELECT grid_id, void, count(*) AS cells FROM (SELECT grid_id, CASE WHEN z = -9999.0 THEN 'void' ELSE 'data' END AS void FROM a) GROUP BY ROLLUP (grid_id, void)")
def void_rollup(spark, d):
    both = embedding_grid(spark, d).withColumn("grid_id", F.lit("g1")).unionByName(event_grid(spark, d).withColumn("grid_id", F.lit("g2")))
    return both.withColumn("void", F.when(P.is_void(F.col("z"), NODATA), "void").otherwise("data")).rollup("grid_id", "void").agg(F.count("*").alias("cells"))


# --- windows

_GATHER = """gather AS (SELECT a.r, a.c, a.z, list_sort(list(b.z)) AS vals FROM {g} a JOIN {g} b ON b.r BETWEEN a.r - {h} AND a.r + {h}
 AND b.c BETWEEN a.c - {h} AND a.c + {h} WHERE b.z <> -9999.0 AND a.z <> -9999.0 GROUP BY a.r, a.c, a.z),
 med AS (SELECT r, c, z, vals, len(vals) AS n, (vals[(len(vals) + 1) // 2] + vals[len(vals) // 2 + 1]) / 2 AS med FROM gather),
 dev AS (SELECT r, c, z, n, med, list_sort([abs(x - med) FOR x IN vals]) AS devs FROM med),
 local AS (SELECT r, c, z, n, med, (devs[(n + 1) // 2] + devs[n // 2 + 1]) / 2 AS mad FROM dev)"""


def _windowed(w, tail):
    return "WITH {grid}, " + _GATHER.replace("{h}", str(w // 2)) + tail


for _w in (3, 5):

    @_each(["g2"], _windowed(_w, " SELECT r, c, CAST(n AS BIGINT) AS n, round(vals[1], 6) AS low, round(vals[n], 6) AS high FROM med"))
    def window_gather_GRID(g, spark, d, w=_w):
        cells = GRIDS[g](spark, d)
        data = cells.where(~P.is_void(F.col("z"), NODATA)).select("r", "c").join(outliers.window_values(cells, NODATA, w), ["r", "c"])
        return data.select("r", "c", F.size("vals").cast("long").alias("n"), F.round(F.array_min("vals"), 6).alias("low"), F.round(F.array_max("vals"), 6).alias("high"))

    _QUERIES[f"window_gather_{_w}_g2"], _SQL[f"window_gather_{_w}_g2"] = _QUERIES.pop("window_gather_g2"), _SQL.pop("window_gather_g2")

    @_each(["g1", "g2"], _windowed(_w, " SELECT r, c, round(med, 6) AS med, round(mad, 6) AS mad FROM local"))
    def local_mad_GRID(g, spark, d, w=_w):
        got = outliers.local_statistics(GRIDS[g](spark, d), NODATA, w)
        return got.select("r", "c", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))

    @_each(GRIDS, _windowed(_w, " SELECT r, c FROM local WHERE n >= 3 AND mad >= 1e-10 AND abs(z - med) / mad > 3.0"))
    def mad_artifacts_GRID(g, spark, d, w=_w):
        return outliers.flag_outliers(GRIDS[g](spark, d), NODATA, w).where("artifact = 1").select("r", "c")

    for _n, _g in (("local_mad", "g1"), ("local_mad", "g2"), ("mad_artifacts", "g1"), ("mad_artifacts", "g2"), ("mad_artifacts", "g3")):
        _QUERIES[f"{_n}_{_w}_{_g}"], _SQL[f"{_n}_{_w}_{_g}"] = _QUERIES.pop(f"{_n}_{_g}"), _SQL.pop(f"{_n}_{_g}")


@_query("local_median_3", ("WITH {grid}, " + _GATHER + " SELECT r, c, round(med, 6) AS med FROM local").format(g="g1", grid=_G1, h=1))
def local_median_3(spark, d):
    return outliers.local_statistics(embedding_grid(spark, d), NODATA).select("r", "c", F.round("med", 6).alias("med"))


@_each(["g1", "g2"], _windowed(3, """, rate AS (SELECT count(*) FILTER (n >= 3 AND mad >= 1e-10 AND abs(z - med) / mad > 3.0) AS cells_flagged, (SELECT count(*) FROM {g}) AS total FROM local)
 SELECT cells_flagged, round_even(cells_flagged / total * 100, 4) AS cells_flagged_pct,
 CASE WHEN cells_flagged = 0 THEN 'none' WHEN round_even(cells_flagged / total * 100, 4) < 0.1 THEN 'very_low' WHEN round_even(cells_flagged / total * 100, 4) < 1 THEN 'low'
 WHEN round_even(cells_flagged / total * 100, 4) < 5 THEN 'moderate' ELSE 'high' END AS band FROM rate"""))
def artifact_rate_GRID(g, spark, d):
    return screening.artifact_rate(outliers.flag_outliers(GRIDS[g](spark, d), NODATA)).select("cells_flagged", "cells_flagged_pct", "band")


# --- diffusion

_X = "x0 AS (SELECT r, c, z, CASE WHEN z <> -9999.0 AND isfinite(z) THEN z END AS x FROM {g})"


def _near(i):
    down, across = "(PARTITION BY c ORDER BY r)", "(PARTITION BY r ORDER BY c)"
    return (
        f"n{i} AS (SELECT r, c, z, x, lag(x) OVER {down} - x AS n, lead(x) OVER {down} - x AS s, lag(x) OVER {across} - x AS w, lead(x) OVER {across} - x AS e FROM x{i})"
    )


def _diffused(n):
    flow = lambda v: f"coalesce(exp(-pow(abs({v}) / {{k}}, 2)) * {v}, 0)"
    parts = [_X]
    for i in range(n):
        parts.append(_near(i))
        parts.append(f"x{i + 1} AS (SELECT r, c, z, x + 0.2::DOUBLE * ({flow('n')} + {flow('s')} + {flow('w')} + {flow('e')}) AS x FROM n{i})")
    return "WITH {grid}, " + ", ".join(parts) + f", smooth AS (SELECT r, c, z, coalesce(x, z) AS smoothed FROM x{n})"


@_query("neighbour_gradients", ("WITH {grid}, " + _X + ", " + _near(0) + " SELECT r, c, round(n, 6) AS n, round(s, 6) AS s, round(w, 6) AS w, round(e, 6) AS e FROM n0").format(g="g1", grid=_G1))
def neighbour_gradients(spark, d):
    x = embedding_grid(spark, d).select("r", "c", F.when(P.is_valid(F.col("z"), NODATA), F.col("z")).alias("x"))
    return diffusion.neighbours(x).select("r", "c", *[F.round(F.col(s) - F.col("x"), 6).alias(s) for s in "nswe"])


@_query("conductance", ("WITH {grid}, " + _X + ", " + _near(0) + " SELECT r, c, round(exp(-pow(abs(n) / 5.0, 2)), 6) AS n, round(exp(-pow(abs(e) / 5.0, 2)), 6) AS e FROM n0").format(g="g1", grid=_G1))
def conductance(spark, d):
    x = embedding_grid(spark, d).select("r", "c", F.when(P.is_valid(F.col("z"), NODATA), F.col("z")).alias("x"))
    near = diffusion.neighbours(x)
    return near.select("r", "c", *[F.round(F.exp(-F.pow(F.abs(F.col(s) - F.col("x")) / 5.0, F.lit(2.0))), 6).alias(s) for s in "ne"])


for _s in (1, 2, 5):

    @_each(["g1", "g2"], _diffused(_s) + " SELECT r, c, round(smoothed, 6) AS smoothed FROM smooth")
    def diffusion_GRID(g, spark, d, n=_s):
        return diffusion.diffuse(GRIDS[g](spark, d), NODATA, n, STRENGTH, EDGE[g]).select("r", "c", F.round("smoothed", 6).alias("smoothed"))

    for _g in ("g1", "g2"):
        _QUERIES[f"diffusion_{_s}_{_g}"], _SQL[f"diffusion_{_s}_{_g}"] = _QUERIES.pop(f"diffusion_{_g}"), _SQL.pop(f"diffusion_{_g}")


@_query("diffusion_5_g3", (_diffused(5) + " SELECT r, c, round(smoothed, 6) AS smoothed FROM smooth").format(g="g3", grid=_G3, k=EDGE["g3"]))
def diffusion_5_g3(spark, d):
    return diffusion.diffuse(order_grid(spark, d), NODATA, 5, STRENGTH, EDGE["g3"]).select("r", "c", F.round("smoothed", 6).alias("smoothed"))


_CHANGE = """, change AS (SELECT r, c, z, smoothed, CASE WHEN z <> -9999.0 AND isfinite(z) THEN smoothed - z ELSE 0 END AS diff,
 CASE WHEN NOT (z <> -9999.0 AND isfinite(z)) THEN 255 WHEN abs(smoothed - z) > {tol} THEN 1 ELSE 0 END AS changed FROM smooth)"""


def _changes(g, spark, d):
    return diffusion.difference(diffusion.diffuse(GRIDS[g](spark, d), NODATA, 5, STRENGTH, EDGE[g]), NODATA, P.change_tolerance(EDGE[g]))


@_query("smoothing_difference", (_diffused(5) + _CHANGE + " SELECT r, c, round(diff, 6) AS diff FROM change").format(g="g1", grid=_G1, k=5.0, tol="5e-9"))
def smoothing_difference(spark, d):
    return _changes("g1", spark, d).select("r", "c", F.round("diff", 6).alias("diff"))


@_query("smoothing_mask", (_diffused(5) + _CHANGE + " SELECT r, c, CAST(changed AS SMALLINT) AS changed FROM change").format(g="g1", grid=_G1, k=5.0, tol="5e-9"))
def smoothing_mask(spark, d):
    return _changes("g1", spark, d).select("r", "c", "changed")


for _g in GRIDS:

    @_each([_g], _diffused(5) + _CHANGE.replace("{tol}", str(P.change_tolerance(EDGE[_g]))) + """ SELECT count(*) FILTER (changed <> 255) AS valid_cells,
 count(*) FILTER (changed = 1) AS changed_cells, round(100.0::DOUBLE * count(*) FILTER (changed = 1) / count(*) FILTER (changed <> 255), 6) AS changed_percentage,
 round(max(abs(diff)) FILTER (changed <> 255), 6) AS maximum_absolute_change, round(avg(abs(diff)) FILTER (changed <> 255), 6) AS mean_absolute_change,
 round(min(diff) FILTER (changed <> 255), 6) AS minimum_change, round(max(diff) FILTER (changed <> 255), 6) AS maximum_change FROM change""")
    def smoothing_stats_GRID(g, spark, d):
        s = diffusion.change_statistics(_changes(g, spark, d))
        rounded = ["changed_percentage", "maximum_absolute_change", "mean_absolute_change", "minimum_change", "maximum_change"]
        return s.select("valid_cells", "changed_cells", *[F.round(c, 6).alias(c) for c in rounded])


# --- rules

def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query("resolution_scale", """SELECT p_partkey, CAST(x AS DOUBLE) AS res_x, CAST(y AS DOUBLE) AS res_y, round(CASE WHEN (x + y) / 2 <= 0 THEN 1.0::DOUBLE
 ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE / nullif((x + y) / 2, 0))) END, 6) AS factor
 FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 8 - 1 AS x, p_retailprice / 500 - 2 AS y FROM part)""")
def resolution_scale(spark, d):
    """Cells of many sizes, none and negative ones among them, made of the parts' sizes and prices."""
    rows = _table(spark, d, "part").select("p_partkey", (F.col("p_size") / 8.0 - 1).alias("res_x"), (F.col("p_retailprice") / 500 - 2).alias("res_y"))
    return rows.select("p_partkey", "res_x", "res_y", F.round(P.resolution_factor(F.col("res_x"), F.col("res_y")), 6).alias("factor"))


#: The kinds of sources once more, for the SQL.
_SOURCES = """(0, 'Auto-detect', NULL), (1, 'LiDAR bare-earth (DTM)', 0.15), (2, 'LiDAR surface model (DSM, uncorrected)', 0.4), (3, 'SRTM (30m / 90m)', 4.0),
 (4, 'Copernicus GLO-30', 4.0), (5, 'FABDEM / FathomDEM / GEDTM30', 1.5), (6, 'Aerial photogrammetry', 0.75), (7, 'Unknown / Other', 5.0)"""


@_query("source_rmse", f"""SELECT q.code, q.user_rmse, CAST(coalesce(CASE WHEN q.user_rmse > 0 THEN q.user_rmse END, t.rmse, 5.0) AS DOUBLE) AS rmse,
 CASE WHEN q.user_rmse > 0 THEN 'user' WHEN q.code = 0 THEN 'auto_default' ELSE 'source_type' END AS rmse_source
 FROM (SELECT CAST(c_custkey % 9 AS INTEGER) AS code, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal ELSE c_nationkey % 3 - 2 END AS user_rmse FROM customer) q
 LEFT JOIN (VALUES {_SOURCES}) AS t(code, label, rmse) ON t.code = q.code""")
def source_rmse(spark, d):
    """A request of each customer: a code by the key, one that is none among them; the balance, 0 or -1 as the user's figure."""
    third = F.col("c_nationkey") % 3
    asked = F.when(third == 0, F.col("c_acctbal")).otherwise((third - 2).cast("double"))
    asks = _table(spark, d, "customer").select((F.col("c_custkey") % 9).cast("int").alias("code"), asked.alias("user_rmse"))
    return P.with_rmse(asks, P.source_types(spark))


@_query("source_notes", f"""SELECT c_custkey, label, CASE WHEN code IN (1, 5) THEN 'bias_correction' WHEN code = 2 THEN 'lidar_ground_filter' ELSE 'none' END AS note
 FROM customer JOIN (VALUES {_SOURCES}) AS t(code, label, rmse) ON code = c_custkey % 9""")
def source_notes(spark, d):
    rows = _table(spark, d, "customer").withColumn("code", (F.col("c_custkey") % 9).cast("int"))
    return rows.join(F.broadcast(P.source_types(spark)), "code").select("c_custkey", "label", P.source_notes(F.col("code")).alias("note"))


@_query("next_steps", """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN large > 0 THEN 'treat_large_voids' END, CASE WHEN geo THEN 'reproject' END,
 CASE WHEN pct > 1 THEN 'review_artifacts' END, CASE WHEN large <= 0 AND pct <= 1 THEN 'passed' END) AS steps,
 CASE WHEN pct = 0 THEN 'none' WHEN pct < 0.1 THEN 'very_low' WHEN pct < 1 THEN 'low' WHEN pct < 5 THEN 'moderate' ELSE 'high' END AS band
 FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 2 AS large, l_discount > 0.05 AS geo, l_tax * l_quantity * 2 AS pct FROM lineitem)""")
def next_steps(spark, d):
    """Each line of an order as the outcome of a screening: large voids by its number, the rate of flags by tax and quantity."""
    large, geo, pct = F.col("l_linenumber") - 2, F.col("l_discount") > 0.05, F.col("l_tax") * F.col("l_quantity") * 2
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(P.next_steps(large, geo, pct), ",").alias("steps"), P.artifact_band(pct).alias("band"))


_TEXTS_AS_NUMBERS = """SELECT CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority WHEN 1 THEN ' ' || o_custkey || ' ' WHEN 2 THEN CAST(o_orderkey - 9 AS VARCHAR) WHEN 3 THEN repeat(' ', CAST(o_custkey % 4 AS INTEGER))
 WHEN 4 THEN NULL WHEN 5 THEN CAST(o_custkey * 37 AS VARCHAR) ELSE o_orderkey || '.' || o_custkey % 10 END AS v FROM orders"""


@_query("validation_truth_table", f"""SELECT v, v IS NOT NULL AS not_none, coalesce(regexp_matches(v, '\\S'), false) AS not_empty,
 coalesce(x > 0 AND NOT isnan(x), false) AS positive, coalesce(x BETWEEN 0 AND 10 AND NOT isnan(x), false) AS in_range,
 coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN trim(v) END AS BIGINT) BETWEEN 1024 AND 32767, false) AS epsg
 FROM (SELECT v, TRY_CAST(trim(v) AS DOUBLE) AS x FROM ({_TEXTS_AS_NUMBERS}))""")
def validation_truth_table(spark, d):
    """Words, blanks, nothing, whole and broken numbers as texts, one of each order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    kinds = [
        F.col("o_orderpriority"), F.concat(F.lit(" "), text(customer), F.lit(" ")), text(key - 9), F.repeat(F.lit(" "), (customer % 4).cast("int")), F.lit(None).cast("string"),
        text(customer * 37), F.concat(text(key), F.lit("."), text(customer % 10)),
    ]
    v = F.col("v")
    return _table(spark, d, "orders").select(F.get(F.array(*kinds), (key % 7).cast("int")).alias("v")).select(
        "v", P.is_not_none(v).alias("not_none"), P.is_not_empty_string(v).alias("not_empty"), P.is_positive_number(v).alias("positive"),
        P.is_in_range(v, F.lit(0), F.lit(10)).alias("in_range"), P.is_valid_epsg(v).alias("epsg"),
    )


@_query("validation_of_numbers", """SELECT event_id, v > 0 AS positive, v BETWEEN 0 AND 10 AS in_range, trunc(v) BETWEEN 1024 AND 32767 AS epsg
 FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value * 60 ELSE value / 10 - 5 END AS v FROM events)""")
def validation_of_numbers(spark, d):
    third = F.col("event_id") % 3
    v = F.when(third == 0, F.col("value")).when(third == 1, F.col("value") * 60).otherwise(F.col("value") / 10 - 5)
    return _table(spark, d, "events").select(
        "event_id", P.is_positive_number(v).alias("positive"), P.is_in_range(v, F.lit(0), F.lit(10)).alias("in_range"), P.is_valid_epsg(v).alias("epsg")
    )


_CHECKED = ("nation", "documents", "embeddings", "conversations")


@_query("field_names", f"""SELECT table_name, column_name, column_name IN ('doc_id', 'n_name') AS wanted FROM information_schema.columns
 WHERE table_name IN {_CHECKED!r} AND table_schema = 'main'""")
def field_names(spark, d):
    rows = [(t, c, c in ("doc_id", "n_name")) for t in _CHECKED for c in layers.field_names(spark.read.parquet(f"{d}/{t}.parquet"))]
    return spark.createDataFrame(rows, "table_name string, column_name string, wanted boolean")


@_query("shape_kinds", """SELECT s_suppkey, k IN (1, 4) AS point, k IN (2, 5) AS line, k IN (3, 6) AS polygon FROM (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier)""")
def shape_kinds(spark, d):
    """The head of well-known binary for each supplier, of all kinds, either byte order, with Z and M and without."""
    key = F.col("s_suppkey")
    kind = F.format_string("%08X", key % 8 + (key / 8).cast("long") % 4 * 1000)
    turned = F.concat(*[F.substring(kind, i, 2) for i in (7, 5, 3, 1)])
    head = F.unhex(F.when(key % 3 == 0, F.concat(F.lit("00"), kind)).otherwise(F.concat(F.lit("01"), turned)))
    return _table(spark, d, "supplier").select("s_suppkey", layers.is_point(head).alias("point"), layers.is_line(head).alias("line"), layers.is_polygon(head).alias("polygon"))


def _box(x, y, side):
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("m"))
    zero = F.lit(0.0)
    return F.array(corner(zero, zero), corner(side, zero), corner(side, side), corner(zero, side), corner(zero, zero))


def _parcels(spark, d):
    """For each supplier two squares by its key, the first with a hole, at a place by its nation; stored as well-known binary."""
    key = F.col("s_suppkey").cast("double")
    x, y, side, hole = F.col("s_nationkey") * 100.0, key * 3, key % 7 + 5, key % 3 + 1
    parts = F.array(F.array(_box(x, y, side), _box(x + 1, y + 1, hole)), F.array(_box(x + key % 5 * 5, y + key % 2, key % 4 + 1)))
    shape = F.struct(F.lit(wkb.MULTI_POLYGON).alias("kind"), F.lit(False).alias("z"), F.lit(False).alias("m"), parts.alias("parts"), F.array().cast("array<binary>").alias("members"))
    return _table(spark, d, "supplier").select("s_suppkey", wkb.encode(shape).alias("geometry"))


@_query("shape_areas", """SELECT s_suppkey, round(a * a - b * b + c * c, 6) AS area, round(4 * (a + b + c), 6) AS length, 15 AS points
 FROM (SELECT s_suppkey, CAST(s_suppkey % 7 + 5 AS DOUBLE) AS a, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS b, CAST(s_suppkey % 4 + 1 AS DOUBLE) AS c FROM supplier)""")
def shape_areas(spark, d):
    shape = F.col("shape")
    found = _parcels(spark, d).select("s_suppkey", wkb.decode(F.col("geometry")).alias("shape"))
    return found.select("s_suppkey", F.round(wkb.area(shape), 6).alias("area"), F.round(wkb.length(shape), 6).alias("length"), wkb.n_points(shape).alias("points"))


@_query("shape_validity", """SELECT s_suppkey, g > a AS valid, CASE WHEN g <= a THEN CASE WHEN o = 1 AND g > 0 AND g + c < a AND 1 + c < a THEN 'parts overlap' ELSE 'rings cross' END END AS reason
 FROM (SELECT s_suppkey, s_suppkey % 5 * 5 AS g, s_suppkey % 7 + 5 AS a, s_suppkey % 4 + 1 AS c, s_suppkey % 2 AS o FROM supplier)""")
def shape_validity(spark, d):
    """The second square lies beside the first, along or across its sides, or within."""
    return shapes.validity(_parcels(spark, d).select("s_suppkey", wkb.decode(F.col("geometry")).alias("shape")), "s_suppkey", "shape")


@_query("grid_file_window", f"WITH {_G2} SELECT r, c, round(z, 6) AS z FROM g2 WHERE r BETWEEN 5 AND 300 AND c >= 3 AND c < 9")
def grid_file_window(spark, d):
    """The grid as a mosaic of files in the shared folder, of which a window is read back: filters reach files and blocks."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/grid-{uuid.uuid4()}"
    folder = folder.removeprefix("file:")
    geotiff.write_tiles(event_grid(spark, d), folder, "g2", nodata=NODATA, tile=64)
    tile = F.regexp_extract("grid_id", r"_(\d+)_(\d+)\.tif$", 1).cast("long"), F.regexp_extract("grid_id", r"_(\d+)_(\d+)\.tif$", 2).cast("long")
    cells = geotiff.read_cells(spark, folder).where("c < 9").select((tile[0] * 64 + F.col("r")).alias("r"), (tile[1] * 64 + F.col("c")).alias("c"), F.round("z", 6).alias("z"))
    return cells.where("r between 5 and 300 and c >= 3 and c < 9")


# --- outputs as they are stored


def _screened(spark, d):
    return screening.screen(embedding_grid(spark, d), screening.Header(64, 0, NODATA, name="g1"), screening.Parameters())


def _smoothed(spark, d):
    return smoothing.smooth(embedding_grid(spark, d), smoothing.Parameters(edge_threshold=5.0, resolution_scale=False), NODATA, 1.0, 1.0, "g1")


_G1_REGIONS = "WITH RECURSIVE {grid}, ".format(grid=_G1) + (_REGIONS + _FILLS).format(g="g1", width=64)
_G1_LOCAL = "WITH {grid}, ".format(grid=_G1) + _GATHER.format(g="g1", h=1)
_G1_CHANGE = (_diffused(5) + _CHANGE).format(g="g1", grid=_G1, k=5.0, tol="5e-9")


@_query("sink_screened", _G1_REGIONS + " SELECT r, c, round(CAST(z AS DOUBLE), 6) AS value FROM screened")
def sink_screened(spark, d):
    return outputs.recoded(_screened(spark, d), "screened", "screening").withColumn("value", F.round("value", 6))


@_query("sink_void_mask", _G1_REGIONS + " SELECT r, c, void_class AS value FROM screened")
def sink_void_mask(spark, d):
    return outputs.recoded(_screened(spark, d), "void_mask", "screening")


@_query("sink_artifact_mask", _G1_LOCAL + """ SELECT g1.r, g1.c, CAST(coalesce(n >= 3 AND mad >= 1e-10 AND abs(local.z - med) / mad > 3.0, false) AS SMALLINT) AS value
 FROM g1 LEFT JOIN local ON local.r = g1.r AND local.c = g1.c""")
def sink_artifact_mask(spark, d):
    return outputs.recoded(_screened(spark, d), "artifacts", "screening")


@_query("sink_smoothed", _G1_CHANGE + " SELECT r, c, round(CAST(CAST(smoothed AS FLOAT) AS DOUBLE), 3) AS value FROM change")
def sink_smoothed(spark, d):
    return outputs.recoded(_smoothed(spark, d), "smoothed", "smoothing").withColumn("value", F.round(F.col("value").cast("double"), 3))


@_query("sink_difference", _G1_CHANGE + " SELECT r, c, round(CAST(CAST(CASE WHEN changed = 255 THEN -9999.0 ELSE diff END AS FLOAT) AS DOUBLE), 3) AS value FROM change")
def sink_difference(spark, d):
    return outputs.recoded(_smoothed(spark, d), "difference", "smoothing").withColumn("value", F.round(F.col("value").cast("double"), 3))


@_query("sink_smoothing_mask", _G1_CHANGE + " SELECT r, c, CAST(changed AS SMALLINT) AS value FROM change")
def sink_smoothing_mask(spark, d):
    return outputs.recoded(_smoothed(spark, d), "mask", "smoothing")


@_query("void_split", f"""WITH {_G1} SELECT side, count(*) AS cells, CAST(sum(c) AS BIGINT) AS columns FROM (SELECT c, CASE WHEN z = -9999.0 THEN 'void' ELSE 'data' END AS side FROM g1)
 GROUP BY side""")
def void_split(spark, d):
    """Cells that lie in a run of voids and those that do not, by a semi and an anti join."""
    cells = embedding_grid(spark, d)
    inside = voids.void_runs(cells, NODATA).select("r", F.explode(F.sequence("c0", "c1")).alias("c"))
    parts = [cells.join(inside, ["r", "c"], how).withColumn("side", F.lit(side)) for how, side in (("left_semi", "void"), ("left_anti", "data"))]
    return parts[0].union(parts[1]).groupBy("side").agg(F.count("*").alias("cells"), F.sum("c").alias("columns"))


# --- whole tools


@_query("provenance_json", "WITH RECURSIVE {grid}, ".format(grid=_G1) + (_REGIONS + ", " + _GATHER).format(g="g1", width=64, h=1) + """
 SELECT (SELECT count(*) FROM g1 WHERE z = -9999.0) AS total_void_cells, CAST((SELECT sum(size_cells) FROM region WHERE void_class = 1) AS BIGINT) AS small_interpolated,
 CAST((SELECT sum(size_cells) FROM region WHERE void_class = 2) AS BIGINT) AS medium_flagged, CAST((SELECT sum(size_cells) FROM region WHERE void_class = 3) AS BIGINT) AS large_reported,
 (SELECT count(*) FROM local WHERE n >= 3 AND mad >= 1e-10 AND abs(z - med) / mad > 3.0) AS cells_flagged""")
def provenance_json(spark, d):
    done = screening.screen(embedding_grid(spark, d), screening.Header(64, 0, NODATA), screening.Parameters())
    doc = F.from_json(
        "provenance",
        "stage_0 struct<void_summary:struct<total_void_cells:bigint,small_interpolated:bigint,medium_flagged:bigint,large_reported:bigint>>,"
        "stage_1 struct<mad_filter:struct<cells_flagged:bigint>>",
    )
    return done["provenance"].select(doc.alias("p")).select("p.stage_0.void_summary.*", "p.stage_1.mad_filter.cells_flagged")


_SCREENING_LINES = """, s AS (SELECT (SELECT count(*) FROM g1) AS cells, (SELECT count(*) FROM g1 WHERE z = -9999.0) AS void_cells, (SELECT count(*) FROM region) AS regions,
 (SELECT coalesce(sum(size_cells), 0) FROM region WHERE void_class = 1) AS small, (SELECT coalesce(sum(size_cells), 0) FROM region WHERE void_class = 2) AS medium,
 (SELECT coalesce(sum(size_cells), 0) FROM region WHERE void_class = 3) AS large, (SELECT count(*) FROM region WHERE void_class = 3) AS larges,
 (SELECT count(*) FROM local WHERE n >= 3 AND mad >= 1e-10 AND abs(z - med) / mad > 3.0) AS flagged),
 line AS (SELECT 10 AS part, 0 AS k, printf('  void cells: %d (%.4f %%) in %d regions', void_cells, 100.0::DOUBLE * void_cells / cells, regions) AS line FROM s
 UNION ALL SELECT 11, 0, printf('  in small regions, filled where possible: %d', CAST(small AS BIGINT)) FROM s UNION ALL SELECT 12, 0, printf('  in medium regions, flagged: %d', CAST(medium AS BIGINT)) FROM s
 UNION ALL SELECT 13, 0, printf('  in large regions, reported: %d', CAST(large AS BIGINT)) FROM s UNION ALL SELECT 14, 0, printf('LARGE REGIONS: %d', larges) FROM s WHERE larges > 0
 UNION ALL SELECT 15, region_id, printf('  region %d: %d cells, rows %d to %d, columns %d to %d', region_id, size_cells, row_min, row_max, col_min, col_max) FROM region WHERE void_class = 3
 UNION ALL SELECT 17, 0, printf('  flagged: %d (%.4f %% of all cells), rate: %s', flagged, round_even(flagged / cells * 100, 4),
  CASE WHEN flagged = 0 THEN 'none' WHEN 100.0 * flagged / cells < 0.1 THEN 'very_low' WHEN 100.0 * flagged / cells < 1 THEN 'low' WHEN 100.0 * flagged / cells < 5 THEN 'moderate' ELSE 'high' END) FROM s)
 SELECT row_number() OVER (ORDER BY part, k) AS nth, line FROM line"""


@_query("screening_report", "WITH RECURSIVE {grid}, ".format(grid=_G1) + (_REGIONS + ", " + _GATHER).format(g="g1", width=64, h=1) + _SCREENING_LINES)
def screening_report(spark, d):
    """The lines of the report that hold numbers."""
    lines = _screened(spark, d)["report"].where(r"line rlike '^(  (void cells|in (small|medium|large) regions|region \\d+|flagged):?)|^LARGE'")
    return lines.select(F.row_number().over(Window.orderBy("line_no")).cast("long").alias("nth"), "line")


@_query("smoothing_report", _G1_CHANGE + """, s AS (SELECT count(*) AS valid, count(*) FILTER (changed = 1) AS moved, avg(z) AS mean, median(z) AS median, max(abs(diff)) AS largest,
 avg(abs(diff)) AS mean_change, min(diff) AS low, max(diff) AS high FROM change WHERE changed <> 255),
 line AS (SELECT 1 AS nth, printf('  valid cells: %d, mean %.4f, median %.4f', valid, mean, median) AS line FROM s
 UNION ALL SELECT 2, '  effective strength: 0.200000, scale factor 1.000000' UNION ALL SELECT 3, printf('  changed: %d (%.4f %% of valid cells)', moved, 100.0::DOUBLE * moved / valid) FROM s
 UNION ALL SELECT 4, printf('  largest change: %.6f, mean %.6f', largest, mean_change) FROM s UNION ALL SELECT 5, printf('  range of change: %.6f to %.6f', low, high) FROM s)
 SELECT CAST(nth AS BIGINT) AS nth, line FROM line""")
def smoothing_report(spark, d):
    """The lines of the report that hold numbers."""
    lines = _smoothed(spark, d)["report"].where("line rlike '^  (valid cells|effective|changed|largest change|range)'")
    return lines.select(F.row_number().over(Window.orderBy("line_no")).cast("long").alias("nth"), "line")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

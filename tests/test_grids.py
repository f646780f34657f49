"""Small grids whose results are known by hand, and properties that hold on any grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry, layers
from terrane.functions import predicates as P
from terrane.operators import diffusion, graph, outliers, voids
from terrane.plans import outputs, registry, screening, settings, smoothing
from terrane.plans.text import wrapped
from terrane.sources import files, geotiff
from terrane.streaming import landing

NODATA = -9999.0


def grid(spark, values):
    rows = [(r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "r long, c long, z double")


def test_one_spike_is_flagged(spark):
    z = [[r + c for c in range(5)] for r in range(5)]
    z[2][2] = 100
    flagged = outliers.flag_outliers(grid(spark, z), NODATA).where("artifact = 1").select("r", "c").collect()
    assert [tuple(x) for x in flagged] == [(2, 2)]


def test_single_voids_are_filled(spark):
    z = [[r + c for c in range(6)] for r in range(6)]
    for r, c in ((0, 0), (2, 2), (3, 3), (4, 5)):
        z[r][c] = NODATA
    found = screening.stage0(grid(spark, z), NODATA, 6, small=1, large=2)
    got = {(x.r, x.c): x.z for x in found.screened.where("void_class = 1").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(0, 0): round(4 / 3, 9), (2, 2): round(26 / 7, 9), (3, 3): round(44 / 7, 9), (4, 5): 8.4}
    assert found.summary.first().regions == 4


def test_a_void_without_neighbours_stays(spark):
    z = np.zeros((5, 5))
    z[1:4, 1:4] = NODATA
    found = screening.stage0(grid(spark, z), NODATA, 5, small=9, large=10)
    cells = {(x.r, x.c): (x.z, x.void_class) for x in found.screened.collect()}
    assert cells[2, 2] == (NODATA, P.MEDIUM) and cells[1, 1] == (0.0, P.SMALL) and cells[0, 0] == (0.0, P.VALID)
    s = found.summary.first()
    assert (s.small_cells, s.medium_cells, s.large_cells) == (9, 0, 0)


@pytest.mark.parametrize(
    ("values", "k", "want"),
    [
        ([[0, 1, 0]], 1.0, [[0.07357588823428847, 0.8528482235314231, 0.07357588823428847]]),
        ([[0, NODATA, 10], [1, 2, 3]], 2.0, [[0.155760156614281, NODATA, 9.999993300835651], [1.0, 2.0, 2.844246542550068]]),
    ],
)
def test_one_step_of_diffusion(spark, values, k, want):
    for how in (diffusion.diffuse, diffusion.diffuse_by_windows):
        got = {(x.r, x.c): x.smoothed for x in how(grid(spark, values), NODATA, 1, 0.2, k).collect()}
        assert all(abs(got[r, c] - v) < 1e-12 for r, line in enumerate(want) for c, v in enumerate(line))


def test_diffusion_keeps_sum_and_bounds_for_any_tile(spark):
    rng = np.random.RandomState(1)
    z = rng.normal(0, 5, (23, 17))
    z[rng.rand(23, 17) < 0.1] = NODATA
    cells = grid(spark, z).cache()
    valid = z[z != NODATA]
    seen = []
    for tile in (5, 8, 256):
        got = diffusion.diffuse(cells, NODATA, 20, 0.25, 4.0, tile).where(F.col("z") != NODATA).orderBy("r", "c").collect()
        x = np.array([r.smoothed for r in got])
        assert abs(x.sum() - valid.sum()) < 1e-9 and x.min() >= valid.min() and x.max() <= valid.max()
        seen.append(x)
    assert (seen[0] == seen[1]).all() and (seen[0] == seen[2]).all()


def test_a_constant_grid_does_not_change(spark):
    cells = grid(spark, np.full((6, 6), 7.0))
    assert outliers.flag_outliers(cells, NODATA, 5).where("artifact = 1").count() == 0
    assert diffusion.diffuse(cells, NODATA, 3).where("smoothed <> 7.0").count() == 0


def test_flags_do_not_depend_on_shift_scale_or_tile(spark):
    z = np.random.RandomState(2).normal(0, 1, (20, 20)).round(3)
    flags = lambda v, tile=256: {(x.r, x.c) for x in outliers.flag_outliers(grid(spark, v), NODATA, tile=tile).where("artifact = 1").collect()}
    want = flags(z)
    assert want == flags(z * 4) == flags(z + 8) == flags(z, 6)


def test_nan_and_infinite_cells(spark):
    z = np.arange(25.0).reshape(5, 5)
    z[1, 1], z[3, 3] = np.inf, np.nan
    flagged = {(x.r, x.c) for x in outliers.flag_outliers(grid(spark, z), NODATA).where("artifact = 1").collect()}
    assert (1, 1) in flagged and (3, 3) not in flagged
    seen = grid(spark, z).select(F.count_if(P.is_void(F.col("z"), None)).alias("none"), F.count_if(P.is_void(F.col("z"), float("nan"))).alias("nan")).first()
    assert tuple(seen) == (2, 0)


def test_components_of_long_chains_and_empty_graphs(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5), (2000, 2001), (2000, 2001)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1002] == 1000 and got[2001] == 2000 and len(got) == 306
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parameters_are_checked(spark):
    assert P.check_screening(10, 100, 4, 3.0) == 5
    for bad in ((100, 100, 3, 3.0), (10, 100, 0, 3.0)):
        with pytest.raises(ValueError):
            P.check_screening(*bad)
    for bad in ((0, 0.2, 1.0), (1, 0.3, 1.0), (1, 0.0, 1.0), (1, 0.2, 0.0)):
        with pytest.raises(ValueError):
            P.check_smoothing(*bad)
    with pytest.raises(ValueError):
        smoothing.smooth(grid(spark, [[NODATA]]), smoothing.Parameters(), NODATA, 1.0, 1.0)


def test_registry_settings_and_messages(spark):
    reg = registry.default_registry()
    assert [len(g.operators) for g in reg.groups()] == [2, 0] and not reg.register(registry.Group("hydrology", "again"))
    out = reg.run("hydrology:screening", grid(spark, np.arange(36.0).reshape(6, 6)), screening.Header(6, 6, NODATA))
    assert out["report"].count() > 10
    with pytest.raises(KeyError):
        reg.run("hydrology:none")
    heard, bus = [], registry.Messages()
    bus.subscribe("a", heard.append)
    bus.publish("a", 1)
    bus.publish("b", 2)
    bus.unsubscribe("a", heard.append) if heard.append in bus._topics["a"] else None
    with pytest.raises(ValueError):
        bus.unsubscribe("a", print)
    assert heard == [1]
    settings.put(spark, "x", "yes")
    assert settings.get_bool(spark, "x") and settings.get_int(spark, "x", 3) == 3 and settings.get_float(spark, "none", 1.5) == 1.5
    settings.clear(spark)
    assert not settings.exists(spark, "x")


def test_geometry(spark):
    ring = "array(struct(18D as x, -34D as y), struct(19D as x, -34D as y), struct(19D as x, -33D as y), struct(18D as x, -33D as y), struct(18D as x, -34D as y)) as ring"
    df = spark.range(1).selectExpr(ring)
    row = df.select(geometry.area(F.col("ring")), geometry.length(F.col("ring")), geometry.is_valid_ring(F.col("ring"))).first()
    assert tuple(row) == (1.0, 4.0, True)
    there = df.select(geometry.to_web_mercator(F.lit(18.5), F.lit(-33.5)).alias("p")).select(geometry.from_web_mercator(F.col("p.x"), F.col("p.y")).alias("q")).first().q
    assert abs(there.x - 18.5) < 1e-9 and abs(there.y + 33.5) < 1e-9


def test_rings(spark):
    rings = {
        "square": ([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], True), "concave": ([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)], True),
        "twice the same point": ([(0, 0), (1, 0), (1, 0), (1, 1), (0, 0)], True), "corner on a straight side": ([(0, 0), (1, 0), (2, 0), (2, 2), (0, 0)], True),
        "bow tie": ([(0, 0), (2, 2), (2, 0), (0, 3), (0, 0)], False), "spike": ([(0, 0), (2, 0), (2, 2), (2, 5), (2, 2), (0, 2), (0, 0)], False),
        "touches itself": ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)], False), "open": ([(0, 0), (1, 0), (1, 1), (0, 1)], False),
        "no area": ([(0, 0), (1, 1), (2, 2), (0, 0)], False), "short": ([(0, 0), (1, 1), (0, 0)], False), "null": (None, False),
    }
    rows = [(name, points and [(float(x), float(y)) for x, y in points]) for name, (points, _) in rings.items()]
    df = spark.createDataFrame(rows, "name string, ring array<struct<x:double,y:double>>")
    assert {r.name: r.ok for r in df.select("name", geometry.is_valid_ring(F.col("ring")).alias("ok")).collect()} == {k: v for k, (_, v) in rings.items()}


@pytest.mark.parametrize("compression", [geotiff.NONE, geotiff.LZW, geotiff.DEFLATE])
@pytest.mark.parametrize("dtype", ["float32", "float64", "int16", "uint8"])
def test_geotiff_round_trip(dtype, compression):
    z = (np.random.RandomState(3).rand(70, 45) * 200).astype(dtype)
    tiff = geotiff.Tiff(geotiff.encode(z, 255.0, (2.0, 3.0), (10.0, 20.0), 32734, False, compression))
    back = np.zeros(z.shape)
    for r, c, block in tiff.blocks():
        back[r : r + block.shape[0], c : c + block.shape[1]] = block
    head = tiff.header()
    assert (back == z).all() and head["crs"] == "EPSG:32734" and not head["crs_is_geographic"] and head["nodata"] == 255.0
    assert (head["res_x"], head["res_y"], head["left"], head["top"], head["width"], head["height"]) == (2.0, 3.0, 10.0, 20.0, 45, 70)


def test_geotiff_files(spark, tmp_path):
    z = np.arange(600.0).reshape(30, 20)
    geotiff.write_tiles(grid(spark, z), str(tmp_path / "out"), "dem", tile=16, nodata=NODATA)
    assert len(list((tmp_path / "out").glob("dem_*.tif"))) == 4
    assert geotiff.read_cells(spark, str(tmp_path / "out")).agg(F.count("*"), F.sum("z")).first() == (600, z.sum())
    assert geotiff.read_headers(spark, str(tmp_path / "out")).agg(F.sum(F.col("width") * F.col("height"))).first()[0] == 600


def test_small_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": [1, 2]}')
    (tmp_path / "bad.json").write_text("{nothing")
    (tmp_path / "a.csv").write_text("x,y\n1,02\n")
    assert files.read_json(spark, str(tmp_path / "a.json")).first().a == [1, 2]
    assert files.read_json(spark, str(tmp_path / "none.json")) is None and files.read_csv(spark, str(tmp_path / "none.csv")) is None
    assert tuple(files.read_csv(spark, str(tmp_path / "a.csv")).first()) == ("1", "02")
    ring = spark.range(1).selectExpr("id", "array(struct(0D as x, 0D as y)) as ring")
    assert files.write_vector(ring, str(tmp_path / "v.geojson")) and files.write_vector(ring, str(tmp_path / "v.other"))
    assert not files.write_vector(ring, "nostore://x/v.csv")
    with pytest.raises(ValueError):
        files.write_vector(ring, str(tmp_path / "v.gpkg"))
    assert files.output_names("/x/dem.tif", files.SCREENING_OUTPUTS)["screened"] == "dem_screened"
    assert files.load_views({"mask": ring}, "dem") == ["dem_mask"] and "dem_mask" in layers.views(spark, ("ring",))


def test_layers(spark, tmp_path):
    cells, shapes = grid(spark, [[1.0]]), spark.range(1).selectExpr("id", "array(struct(0D as x, 0D as y)) as ring")
    assert layers.is_grid(cells) and not layers.is_grid(shapes) and not layers.is_grid(None) and not layers.is_grid("cells")
    assert layers.is_shapes(shapes) and not layers.is_shapes(cells) and layers.is_layer(cells) and not layers.is_layer(spark.range(1))
    assert layers.has_rows(shapes) and not layers.has_rows(shapes.limit(0)) and not layers.has_rows(cells) and not layers.has_rows(None)
    assert layers.has_field(shapes, "ring") and not layers.has_field(shapes, "Ring") and not layers.has_field(None, "ring")
    assert layers.field_names(cells) == ["r", "c", "z"]
    missing = str(tmp_path / "none")
    assert layers.is_valid_path(spark, str(tmp_path)) and not layers.is_valid_path(spark, missing) and layers.is_valid_path(spark, missing, False)
    assert not any(layers.is_valid_path(spark, p, must) for p in ("", "  ", None) for must in (True, False))
    cells.createOrReplaceTempView("some_cells")
    assert layers.view(spark, "some_cells", ("z",)).columns == ["r", "c", "z"] and layers.view(spark, "some_cells", ("ring",)) is None
    assert layers.view(spark, "no_such_view") is None
    assert layers.crs_of_code(4326) == "EPSG:4326" and layers.session_crs(spark) is None
    with pytest.raises(ValueError):
        layers.crs_of_code(7)
    settings.put(spark, "crs", "EPSG:4326")
    assert layers.session_crs(spark) == "EPSG:4326" and settings.get_string(spark, "crs") == "EPSG:4326" and settings.keys(spark) == ["crs"]
    settings.put(spark, "n", "many")
    assert settings.get_int(spark, "n", 4) == 4 and settings.get_string(spark, "none", "x") == "x"
    settings.clear(spark)


def test_wrapped_lines(spark):
    import textwrap

    texts = ["", "one", "a b " * 40, "x" * 100 + " y", "word " * 13 + "end", "  many   blanks \n here  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", wrapped(F.col("t")).alias("w")).collect()
    for r in got:
        assert r.w == (textwrap.wrap(" ".join(r.t.split()), 68, break_long_words=False) or [""])


def test_jobs_of_a_tool_can_be_cancelled(spark):
    import threading
    import time

    def slow(rows):
        for x in rows:
            time.sleep(60)
            yield x

    failed = []

    def work():
        try:
            with registry.tagged(spark, "hydrology:screening"):
                spark.sparkContext.parallelize(range(2), 2).mapPartitions(slow).count()
        except Exception as e:
            failed.append(e)

    from pyspark import InheritableThread

    thread = InheritableThread(target=work)
    thread.start()
    for _ in range(40):
        time.sleep(0.5)
        registry.cancel(spark, "hydrology:screening")
        if not thread.is_alive():
            break
    thread.join(70)
    assert failed and threading.active_count() >= 1


def test_components_of_tiles(spark):
    """Any size of the tiles gives the same regions, also where a region goes to and fro through several."""
    rng = np.random.RandomState(5)
    z = rng.rand(60, 40)
    z[z < 0.55] = NODATA
    z[::2, 0] = z[:, 5] = NODATA
    cells = grid(spark, z).cache()
    seen = []
    for tile in (1, 3, 16, 512):
        got = voids.void_regions(cells, NODATA, 40, tile).select("r", "c0", "c1", "root").collect()
        seen.append({(x.r, c): x.root for x in got for c in range(x.c0, x.c1 + 1)})
    label = {}  # flood fill
    for r in range(60):
        for c in range(40):
            if z[r, c] == NODATA and (r, c) not in label:
                stack, label[r, c] = [(r, c)], r * 40 + c
                while stack:
                    y, x = stack.pop()
                    for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= a < 60 and 0 <= b < 40 and z[a, b] == NODATA and (a, b) not in label:
                            label[a, b] = r * 40 + c
                            stack.append((a, b))
    assert all(x == label for x in seen)


def test_tile_kernels_are_the_windows(spark):
    rng = np.random.RandomState(7)
    z = rng.normal(0, 5, (25, 19))
    z[rng.rand(25, 19) < 0.2] = NODATA
    z[3, 3] = np.inf
    cells = grid(spark, z).cache()
    for window in (3, 5):
        rows = outliers.local_statistics_by_rows(cells, NODATA, window).select("r", "c", "z", "n", "med", "mad").collect()
        tiles = outliers.local_statistics(cells, NODATA, window, 8).collect()
        want, got = ({(x.r, x.c): (x.n, round(x.med, 9)) for x in part} for part in (rows, tiles))
        assert got == want
    x = cells.select("r", "c", F.when(P.is_valid(F.col("z"), NODATA), F.col("z")).alias("x"))
    assert sorted(map(str, diffusion.neighbours(x, tile=8).collect())) == sorted(map(str, diffusion.neighbours_by_windows(x).collect()))


@pytest.mark.parametrize("parts", [2, 7, 4096])
def test_median_by_narrowing(spark, monkeypatch, parts):
    """Ties, two values, one value, numbers of all sizes, infinite and missing ones; an even and an odd number of cells."""
    rng = np.random.RandomState(1)
    grids = {
        "a": rng.normal(0, 1, 3001), "b": np.repeat(7.0, 500), "c": np.append(np.zeros(900), rng.rand(300)), "d": np.array([1.0, 4.0]), "e": np.array([5.0]),
        "f": np.append(np.repeat(1.0, 50), np.repeat(2.0, 50)), "g": np.array([-1.7e308, -1.0, 5e-324, 1e-300, 1.0, 1.7e308]), "h": np.append(rng.normal(0, 1, 99), 1e12),
    }
    rows = [(g, i, 0, float(v)) for g, values in grids.items() for i, v in enumerate(values)] + [("a", -1, 0, NODATA), ("a", -2, 0, float("inf")), ("none", 0, 0, float("nan"))]
    monkeypatch.setattr(smoothing, "PARTS", parts)
    cells = spark.createDataFrame(rows, "grid_id string, r long, c long, z double")
    got = smoothing.elevation_statistics(cells, NODATA)
    assert {r.grid_id: (r.valid_cells, r.median_elevation) for r in got.collect()} == {g: (len(v), float(np.median(v))) for g, v in grids.items()}
    alone = smoothing.elevation_statistics(cells.where("grid_id = 'a'").drop("grid_id"), NODATA).first()
    assert (alone.valid_cells, alone.median_elevation) == (3001, float(np.median(grids["a"])))
    assert smoothing.elevation_statistics(cells.limit(0), NODATA).count() == 0


def test_outputs_of_both_tools(spark, tmp_path):
    """Every output is read back from its files with its type, nodata and cells."""
    rng = np.random.RandomState(3)
    z = rng.normal(100, 5, (30, 20)).round(2)
    z[4:6, 4:6], z[10, 10], z[20, 5] = NODATA, NODATA, 500.0
    header = screening.Header(20, 30, NODATA, 2.0, 2.0, crs="EPSG:32734", crs_is_geographic=False, name="/x/dem one.tif", left=5.0, top=50.0)
    done = {
        "screening": screening.screen(grid(spark, z), header, screening.Parameters(small_void=2, large_void=3)),
        "smoothing": smoothing.smooth(grid(spark, z), smoothing.Parameters(), NODATA, 2.0, 2.0, header.name, header.crs),
    }
    kinds = {"screened": "float64", "void_mask": "uint8", "artifacts": "uint8", "smoothed": "float32", "difference": "float32", "mask": "uint8"}
    for tool, results in done.items():
        paths = outputs.write_outputs(results, tool, str(tmp_path), header)
        for kind in outputs.TOOLS[tool][0]:
            head = geotiff.read_headers(spark, paths[kind]).first()
            nodata = {"screened": NODATA, "smoothed": NODATA, "difference": -9999.0}.get(kind, 255.0)
            assert (head.dtype, head.nodata, head.crs, head.left, head.top, head.width, head.height) == (kinds[kind], nodata, "EPSG:32734", 5.0, 50.0, 20, 30)
            back = {(x.r, x.c): x.z for x in geotiff.read_cells(spark, paths[kind]).collect()}
            want = {(x.r, x.c): x.value for x in outputs.recoded(results, kind, tool).collect()}
            assert back == {k: float(np.array(v).astype(kinds[kind])) for k, v in want.items()}
            assert paths[kind].endswith("dem one" + files.SCREENING_OUTPUTS.get(kind, files.SMOOTHING_OUTPUTS.get(kind, "")))
        text = spark.read.text(paths["report"]).collect()
        assert any("OUTPUTS" in r.value for r in text) and any("REFERENCES" in r.value for r in text)
        told = spark.read.json(paths["provenance"], multiLine=True).first()
        assert told.outputs["provenance" if tool == "screening" else "mask"].startswith("dem one_") and told.version and told.algorithm_id == tool
        assert spark.table(f"dem_one_{'void_mask' if tool == 'screening' else 'mask'}").count() == 600
    mask = {(x.r, x.c): x.z for x in geotiff.read_cells(spark, str(tmp_path / "dem one_smoothing_mask")).collect()}
    assert mask[4, 4] == 255 and mask[0, 0] in (0, 1)
    void = {(x.r, x.c): x.z for x in geotiff.read_cells(spark, str(tmp_path / "dem one_void_mask")).collect()}
    assert void[4, 4] == P.LARGE and void[10, 10] == P.SMALL and void[0, 0] == 0
    assert P.LARGE == 3 and not [r for r in done["screening"]["regions"].collect() if r.size_cells > 4]


def test_large_files_are_split(spark, tmp_path):
    z = np.arange(600.0 * 300).reshape(600, 300)
    (tmp_path / "big.tif").write_bytes(geotiff.encode(z, compression=geotiff.DEFLATE))
    cells = geotiff.read_cells(spark, str(tmp_path / "big.tif"), split_bytes=30_000)
    assert cells.rdd.getNumPartitions() > 3
    for df in (cells, geotiff.read_cells(spark, str(tmp_path)), geotiff.read_cells(spark, str(tmp_path), whole_files=True)):
        assert df.agg(F.count("*"), F.sum("z"), F.max("r"), F.max("c")).first() == (z.size, z.sum(), 599, 299)
    with pytest.raises(ValueError):
        geotiff.Tiff(b"II" + b"\0" * 30)


def test_big_tiff():
    """The same image with places and counts of eight bytes."""
    import struct

    z = (np.random.RandomState(3).rand(20, 30) * 200).astype("float32")
    old = geotiff.Tiff(geotiff.encode(z, 7.0, compression=geotiff.NONE))
    body = np.full((256, 256), 7.0, "float32")
    body[:20, :30] = z
    entries = {t: v for t, v in old.tags.items() if t not in (geotiff.TILE_OFFSETS, geotiff.NODATA_TEXT, geotiff.PIXEL_SCALE, geotiff.TIEPOINT)}
    entries[geotiff.TILE_OFFSETS] = (16 + 8 + 20 * (len(entries) + 1) + 8,)
    head = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries))
    for tag in sorted(entries):
        head += struct.pack("<HHQQ", tag, 16, 1, entries[tag][0])
    tiff = geotiff.Tiff(head + struct.pack("<Q", 0) + body.tobytes())
    assert tiff.big and (next(tiff.blocks())[2] == z).all()


def test_grids_that_land(spark, tmp_path):
    z = np.arange(36.0).reshape(6, 6)
    z[2, 2] = NODATA
    grid(spark, z).withColumn("grid_id", F.lit("a")).select("grid_id", "r", "c", "z").write.parquet(str(tmp_path / "in"))
    landing.screen_landing(spark, str(tmp_path / "in"), str(tmp_path / "out"), 6, NODATA, str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/summary"))
    assert (got.first().total_void_cells, got.first().small_cells) == (1, 1)

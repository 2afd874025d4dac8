"""A small synthetic scene, end to end: band files, alignment, change, statistics, sinks, command line."""

import hashlib
import json
import sqlite3
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt import cli, errors, scratch
from veldt.functions import projection
from veldt.operators import raster, validation
from veldt.operators.change import AnalysisError
from veldt.plans import request as requests
from veldt.plans import run as runs
from veldt.sinks import files, styles
from veldt.sources import discovery, records, tiff, vectors
from veldt.sources.tiff import Grid

GRID = Grid(40, 30, 10.0, 500000.0, -10.0, 8600000.0, "EPSG:32735", 0.0)


def scene(root, shift=0.0):
    rng = np.random.default_rng(42)
    for date, change in (("20230101", 0), ("20230201", 800)):
        d = root / f"sentinel2_{date}"
        d.mkdir(parents=True, exist_ok=True)
        for b, lo in (("B02", 1000), ("B03", 1200), ("B04", 1400)):
            x = rng.integers(lo, lo + 500, (30, 40)).astype("u2")
            x[5:15, 5:15] += np.uint16(change)
            x[0], x[:, 0] = 0, 0
            g = GRID if not change else Grid(40, 30, 10.0, 500000.0 + shift, -10.0, 8600000.0, "EPSG:32735", 0.0)
            (d / f"{b}.tif").write_bytes(tiff.encode(x, g))
    return root


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return scene(tmp_path_factory.mktemp("scene"))


def config(root, **extra):
    import yaml

    c = {"paths": {"aoi": "aoi.geojson", "before_folder": "sentinel2_20230101", "after_folder": "sentinel2_20230201", "output_dir": "out"}, "spatial_statistics": {"grid_size_m": 60, "permutations": 49}, "spatial_ml": {"n_bootstrap": 2, "n_estimators": 20}} | extra
    (root / "c.yaml").write_text(yaml.safe_dump(c))
    lon = [25.0, 28.0]
    ring = [[lon[0], -13.5], [lon[1], -13.5], [lon[1], -11.5], [lon[0], -11.5], [lon[0], -13.5]]
    (root / "aoi.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    return str(root / "c.yaml")


def test_tiff_round_trip(root):
    data = (root / "sentinel2_20230101/B04.tif").read_bytes()
    layout = tiff.levels(tiff.Ranges(None, data))[0]
    assert layout.grid == GRID
    x = np.zeros((30, 40))
    for i, (at, n) in enumerate(zip(layout.offsets, layout.sizes)):
        r, c, band, part = tiff.unpacked(layout, i, data[at : at + n])
        x[r : r + part.shape[0], c : c + part.shape[1]] = part[:, :, 0]
    assert band == -1 and x[0].sum() == 0 and x[1:, 1:].min() >= 1400
    with pytest.raises(AnalysisError):
        tiff.levels(tiff.Ranges(None, b"\0\0\0\x0cjP  "))


def lzw_packed(data):
    """TIFF's LZW the other way, by the format's description."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table, width, now = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for k in range(len(data)):
        ch = data[k : k + 1]
        if now + ch in table:
            now += ch
            continue
        put(table[now], width)
        table[now + ch] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        now = ch
    if now:
        put(table[now], width)
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def packbits_packed(data):
    return b"".join(bytes([257 - 2, data[i]]) if data[i : i + 1] * 2 == data[i : i + 2] else bytes([len(data[i : i + 2]) - 1]) + data[i : i + 2] for i in range(0, len(data), 2))


def test_codecs():
    """Every compression, predictor, byte order, number of bands and layout of planes gives the pixels back."""
    import zlib

    rng = np.random.default_rng(3)
    whole = np.repeat(rng.integers(0, 9000, (16, 8, 3)), 4, axis=1).astype("u2")
    real = rng.normal(size=(16, 32, 3)).astype("f4")
    assert tiff.lzw(lzw_packed(b"")) == b"" and tiff.lzw(lzw_packed(b"ab" * 9000)) == b"ab" * 9000
    noise = rng.integers(0, 256, 60_000).astype("u1").tobytes()
    assert tiff.lzw(lzw_packed(noise)) == noise and tiff.packbits(packbits_packed(noise)) == noise
    packs = {tiff.PLAIN: bytes, tiff.DEFLATE: zlib.compress, tiff.LZW: lzw_packed, tiff.PACKBITS: packbits_packed}
    for x, predictors in ((whole, (1, 2)), (real, (1, 3))):
        for predictor in predictors:
            raw = zlib.decompress(tiff.packed_tile(x, predictor))
            for packed, pack in packs.items():
                layout = tiff.Layout(Grid(32, 16), "<", x.dtype.str[1:], 3, False, packed, predictor, True, (16, 32), (), ())
                assert (tiff.unpacked(layout, 0, pack(raw))[3] == x).all()
    layout = tiff.Layout(Grid(30, 14), ">", "u2", 3, True, tiff.PLAIN, 1, True, (16, 32), (), ())
    for k in range(3):
        r, c, band, got = tiff.unpacked(layout, k, whole[:, :, k].astype(">u2").tobytes())
        assert (r, c, band) == (0, 0, k) and (got[:, :, 0] == whole[:14, :30, k]).all()


def test_tiled_files(spark, tmp_path, monkeypatch):
    """Bands, overviews, holes and georeference come back; each block is its own task; nothing reads beyond its bytes."""
    g = Grid(70, 45, 10.0, 500000.0, -10.0, 8600000.0, "EPSG:32735", -9999.0)
    df = spark.range(70 * 45).selectExpr("cast(id / 70 as int) row", "cast(id % 70 as int) col", "double(id) a", "id / 7 b").where("(row * 70 + col) % 11 > 0")
    path = str(tmp_path / "x.tif")
    monkeypatch.setattr(tiff, "BATCH", 500)
    whole = [(g, scratch.kept(tiff.tiles(df, ["a", "b"], g, "f4", 3, 32), "tiles"))]
    tiff.write(path, whole, ["a", "b"], "f4", 3, 32)
    assert tiff.grids(spark, {"x": path}) == {"x": g}
    px = tiff.scan(spark, {"x": path}, blocks=1)
    assert px.rdd.getNumPartitions() == 6 and px.where("band = 2").count() == 70 * 45
    want = {(r["row"], r["col"]): (r["a"], r["b"]) for r in df.collect()}
    for r in px.collect():
        value = want.get((r["row"], r["col"]), (-9999.0, -9999.0))[r["band"] - 1]
        assert r["name"] == "x" and r["dn"] == pytest.approx(value, rel=1e-6)
    files.raster_file(df.selectExpr("row", "col", "a"), ["a"], g, tmp_path / "y.tif", "u2", 0.0)
    found = tiff.levels(tiff.Ranges(str(tmp_path / "y.tif")))
    assert [(x.grid.width, x.grid.height, x.grid.a) for x in found] == [(70, 45, 10.0), (35, 23, 20.0), (18, 12, 40.0), (9, 6, 80.0)]
    small = {(r["row"], r["col"]): r["dn"] for r in tiff.scan(spark, {"y": str(tmp_path / "y.tif")}, level=2).collect()}
    for (row, col), v in small.items():
        inner = [a for (r, c), (a, _) in want.items() if (r // 4, c // 4) == (row, col)]
        assert abs(v - sum(inner) / len(inner)) <= 0.5 + 1e-9
    (tmp_path / "bad.tif").write_bytes(b"II*\0\xff\xff")
    with pytest.raises(AnalysisError):
        tiff.grids(spark, {"bad": str(tmp_path / "bad.tif")})


def test_discovery(spark, root, tmp_path):
    assert set(discovery.discover(spark, str(root / "sentinel2_20230101"))) == {"B02", "B03", "B04"}
    (tmp_path / "B02.tif").write_bytes(b"x")
    (tmp_path / "B02_again.tif").write_bytes(b"x")
    with pytest.raises(discovery.DiscoveryError, match="B02: duplicate; B03: missing; B04: missing"):
        discovery.discover(spark, str(tmp_path))


def test_reference_systems(spark):
    """Known points, there and back to a millimetre, as numbers and as columns."""
    assert projection.to_zone(27.0, 0.0, 32735) == pytest.approx((500000, 10_000_000))
    x, y = projection.to_zone(27.0, -1.0, 32735)
    assert x == pytest.approx(500000) and y == pytest.approx(10_000_000 - 0.9996 * 110574.3886, abs=1)
    rows = [(lon, lat) for lon in (20.5, 24.0, 26.9, 31.0, 33.5) for lat in (-79.0, -33.3, -0.001, 12.5, 71.0)]
    for lon, lat in rows:
        for code in (32635, 32735, 32736):
            assert projection.to_degrees(*projection.to_zone(lon, lat, code), code) == pytest.approx((lon, lat), abs=1e-8)
    df = spark.createDataFrame(rows, "x double, y double")
    out = projection.moved(projection.moved(df, "EPSG:4326", "EPSG:32735"), "EPSG:32735", "EPSG:32736").collect()
    for (lon, lat), r in zip(rows, out, strict=True):
        assert (r["x"], r["y"]) == pytest.approx(projection.to_zone(lon, lat, 32736), abs=1e-3)
    with pytest.raises(AnalysisError):
        projection.between(0, 0, "EPSG:4326", "EPSG:3857")


def test_regrid_of_planes(spark):
    """A plane stays a plane on any grid; holes are renormalised; nothing comes from outside the frame."""
    have = Grid(50, 40, 20.0, 500000.0, -20.0, 8600000.0, "EPSG:32735")
    want = Grid(30, 30, 10.0, 500200.0, -10.0, 8599700.0, "EPSG:32735")
    plane = spark.range(2000).selectExpr("cast(id / 50 as int) row", "cast(id % 50 as int) col", "double(id % 50 * 3 + cast(id / 50 as int) * 7) v")
    for r in raster.regrid(plane, ["v"], have, want).collect():
        u, v = (200 + (r["col"] + 0.5) * 10) / 20 - 0.5, (300 + (r["row"] + 0.5) * 10) / 20 - 0.5
        assert r["v"] == pytest.approx(3 * u + 7 * v)
    flat = plane.where("row % 3 > 0 or col % 2 = 0").selectExpr("row", "col", "5d v")
    told = raster.regrid(flat, ["v"], have, want)
    assert told.count() == 900 and told.where("abs(v - 5) > 1e-9").count() == 0
    far = Grid(30, 30, 10.0, 400000.0, -10.0, 8599700.0, "EPSG:32735")
    assert raster.regrid(plane, ["v"], have, far).count() == 0


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def test_areas_of_interest(spark, tmp_path):
    """Overlapping polygons are one area, multipolygons are all their parts, holes are out; clips are exact."""
    from veldt.operators import overlay

    def area(pixels, edges):
        return overlay.measures(overlay.boundary(scratch.kept(overlay.clip(overlay.runs(pixels), edges), "clipped")))

    hole = [square(0, 0, 9, 9), square(2, 2, 5, 5)[::-1]]
    cases = {
        "overlap": ({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [s]}} for s in (square(0, 0, 6, 6), square(3, 3, 9, 9))]}, 63),
        "multi": ({"type": "MultiPolygon", "coordinates": [[square(0, 0, 6, 6)], [square(7, 7, 10, 10)]]}, 45),
        "mixed": ({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None}, {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": hole}]}}]}, 72),
    }
    px = spark.range(400).selectExpr("cast(id / 20 as int) row", "cast(id % 20 as int) col", "id % 20 + 0.5 x", "cast(id / 20 as int) + 0.5 y").selectExpr("row", "col", "double(x) x", "double(y) y")
    for name, (shape, n) in cases.items():
        (tmp_path / name).write_text(json.dumps(shape))
        polygons = vectors.polygons(spark, str(tmp_path / name))
        edges = vectors.edges(spark, polygons)
        assert overlay.inside(px, edges).count() == n
        assert area(px.selectExpr("1 label", "row", "col"), edges).first()["area_m2"] == pytest.approx(n)
    tilted = vectors.edges(spark, [[[(0.5, 0.5), (7.25, 1.0), (3.0, 8.5)]]])
    twice = abs((7.25 - 0.5) * (8.5 - 0.5) - (3.0 - 0.5) * (1.0 - 0.5))
    assert area(px.selectExpr("int(col >= 4) label", "row", "col"), tilted).agg({"area_m2": "sum"}).first()[0] == pytest.approx(twice / 2)
    assert area(px.where("col > 12").selectExpr("1 label", "row", "col"), tilted).count() == 0
    assert vectors.meets_box([[[(0, 0), (9, 0), (9, 9)]]], (4, 1, 5, 2)) and not vectors.meets_box([[[(0, 0), (9, 0), (9, 9)]]], (0, 5, 2, 9))
    assert vectors.crosses_itself([(0, 0), (2, 2), (2, 0), (0, 2)]) and not vectors.crosses_itself([(0, 0), (2, 0), (2, 2), (0, 2)])
    for text, code in (("{", "aoi_unreadable"), ('{"type": "FeatureCollection", "features": []}', "aoi_empty")):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(vectors.AoiError) as e:
            vectors.polygons(spark, str(tmp_path / "bad"))
        assert e.value.code == code
    with pytest.raises(vectors.AoiError) as e:
        vectors.polygons(spark, str(tmp_path / "none"))
    assert e.value.code == "aoi_missing"


def test_output_folder_must_be_writable(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    assert runs.writable(spark, str(tmp_path / "new")) and not runs.writable(spark, str(tmp_path / "file" / "sub"))


def test_end_to_end(spark, root):
    path = config(root)
    request = requests.load(path, str(root))
    assert validation.status(runs.validate_request(spark, request)) in ("valid", "valid_with_warnings")
    one = runs.run_pipeline(spark, request)
    assert one.summary["feature_count"] >= 1 and one.summary["changed_area_m2"] >= 8000 and one.moran is not None
    row = one.tables["change_features"].orderBy("id").first()
    assert 0 <= row["confidence"] <= 1 and row["hotspot_class"] is not None
    two = runs.run_pipeline(spark, request)
    for k in ("feature_count", "changed_area_m2", "global_moran_i", "global_moran_p"):
        assert one.summary[k] == pytest.approx(two.summary[k], rel=1e-12)


def test_cli_and_sinks(spark, root, capsys):
    path = config(root)
    assert cli.main(["validate", "--config", path, "--base", str(root), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["status"].startswith("valid")
    assert cli.main(["all", "--config", path, "--base", str(root), "--json-progress", "--ml"], spark) == 0
    last = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert last["type"] == "result" and {"change.gpkg", "report.md", "summary.json", "run_manifest.json"} <= set(last["outputs"])
    db = sqlite3.connect(last["outputs"]["change.gpkg"])
    n, area = db.execute("select count(*), sum(area_m2) from change_features").fetchone()
    assert n == last["summary"]["feature_count"] and area == pytest.approx(last["summary"]["changed_area_m2"])
    assert db.execute("select count(*) from spatial_grid").fetchone()[0] == 35
    with open(last["outputs"]["spatial_grid.csv"]) as f:
        head, *rows = f.read().splitlines()
    assert len(rows) == 35 and "mean_cva" in head.split(",") and "geometry" not in head
    assert len([n for n in last["outputs"] if n.endswith(".qml")]) == 7 and "before_stack.tif" in last["outputs"]
    told = (root / "out/report.md").read_text()
    assert all(x in told for x in ("## 2. Data", "Local clusters", "Hotspots", "### Anomaly scores", "threshold of baseline"))
    ml = json.loads((root / "out/statistics/spatial_ml.json").read_text())
    assert [r["contamination"] for r in ml["sensitivity"]] == [0.05, 0.1, 0.2] and ml["stability"]["replicates"] == 2
    assert db.execute("select geom from change_features").fetchone()[0][:2] == b"GP"
    for name, least in (("change_features", 1), ("spatial_grid", 35)):
        lines = [json.loads(x) for p in (root / "out/map" / name).glob("part-*") for x in p.read_text().splitlines()]
        assert len(lines) >= least and all(x["type"] == "Feature" and x["geometry"]["type"] == "MultiPolygon" for x in lines)
        lon, lat = lines[0]["geometry"]["coordinates"][0][0][0]
        assert 26.9 < lon < 27.1 and -12.8 < lat < -12.6
    grid = sqlite3.connect(last["outputs"]["spatial_statistics.gpkg"])
    assert grid.execute("select count(*) from spatial_grid").fetchone()[0] == 35
    told = json.loads((root / "out/run_manifest.json").read_text())
    assert set(told["output_paths"]) >= {"change.gpkg", "summary.json", "spatial_statistics.gpkg"} and told["environment"]["package_versions"]["pyspark"]
    sums = {k.rsplit("/", 1)[1]: v for k, v in told["output_checksums"].items()}
    assert sums["summary.json"] == hashlib.sha256((root / "out/summary.json").read_bytes()).hexdigest() and len(sums) == len(told["output_paths"])
    assert len(told["inputs"]["checksums"]) == 6 and told["before_date"] == "20230101"
    run = records.runs(spark, str(root / "out/run_manifest.json")).first()
    assert run["run_id"] == told["run_id"] and json.loads(run["summary"]) == json.loads(json.dumps(last["summary"])) and run["output_dir"].endswith("/out")
    assert run["output_paths"]["change.gpkg"] == last["outputs"]["change.gpkg"]
    assert cli.main(["run", "--config", str(root / "none.yaml")], spark) == 1


def test_shifted_date_is_resampled(spark, tmp_path):
    scene(tmp_path, 3.0)
    request = requests.load(config(tmp_path), str(tmp_path), permutations=0, method="baseline")
    px, _, warnings = runs.aligned(spark, request)
    assert warnings and px.count() > 1000
    out = runs.run_pipeline(spark, request)
    assert out.summary["threshold_method"] == "otsu"


def test_dates_of_other_zones_and_pixels(spark, tmp_path):
    """The later date in the next zone, at 20 m: its bands are a plane of longitude and latitude, and stay one."""
    scene(tmp_path)
    x0, y0 = projection.between(500000.0, 8600000.0, "EPSG:32735", "EPSG:32736")
    g = Grid(40, 40, 20.0, x0 - 200, -20.0, y0 + 200, "EPSG:32736", 0.0)
    r, c = np.indices((40, 40))
    for b in ("B02", "B03", "B04"):
        (tmp_path / "sentinel2_20230201" / f"{b}.tif").write_bytes(tiff.encode((1000 + 10 * c + 4 * r).astype("u2"), g))
    px, _, warnings = runs.aligned(spark, requests.load(config(tmp_path), str(tmp_path), permutations=0, method="baseline"))
    assert warnings and px.count() == 29 * 39
    for row in px.limit(50).collect():
        x, y = projection.between(500000.0 + (row["col"] + 0.5) * 10, 8600000.0 - (row["row"] + 0.5) * 10, "EPSG:32735", "EPSG:32736")
        want = 1000 + 10 * ((x - g.c) / 20 - 0.5) + 4 * ((g.f - y) / 20 - 0.5)
        assert row["after_b04"] * 10000 == pytest.approx(want, abs=1e-3)


def test_switches_and_verbs(spark, tmp_path, capsys):
    """Switches of outputs, stacks in a folder of their own, the binary raster's bytes, and verbs that tell of one thing."""
    scene(tmp_path)
    off = {"write_intermediate": False, "create_interactive_map": False, "create_qgis_styles": False}
    folders = {"aoi": "aoi.geojson", "before_folder": "sentinel2_20230101", "after_folder": "sentinel2_20230201", "output_dir": "out", "processed_dir": "stacks"}
    path = config(tmp_path, paths=folders, output=off, spatial_statistics={"enabled": False})
    assert cli.main(["report", "--config", path, "--base", str(tmp_path)], spark) == 0
    assert capsys.readouterr().out.strip().endswith("/out/report.md")
    made = {p.name for p in (tmp_path / "out").rglob("*")}
    assert not made & {"map", "styles", "rasters", "statistics"} and {p.name for p in (tmp_path / "stacks").iterdir()} == {"before_stack.tif", "after_stack.tif"}
    assert "before_stack.tif" in json.loads((tmp_path / "out/run_manifest.json").read_text())["output_paths"]
    path = config(tmp_path, paths=folders, output=off | {"write_stacks": False}, spatial_statistics={"enabled": False})
    assert cli.main(["visualize", "--config", path, "--base", str(tmp_path), "--output", str(tmp_path / "seen")], spark) == 0
    names = {p.rsplit("/", 1)[1] for p in capsys.readouterr().out.split()}
    assert {"change_binary.tif", "baseline_intensity.tif", "cva_intensity.tif", "gi_hotspots.qml", "ml_anomalies.qml"} <= names and "before_stack.tif" not in names
    b = str(tmp_path / "seen/rasters/change_binary.tif")
    kinds = {r["dn"]: r["n"] for r in tiff.scan(spark, {"changed": b}).groupBy("dn").agg(F.count("*").alias("n")).collect()}
    px = runs.aligned(spark, requests.load(path, str(tmp_path)))[0].count()
    assert set(kinds) <= {0, 1, 255} and kinds[0] + kinds[1] == px and kinds[1] > 0


def test_errors_tell_users():
    e = errors.ConfigurationError("told", detail="logged")
    assert (e.user_message, e.detail, str(e)) == ("told", "logged", "told (logged)")
    assert errors.CancelledError("grid").stage == "grid" and isinstance(errors.CancelledError("grid"), errors.EngineError)


def test_styles_are_xml():
    made = styles.every(12.5)
    assert len(made) == 7
    for text in made.values():
        ElementTree.fromstring(text.replace("<!DOCTYPE qgis>", ""))
    assert [float(i.get("value")) for i in ElementTree.fromstring(made["cva_intensity"].replace("<!DOCTYPE qgis>", "")).iter("item")] == pytest.approx([0, 4.125, 8.25, 12.5])


def test_database_error(tmp_path):
    with pytest.raises(errors.WriteError), files.atomic(tmp_path / "x") as p, files._database(p) as db:
        db.execute("no sql")
    assert not list(tmp_path.iterdir())


def test_request_round_trip():
    whole = requests.Request("a", "b", "c", "d", processed_dir="e", ml_contamination=0.2, ml_n_bootstrap=7, write_stacks=False, create_qgis_styles=False)
    assert requests.from_config(requests.to_config(whole)) == whole and requests.to_config(whole)["preprocessing"]["resampling"] == "bilinear"
    with pytest.raises(requests.ConfigurationError):
        requests.from_config(requests.to_config(whole) | {"preprocessing": {"resampling": "cubic"}})
    r = requests.Request("a", "b", "c", "d", percentile=90.0, knn_k=5)
    assert requests.from_config(requests.to_config(r)) == requests.Request("a", "b", "c", "d", percentile=90.0, knn_k=5)
    with pytest.raises(requests.ConfigurationError):
        requests.from_config({"paths": {"aoi": "x"}})
    with pytest.raises(requests.ConfigurationError):
        requests.from_config({"paths": {"aoi": "x", "before_folder": "a", "after_folder": "b"}, "spatial_ml": {"model": "hdbscan"}})


def test_progress_lines(spark, tmp_path):
    lines = ['{"type": "progress", "stage": "read", "percent": 5}', "", "no json", '{"type": "result", "manifest": "m.json"', '{"stage": "grid", "percent": 50.5, "more": [1]}',
             '{"type": "other"}', '{"type": "warning", "message": "cloud"}', '{"type": "result", "manifest": "m.json"}', '{"percent": "x"}']
    (tmp_path / "log").write_text("\n".join(lines))
    got = {tuple(r) for r in records.progress(spark, str(tmp_path / "log")).collect()}
    assert got == {("progress", "read", "", 5.0, None), ("info", "grid", "", 50.5, None), ("warning", "", "cloud", 0.0, None), ("result", "", "", 0.0, "m.json")}
    (tmp_path / "none").write_text("")
    assert records.progress(spark, str(tmp_path / "none")).count() == 0


def test_runs_without_summary(spark, tmp_path):
    (tmp_path / "run_manifest.json").write_text('{"run_id": "r"}')
    row = records.runs(spark, str(tmp_path / "*.json")).first()
    assert (row["run_id"], row["before_date"], row["runtime_seconds"], row["summary"]) == ("r", None, 0.0, None)


def test_atomic(tmp_path):
    with pytest.raises(RuntimeError), files.atomic(tmp_path / "x"):
        raise RuntimeError
    assert not list(tmp_path.iterdir())

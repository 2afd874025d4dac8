"""Sinks: Parquet tables, a GeoPackage, CSV, JSON, a manifest, a report, band files and layer styles.

Tables of any size are written by Spark. A GeoPackage is one SQLite file: it is filled from the driver, row by row
from an iterator, and only ever holds features and cells, never pixels.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import platform
import sqlite3
import struct
import sys
import tempfile
from collections.abc import Iterator
from importlib import metadata
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt import scratch
from veldt.errors import WriteError
from veldt.functions import projection
from veldt.operators import change, overlay
from veldt.plans.request import Request
from veldt.plans.run import Result
from veldt.sinks import styles
from veldt.sources import tiff
from veldt.sources.pixels import BANDS
from veldt.sources.tiff import Grid


@contextlib.contextmanager
def atomic(path: str | Path) -> Iterator[Path]:
    """A path beside ``path`` that takes its place when all went well, and is removed when not."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}")
    os.close(fd)
    try:
        yield Path(name)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value: object) -> None:
    with atomic(path) as p:
        p.write_text(json.dumps(value, indent=2, default=str))


def tables(result: Result, path: str) -> dict[str, str]:
    """Each table as Parquet under ``path``, on any file system of Spark's."""
    out = {}
    for name, df in result.tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def csv(df: DataFrame, path: str | Path) -> None:
    """The grid without geometry, as one CSV file with a header: a task writes it, and it is then moved into place."""
    with atomic(path) as p, tempfile.TemporaryDirectory(dir=p.parent, prefix=".csv") as folder:
        df.drop("geometry").coalesce(1).write.mode("overwrite").option("header", True).csv(Path(folder).as_uri())
        os.replace(next(Path(folder).glob("part-*")), p)


def stringified(df: DataFrame) -> DataFrame:
    """All columns as text: nested values as JSON, null as null."""
    return df.select(*[(F.to_json(c) if t.startswith(("struct", "map", "array")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file's bytes."""
    raw = spark.read.format("binaryFile").load(paths)
    return {r["path"]: r["sha"] for r in raw.select("path", F.sha2("content", 256).alias("sha")).collect()}


@contextlib.contextmanager
def _database(path: Path) -> Iterator[sqlite3.Connection]:
    path.unlink(missing_ok=True)
    try:
        with contextlib.closing(sqlite3.connect(path)) as db:
            yield db
    except sqlite3.Error as e:
        raise WriteError(f"the database in {path.parent} could not be written", detail=str(e)) from e


KINDS = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "string": "TEXT", "boolean": "INTEGER"}


def geopackage(path: str | Path, layers: dict[str, DataFrame], plain: dict[str, DataFrame], srs: int) -> None:
    """Layers have a ``geometry`` column of WKB; plain tables have none."""
    with atomic(path) as p, _database(p) as db:
        # Fixed values of the format: its application id and required tables.
        db.executescript(
            "PRAGMA application_id = 1196444487; PRAGMA user_version = 10200;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT UNIQUE, description TEXT, last_change TEXT DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER, PRIMARY KEY (table_name, column_name));"
        )
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        for name, df in (layers | plain).items():
            shaped = name in layers
            cols = [c for c in df.columns if c != "geometry"]
            types = dict(df.dtypes)
            made = ", ".join(f'"{c}" {KINDS.get(types[c], "TEXT")}' for c in cols) + (", geom BLOB" if shaped else "")
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, {made})')
            spots = ", ".join("?" * (len(cols) + shaped))
            names = ", ".join(f'"{c}"' for c in cols) + (", geom" if shaped else "")
            head = b"GP\0\x01" + struct.pack("<i", srs)
            for r in df.toLocalIterator():
                db.execute(f'INSERT INTO "{name}" ({names}) VALUES ({spots})', [*(r[c] for c in cols), *([head + bytes(r["geometry"])] if shaped else [])])
            # An upsert: a table written again replaces its entry.
            db.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, ?, ?, ?)", (name, "features" if shaped else "attributes", name, srs if shaped else 0))
            if shaped:
                db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, srs))
        db.commit()


def cell_boxes(grid_table: DataFrame, grid: Grid, size_m: float) -> DataFrame:
    """Cells with their boxes as ``shape``."""
    x0, y1 = F.lit(grid.c) + F.col("cell_col") * size_m, F.lit(grid.f) - F.col("cell_row") * size_m
    return grid_table.withColumn("shape", overlay.box(x0, y1 - size_m, x0 + size_m, y1))


def raster_file(df: DataFrame, values: list[str], grid: Grid, path: str | Path, dtype: str = "f4", nodata: float = -9999.0, factors: tuple[int, ...] = (2, 4, 8)) -> None:
    """Pixels (row, col, *values) as a tiled file of a band for each value, with overviews of means; pixels without a row or
    a value hold ``nodata``. Tasks encode the tiles."""
    whole = np.dtype(dtype).kind != "f"
    pyramid = []
    for k in (1, *factors):
        g = Grid(-(-grid.width // k), -(-grid.height // k), grid.a * k, grid.c, grid.e * k, grid.f, grid.crs, nodata)
        level = df.select("row", "col", *values)
        if k > 1:
            mean = [F.round(F.avg(v)).alias(v) if whole else F.avg(v).alias(v) for v in values]
            level = level.groupBy(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(*mean)
        pyramid.append((g, scratch.kept(tiff.tiles(level, values, g, dtype, 2 if whole else 3), "tiles")))
    with atomic(path) as p:
        tiff.write(p, pyramid, values, dtype, 2 if whole else 3)


def geojson(df: DataFrame, path: str, crs: str, properties: list[str]) -> None:
    """Rows with a ``shape`` as GeoJSON features in degrees, a feature to a line in files of text, written by Spark."""
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), projection.in_degrees(F.col("shape"), crs).alias("coordinates"))
    told = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    df.select(F.to_json(told).alias("value")).write.mode("overwrite").text(path)


def counted(df: DataFrame, col: str) -> str:
    """How many rows have each value, as text, most frequent first."""
    rows = df.groupBy(col).count().orderBy(F.desc("count"), col).collect()  # a class is one of a fixed few
    return ", ".join(f"{r[0]} {r[1]}" for r in rows) or "none"


def report(result: Result, request: Request) -> str:
    """The run as Markdown: summary, data, method, results, and what to be careful with."""
    s, g, tables = result.summary, result.grid, result.tables
    issues = tables["quality_checks"].groupBy("severity").count().orderBy("severity").collect()
    x0, y0, x1, y1 = g.bounds
    lines = [f"# Change between {result.before_date} and {result.after_date}", "", f"Run {result.run_id}.", "", "## 1. Summary", "", "| Measure | Value |", "|---|---|"]
    lines += [f"| {k.replace('_', ' ')} | {v} |" for k, v in s.items()]
    lines += ["", "## 2. Data", "", f"- Bands: {', '.join(b.upper() for b in BANDS)}", f"- Reference system: {g.crs or 'unknown'}, pixels of {g.a:g} m", f"- Grid: {g.width} x {g.height} pixels, {x0:g} {y0:g} to {x1:g} {y1:g}"]
    lines += [f"- No data: {request.nodata_value:g}", f"- Pixels used: {result.counts['n_pixels']} ({100 - 100 * result.counts['n_pixels'] / (g.width * g.height):.2f} % of the grid left out)"]
    lines += [f"- Checks: {', '.join(f'{r[0]} {r[1]}' for r in issues) or 'nothing found'}"]
    cleaning = f"{request.morphology_operation}, kernel {request.morphology_kernel_size}" if request.morphology_enabled else "none"
    lines += ["", "## 3. Method", "", f"- Normalisation: {request.normalization}", f"- Method: {request.method}; threshold: {s['threshold_method']} = {s['threshold']:.4f}", f"- Morphology: {cleaning}; holes {'filled' if request.fill_holes else 'kept'}"]
    lines += [f"- Least area: {request.min_area_m2:g} m2; components {result.counts['n_raw_components']}, inside the area of interest {result.counts['n_after_aoi']}, large enough {result.counts['n_after_min_area']}"]
    lines += ["", "## 4. Results", "", *[f"- Pixels above the threshold of {k}: {v:.2f} %" for k, v in result.shares.items()]]
    top = tables["change_features"].orderBy(F.desc("area_m2"), "id").limit(5).collect()
    lines += ["", "### Largest features", "", "| Feature | Area, m2 | Mean change | Confidence | Hotspot |", "|---|---|---|---|---|"]
    lines += [f"| {r['id']} | {r['area_m2']:.0f} | {r['mean_change']:.3f} | {r['confidence']:.3f} | {r['hotspot_class'] or '-'} |" for r in top]
    if result.moran:
        lines += ["", "### Spatial autocorrelation", "", *[f"- {k}: {v:.6g}" for k, v in result.moran.items()]]
        lines += [f"- Local clusters: {counted(tables['spatial_grid'], 'lisa_cluster')}", f"- Hotspots: {counted(tables['spatial_grid'], 'hotspot_class')}"]
    if result.anomalies:
        lines += ["", "### Anomaly scores", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in result.anomalies.items()]]
    lines += ["", "## 5. Limits", "", "- Two dates and three visible bands: seasons, clouds and shadows are not told from lasting change.", "- Confidence is a rule of thumb, not a probability; anomaly scores are ranks without ground truth.", "- p-values speak of the pattern in space, not of its cause."]
    lines += ["", "## Warnings", "", *([f"- {w}" for w in result.warnings] or ["- none"]), "", "## Parameters", "", *[f"- {k}: {v}" for k, v in request.parameters().items()]]
    return "\n".join(lines) + "\n"


def manifest(spark: SparkSession, result: Result, request: Request, inputs: list[str], outputs: dict[str, str]) -> dict:
    """What a run read, how it was set, what it wrote and with what: files by their SHA-256."""
    read = {k: getattr(request, k) for k in ("before_folder", "after_folder", "aoi_path")}
    versions = {name: metadata.version(name) for name in ("pyspark", "pyarrow", "pandas", "numpy")}
    return {
        "run_id": result.run_id, "started_at": result.started_at, "runtime_seconds": result.runtime_seconds, "before_date": result.before_date, "after_date": result.after_date,
        "inputs": read | {"checksums": checksums(spark, inputs)}, "grid": {"crs": result.grid.crs, "pixel_size_m": result.grid.a}, "parameters": request.parameters(),
        "environment": {"python_version": sys.version, "platform": platform.platform(), "package_versions": versions},
        "output_paths": outputs, "output_checksums": checksums(spark, [Path(p).as_uri() for p in outputs.values()]) if outputs else {},
    }


def export(spark: SparkSession, result: Result, request: Request, inputs: list[str]) -> dict[str, str]:
    """All outputs of a run under ``request.output_dir`` of the driver, and its stacks under ``processed_dir`` if that is set."""
    root, g = Path(request.output_dir).absolute(), result.grid
    made: dict[str, str] = {}  # what this run wrote: the folders may hold files of earlier ones

    def at(path: Path) -> Path:
        made[path.name] = str(path)
        return path

    srs = int(g.crs.split(":")[1]) if g.crs else 0
    features = result.tables["change_features"].drop("label")
    layers = {"change_features": features}
    mapped = bool(g.crs) and request.create_interactive_map
    if mapped:
        told = result.tables["change_features"].drop("geometry").join(result.tables["outlines"], "label")
        geojson(told, str(root / "map/change_features"), g.crs, ["id", "area_m2", "mean_change", "confidence", "hotspot_class"])
    if "spatial_grid" in result.tables:
        boxes = cell_boxes(result.tables["spatial_grid"], g, request.spatial_grid_size_m)
        layers["spatial_grid"] = overlay.as_wkb(boxes)
        if mapped:
            geojson(boxes, str(root / "map/spatial_grid"), g.crs, ["grid_id", "mean_cva", "hotspot_class", "lisa_cluster"])
        csv(result.tables["spatial_grid"], at(root / "statistics/spatial_grid.csv"))
        write_json(at(root / "statistics/global_moran.json"), result.moran)
    if result.anomalies:
        write_json(at(root / "statistics/spatial_ml.json"), result.anomalies)
    stacks = Path(request.processed_dir).absolute() if request.processed_dir else root / "rasters"
    for date in ("before", "after") if request.write_stacks else ():
        stack = [f"{date}_{b}" for b in BANDS]
        dn = result.tables["aligned"].select("row", "col", *[F.round(F.col(c) * request.reflectance_scale).alias(c) for c in stack])
        raster_file(dn, stack, g, at(stacks / f"{date}_stack.tif"), "u2", float(request.nodata_value))
    geopackage(at(root / "change.gpkg"), layers, {k: stringified(result.tables[k]) if k == "run_metadata" else result.tables[k] for k in ("run_metadata", "quality_checks")}, srs)
    top = change.scale_top(result.tables["vectors"], "cva") if "vectors" in result.tables else None
    if request.write_intermediate:
        if "baseline" in result.tables:
            raster_file(result.tables["baseline"], ["intensity"], g, at(root / "rasters/baseline_intensity.tif"))
        if "vectors" in result.tables:
            raster_file(result.tables["vectors"], ["cva"], g, at(root / "rasters/cva_intensity.tif"))
        # Pixels that are not valid are neither changed nor unchanged: they hold the nodata value.
        changed = result.tables["aligned"].select("row", "col").join(result.tables["labels"], ["row", "col"], "left")
        raster_file(changed.select("row", "col", F.col("label").isNotNull().cast("int").alias("changed")), ["changed"], g, at(root / "rasters/change_binary.tif"), "u1", 255.0)
    for name, style in styles.every(top).items() if request.create_qgis_styles else ():
        with atomic(at(root / f"styles/{name}.qml")) as p:
            p.write_text(style)
    write_json(at(root / "summary.json"), result.summary)
    with atomic(at(root / "report.md")) as p:
        p.write_text(report(result, request))
    if "spatial_grid" in layers:
        geopackage(at(root / "maps/spatial_statistics.gpkg"), {"spatial_grid": layers["spatial_grid"]}, {}, srs)
    write_json(root / "run_manifest.json", manifest(spark, result, request, inputs, made))
    return made | {"run_manifest.json": str(root / "run_manifest.json")}

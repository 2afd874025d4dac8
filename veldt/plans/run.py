"""A whole analysis, from folders of band files to a queryable catalog."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt import scratch
from veldt.errors import AnalysisError, CancelledError, ConfigurationError
from veldt.functions import projection
from veldt.operators import cells, change, features, ml, overlay, radiometry, raster, validation
from veldt.plans.request import Request
from veldt.sources import discovery, tiff, vectors
from veldt.sources.pixels import BANDS
from veldt.sources.tiff import Grid


@dataclass
class Result:
    run_id: str
    before_date: str
    after_date: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    summary: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    grid: Grid | None = None
    moran: dict | None = None
    counts: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)
    anomalies: dict = field(default_factory=dict)
    runtime_seconds: float = 0.0
    started_at: str = ""


def run_id(label: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_-]+", "-", label).strip("-")[:40]
    stamp = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    return stamp if clean in ("", "run") else f"{stamp}-{clean}"


def _label(folder: str) -> str:
    name = folder.rstrip("/").split("/")[-1]
    m = re.search(r"(20\d{6})", name)
    return m[1] if m else name


def metadata(spark: SparkSession, paths: dict[str, dict[str, str]], nodata: float) -> DataFrame:
    """Band metadata of both dates: grid, and the share of valid pixels."""
    rows = []
    for date, files in paths.items():
        heads = tiff.grids(spark, files)
        share = {r["name"]: r["v"] for r in tiff.scan(spark, files).groupBy("name").agg(F.avg((F.col("dn") != nodata).cast("double")).alias("v")).collect()}
        rows += [(date, b, g.crs, g.width, g.height, f"{g.a}|{g.c}|{g.e}|{g.f}", share.get(b, 0.0)) for b, g in heads.items()]
    return spark.createDataFrame(rows, "date string, band string, crs string, width int, height int, transform string, valid_ratio double")


def validate_request(spark: SparkSession, request: Request) -> DataFrame:
    """(severity, code, message): all that is wrong or odd with a request and its inputs."""
    found, paths = [], {}
    if request.before_folder == request.after_folder:
        found.append(("error", "same_folder", request.before_folder))
    for when, folder in (("before", request.before_folder), ("after", request.after_folder)):
        try:
            paths[f"{when} {_label(folder)}"] = discovery.discover(spark, folder)
        except Exception as e:  # noqa: BLE001  any failure to list or match is the finding
            found.append(("error", f"{when}_discovery_failed", str(e).split("\n")[0]))
    if _label(request.before_folder) == _label(request.after_folder):
        found.append(("warning", "same_date_label", _label(request.before_folder)))
    meta = None
    if len(paths) == 2:
        try:
            meta = metadata(spark, paths, request.nodata_value)
        except AnalysisError as e:
            found.append(("error", "unreadable_raster", str(e)))
    if request.aoi_path:
        try:
            shape = vectors.polygons(spark, request.aoi_path)
            if any(vectors.crosses_itself(ring) for rings in shape for ring in rings):
                found.append(("warning", "aoi_invalid_geometry", "sides of the area of interest cross; all that its ring winds around counts"))
            if meta is not None and (crs := meta.select("crs").first()[0]):
                g = next(iter(tiff.grids(spark, paths[min(paths)]).values()))
                if not vectors.meets_box(projected(spark, request.aoi_path, crs), g.bounds):
                    found.append(("error", "aoi_no_overlap", request.aoi_path))
        except vectors.AoiError as e:
            found.append(("error", e.code, str(e)))
        except AnalysisError as e:
            found.append(("error", "aoi_reprojection_failed", str(e)))
    if not writable(spark, request.output_dir):
        found.append(("error", "output_dir_not_writable", request.output_dir))
    out = spark.createDataFrame(found, "severity string, code string, message string").unionByName(validation.parameters(spark, request))
    if meta is not None:
        own = validation.issues(meta)
        out = out.unionByName(own)
        if validation.status(out) != "invalid":
            out = out.unionByName(validation.between_dates(meta))
    return out


def projected(spark: SparkSession, path: str, crs: str | None) -> list:
    """The polygons of a file in a reference system; as they are where there is none."""
    shape = vectors.polygons(spark, path)
    own = vectors.reference_system(spark, path)
    return [[[projection.between(*p, own, crs) for p in ring] for ring in rings] for rings in shape] if crs else shape


def area_of_interest(spark: SparkSession, request: Request, g: Grid) -> DataFrame:
    """The sides of the area of interest in pixels of a grid."""
    shape = projected(spark, request.aoi_path, g.crs)
    return vectors.edges(spark, [[[((x - g.c) / g.a, (y - g.f) / g.e) for x, y in ring] for ring in rings] for rings in shape])


def writable(spark: SparkSession, folder: str) -> bool:
    """Whether a file can be made in a folder, which is made if need be."""
    jvm = spark.sparkContext._jvm
    try:
        probe = jvm.org.apache.hadoop.fs.Path(folder, f".write_test-{uuid.uuid4().hex[:8]}")
        fs = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.create(probe, True).close()
        return fs.delete(probe, False)
    except Exception:  # noqa: BLE001  whatever the file system says, it can't be written
        return False


def aligned(spark: SparkSession, request: Request) -> tuple[DataFrame, Grid, list[str]]:
    """(row, col, before_*, after_*) of the pixels that are valid on both dates and inside the area of interest."""
    token = {"b04": "B04", "b03": "B03", "b02": "B02"}
    before, after = discovery.discover(spark, request.before_folder), discovery.discover(spark, request.after_folder)
    g, h = tiff.grids(spark, {"B04": before["B04"]})["B04"], tiff.grids(spark, {"B04": after["B04"]})["B04"]
    warnings = []

    def stack(paths: dict[str, str], date: str) -> DataFrame:
        px = tiff.scan(spark, paths).where(F.col("dn") != request.nodata_value)
        wide = px.groupBy("row", "col").agg(*[F.max(F.when(F.col("name") == token[b], F.col("dn"))).alias(f"{date}_{b}") for b in BANDS])
        return wide.dropna()

    one, two = stack(before, "before"), stack(after, "after")
    if (g.a, g.c, g.e, g.f, g.width, g.height) != (h.a, h.c, h.e, h.f, h.width, h.height):
        warnings.append("the later date was resampled to the earlier one's grid")
        two = raster.regrid(two, [f"after_{b}" for b in BANDS], h, g)
    px = one.join(two, ["row", "col"])
    if request.aoi_path:
        px = overlay.inside(scratch.kept(px, "both_dates"), area_of_interest(spark, request, g))
    px = scratch.kept(px.withColumns({f"{d}_{b}": F.col(f"{d}_{b}") / F.lit(request.reflectance_scale) for d in ("before", "after") for b in BANDS}), "aligned")
    if not px.take(1):
        raise AnalysisError("no pixel is valid on both dates inside the area of interest")
    return px, g, warnings


def run_pipeline(spark: SparkSession, request: Request, progress: Callable[[str, int], None] | None = None, cancelled: Callable[[], bool] | None = None) -> Result:
    began = time.time()

    def at(stage: str, percent: int) -> None:
        if cancelled and cancelled():
            raise CancelledError(stage)
        if progress:
            progress(stage, percent)

    at("validation", 5)
    report = scratch.kept(validate_request(spark, request), "issues")
    if validation.status(report) == "invalid":
        raise ConfigurationError("; ".join(f"{r['code']}: {r['message']}" for r in report.where("severity = 'error'").collect()))
    out = Result(run_id(request.run_label), _label(request.before_folder), _label(request.after_folder))
    at("alignment", 12)
    px, g, out.warnings = aligned(spark, request)
    out.grid, m, n = g, abs(g.a), px.count()
    out.counts["n_pixels"] = n
    out.tables["aligned"] = px

    def above(df: DataFrame, col: str, least: float) -> float:
        return 100.0 * df.where(F.col(col) > F.lit(least)).count() / n

    def clean(binary: DataFrame) -> DataFrame:
        op = request.morphology_operation if request.morphology_enabled else "none"
        fg = raster.morphology(binary.select("row", "col"), g.height, g.width, op, request.morphology_kernel_size)
        lab = raster.large(raster.components(scratch.kept(fg, "foreground")), raster.min_pixels(request.min_area_m2, g.pixel_area))
        if request.fill_holes:
            lab = raster.components(scratch.kept(raster.fill_holes(lab, g.height, g.width), "filled"))
        return scratch.kept(lab, "labels")

    primary = value = None
    if request.method in ("baseline", "both"):
        at("baseline", 42)
        base = scratch.kept(change.baseline(px), "baseline")
        t = change.threshold(base, "intensity", "otsu")  # whatever the request says: the baseline is always parted by Otsu
        out.tables["baseline"] = base
        out.shares["baseline"] = above(base, "intensity", t)
        primary, value, threshold, method = base, "intensity", t, "otsu"
    if request.method in ("cva", "both"):
        at("change vectors", 55)
        primary = scratch.kept(change.change_vectors(radiometry.normalize(px, request.normalization)), "vectors")
        value, method = "cva", request.threshold_method
        threshold = change.threshold(primary, "cva", method, request.percentile, request.manual_threshold)
        out.tables["vectors"] = primary
        out.shares["cva"] = above(primary, "cva", threshold)
    at("components", 68)
    binary = primary.withColumn("changed", F.col(value) > F.lit(threshold))
    labels = clean(binary.where("changed"))
    out.tables["labels"] = labels
    made, raw = features.metrics(labels, primary, value, m), labels.select("label").distinct().count()
    found = overlay.runs(labels)
    traps = scratch.kept(overlay.clip(found, area_of_interest(spark, request, g)) if request.aoi_path else overlay.pieces(found), "clipped")
    sides = scratch.kept(overlay.boundary(traps), "boundary")
    cut = scratch.kept(overlay.measures(sides, m).where("area_m2 > 1e-9"), "measures")
    after = cut.count()
    made = features.rounded(made.drop("area_m2", "perimeter_m", "compactness").join(cut, "label"))
    made = scratch.kept(made.where(F.col("area_m2") >= request.min_area_m2), "metrics")
    out.counts |= {"n_raw_components": raw, "n_after_aoi": after, "n_after_min_area": made.count()}
    grid = None
    extra = {"gi_zscore": "double", "gi_pvalue": "double", "gi_qvalue": "double", "hotspot_class": "string", "lisa_cluster": "string", "ml_anomaly_score": "double", "ml_cluster_id": "double"}
    if request.spatial_statistics_enabled and value == "cva":
        at("spatial statistics", 82)
        grid = statistics(spark, request, binary, m, out)
        have = [c for c in extra if c in grid.columns]
        numeric = [c for c in have if extra[c] == "double"]
        made = made.join(features.attach(labels, grid, request.spatial_grid_size_m / m, numeric, [c for c in have if c not in numeric], m), "label", "left")
    elif request.spatial_statistics_enabled:
        out.warnings.append("spatial statistics need change vectors")
    made = made.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in made.columns})
    made = features.confidence(scratch.kept(made, "features"), threshold, "ml_anomaly_score" if request.spatial_ml_enabled else None)
    made = features.numbered(made, ["label"]).withColumns({"date_before": F.lit(out.before_date), "date_after": F.lit(out.after_date), "method": F.lit(request.method), "threshold_method": F.lit(method), "threshold_value": F.lit(threshold)})
    large = sides.join(F.broadcast(made.select("label")) if out.counts["n_after_min_area"] <= 100_000 else made.select("label"), "label", "left_semi")
    out.tables["outlines"] = shapes = scratch.kept(overlay.shapes(scratch.kept(overlay.rings(large), "rings"), g.c, g.a, g.f, g.e), "outlines")
    out.tables["change_features"] = made = scratch.kept(made.join(overlay.as_wkb(shapes), "label"), "change_features")
    if grid is not None:
        out.tables["spatial_grid"] = grid
    s = made.agg(F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("area"), F.count("*").alias("n"), F.coalesce(F.max("area_m2"), F.lit(0.0)).alias("top"), F.count_if(F.col("hotspot_class").isin("hot_95", "hot_99")).alias("hot")).first()
    out.runtime_seconds = round(time.time() - began, 3)
    out.started_at = datetime.fromtimestamp(began, UTC).isoformat()
    moran = out.moran or {}
    out.summary = {
        "date_before": out.before_date, "date_after": out.after_date, "method": request.method, "threshold_method": method, "threshold": threshold, "changed_area_m2": s["area"],
        "changed_area_percent": 100.0 * s["area"] / (n * g.pixel_area), "feature_count": s["n"], "global_moran_i": moran.get("i"), "global_moran_p": moran.get("p_sim"), "hotspot_95_count": s["hot"],
        "largest_change_area_m2": s["top"], "runtime_seconds": out.runtime_seconds, "random_seed": request.random_seed,
    }
    at("catalog", 94)
    catalog(spark, request, out, report)
    at("done", 100)
    return out


def statistics(spark: SparkSession, request: Request, binary: DataFrame, pixel_m: float, out: Result) -> DataFrame:
    """The grid with autocorrelation and, if asked for, anomaly scores."""
    grid = scratch.kept(cells.grid(binary, request.spatial_grid_size_m / pixel_m), "grid")
    w = scratch.kept(cells.weights(grid, request.spatial_weights, request.knn_k, request.row_standardization), "weights")
    if n := cells.islands(grid, w).count():
        out.warnings.append(f"{n} cells have no neighbour")
    p = request.permutations
    out.moran = cells.global_moran(grid, w, "mean_cva") | (cells.moran_permutations(grid, w, "mean_cva", p, request.random_seed) if p else {})
    ones = w.withColumn("w", F.lit(1.0))
    told = cells.local_moran(grid, w, "mean_cva").join(cells.gi_star(grid, ones, "mean_cva"), "id")
    if p:
        local = cells.local_permutations(grid, w, "mean_cva", "moran", p, request.random_seed).select("id", F.col("p_sim").alias("local_moran_p"))
        gi = cells.local_permutations(grid, ones, "mean_cva", "gi", p, request.random_seed).select("id", F.col("p_sim").alias("gi_pvalue"), F.col("z_sim").alias("z"))
        told = told.join(local, "id", "left").join(gi, "id", "left").withColumn("gi_zscore", F.coalesce("z", "gi_zscore")).drop("z")
    else:
        told = told.withColumns({"local_moran_p": F.lit(None).cast("double"), "gi_pvalue": cells.normal_p(F.col("gi_zscore"))})
    told = scratch.kept(told.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("local_moran_p", "gi_pvalue")}), "local")
    told = cells.bh_fdr(told, "gi_pvalue", "id", "gi_qvalue") if request.fdr_correction else told.withColumn("gi_qvalue", F.col("gi_pvalue"))
    told = told.withColumns({"hotspot_class": cells.hotspot_class(F.col("gi_zscore"), F.col("gi_qvalue")), "lisa_cluster": cells.lisa_cluster(F.col("quadrant"), F.col("local_moran_p"), request.alpha)})
    grid = scratch.kept(features.numbered(grid.join(told, cells.cell_id() == F.col("id")), ["cell_row", "cell_col"], "grid_id"), "grid")
    if request.spatial_ml_enabled and grid.count() < ml.LEAST_CELLS:
        out.warnings.append(f"fewer than {ml.LEAST_CELLS} cells: no anomaly scores")
    elif request.spatial_ml_enabled:
        if missing := sorted(set(ml.FEATURES) - set(grid.columns)):
            out.warnings.append(f"anomaly scores go without {', '.join(missing)}")
        x, cols = ml.features(grid, request.ml_use_coordinates or request.ml_model != "isolation_forest")
        if request.ml_model == "isolation_forest":
            out.anomalies = {"model": request.ml_model, "n_cells": x.count(), "features": cols} | forest_checks(request, x, cols)
            return scratch.kept(ml.ranked(ml.isolation_forest(x, "id", cols, request.ml_n_estimators, request.random_seed), "ml_anomaly_score").withColumn("ml_cluster_id", F.lit(-1.0)), "scored")
        some = scratch.kept(ml.robust_scale(x.where("changed_proportion > 0"), cols).select("id", *cols), "points")
        if some.count() >= ml.LEAST_CELLS:
            c = ml.dbscan(some, "id", cols, request.dbscan_eps, request.dbscan_min_samples)
            out.anomalies = {"model": "dbscan", "n_cells": some.count(), "features": cols, "sensitivity": ml.dbscan_sensitivity(some, "id", cols, request.dbscan_eps, request.dbscan_min_samples)}
            c = c.withColumns({"ml_anomaly_score": F.when(F.col("ml_cluster_id") == -1, 1.0).otherwise(0.0), "ml_cluster_id": F.col("ml_cluster_id").cast("double")})
            return scratch.kept(grid.join(ml.ranked(c, "ml_anomaly_score"), "id", "left"), "scored")
    return grid


def forest_checks(request: Request, x: DataFrame, cols: list[str]) -> dict:
    """How far the forest's top cells hold when blocks of cells are left out, and when more or fewer anomalies are expected."""
    out = {"sensitivity": ml.contamination_sensitivity(x, "id", cols, request.ml_contamination, trees=request.ml_n_estimators, seed=request.random_seed)}
    if request.ml_n_bootstrap > 0:
        out["stability"] = ml.forest_stability(x, "id", cols, request.ml_n_bootstrap, trees=request.ml_n_estimators, seed=request.random_seed)
    return out


def catalog(spark: SparkSession, request: Request, out: Result, report: DataFrame) -> None:
    """The run's tables as temporary views, with its metadata and checks."""
    meta = {"run_id": out.run_id, "run_timestamp": datetime.now(UTC).isoformat(), "before_folder": request.before_folder, "after_folder": request.after_folder, "before_date": out.before_date, "after_date": out.after_date, "aoi_path": request.aoi_path, "crs": out.grid.crs, "pixel_size_m": out.grid.a, "threshold_value": out.summary["threshold"]}
    meta |= {k: getattr(request, k) for k in ("method", "normalization", "threshold_method", "min_area_m2", "spatial_statistics_enabled", "spatial_grid_size_m", "spatial_ml_enabled", "random_seed")}
    text = {k: None if v is None else json.dumps(v) if isinstance(v, dict | list) else str(v) for k, v in meta.items()}
    out.tables["run_metadata"] = spark.createDataFrame([tuple(text.values())], ", ".join(f"{k} string" for k in text))
    checks = [(i + 1, out.run_id, r["code"], r["severity"], r["message"], None) for i, r in enumerate(report.collect())]
    checks += [(len(checks) + 1 + i, out.run_id, "warning", "warning", w, None) for i, w in enumerate(out.warnings)]
    out.tables["quality_checks"] = spark.createDataFrame(checks, "id int, run_id string, check_name string, severity string, message string, context_json string")
    for name in ("change_features", "spatial_grid", "run_metadata", "quality_checks"):
        if name in out.tables:
            out.tables[name].createOrReplaceTempView(name)

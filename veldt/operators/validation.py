"""Validation: each rule is a query that yields issues; a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_RATIO = 0.5


def _issue(df: DataFrame, severity: str, code: str, message) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def issues(meta: DataFrame) -> DataFrame:
    """(severity, code, message) of band metadata (date, band, crs, width, height, transform, valid_ratio)."""
    at = F.concat_ws(" ", "date", "band")
    w = Window.partitionBy("date").orderBy("band")
    m = meta.withColumns({f"{c}_0": F.first(c).over(w) for c in ("crs", "width", "height", "transform")})
    rules = [
        _issue(m.where("crs is null"), "error", "missing_crs", at),
        _issue(m.where(F.col("valid_ratio") < LOW_RATIO), "warning", "low_valid_ratio", at),
        _issue(m.where("not (crs <=> crs_0)"), "error", "band_crs_mismatch", at),
        _issue(m.where("width <> width_0 or height <> height_0"), "error", "band_dimension_mismatch", at),
        _issue(m.where("transform <> transform_0"), "error", "band_transform_mismatch", at),
    ]
    return reduce(DataFrame.unionByName, rules)


def between_dates(meta: DataFrame) -> DataFrame:
    """Warnings where the two dates' grids differ; only asked for without errors."""
    b = meta.where("band = 'B04'").groupBy().agg(F.count_distinct(F.coalesce("crs", F.lit(""))).alias("crs"), F.count_distinct("transform", "width", "height").alias("grid"))
    crs = _issue(b.where("crs > 1"), "warning", "date_crs_mismatch", F.lit("the dates' reference systems differ"))
    grid = _issue(b.where("crs = 1 and grid > 1"), "warning", "date_grid_mismatch", F.lit("the dates' grids differ"))
    return crs.unionByName(grid)


def parameters(spark, request) -> DataFrame:
    """Issues of a request's parameters."""
    found = []
    if request.threshold_method == "manual" and request.manual_threshold is None:
        found.append(("error", "missing_manual_threshold", "a manual threshold needs a value"))
    if not 0 <= request.percentile <= 100:
        found.append(("error", "invalid_percentile", str(request.percentile)))
    if request.min_area_m2 < 0:
        found.append(("error", "invalid_min_area", str(request.min_area_m2)))
    if request.grid_size_m <= 0:
        found.append(("error", "invalid_grid_size", str(request.grid_size_m)))
    if request.method not in ("baseline", "cva", "both"):
        found.append(("error", "invalid_method", request.method))
    return spark.createDataFrame(found, "severity string, code string, message string")


def status(report: DataFrame) -> str:
    r = report.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w")).first()
    return "invalid" if r["e"] else "valid_with_warnings" if r["w"] else "valid"

"""Change features: metrics of components, confidence, and attributes from grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.ranks import placed
from veldt.operators.raster import perimeter

#: Weights of mean excess, consistency, size, hotspot and anomaly score. Fixed values.
WEIGHTS = {"excess": 0.30, "consistency": 0.20, "size": 0.20, "hotspot": 0.20, "anomaly": 0.10}
HOTSPOT_SCORE = {"hot_99": 1.0, "hot_95": 0.85, "hot_90": 0.6, "cold_99": 0.0, "cold_95": 0.0, "cold_90": 0.0}
HOTSPOT_ELSE = 0.3
EPS = 1e-9


def metrics(labels: DataFrame, intensity: DataFrame, value: str, pixel_m: float) -> DataFrame:
    """(label, area_m2, perimeter_m, compactness, mean_change, max_change, p95_change) by component."""
    v = labels.join(intensity.select("row", "col", F.col(value).alias("v")), ["row", "col"], "left")
    told = v.groupBy("label").agg((F.count("*") * F.lit(pixel_m * pixel_m)).alias("area_m2"), F.avg("v").alias("mean_change"), F.max("v").alias("max_change"), F.percentile("v", F.lit(0.95)).alias("p95_change"))
    return rounded(told.join(perimeter(labels, pixel_m), "label"))


def rounded(features: DataFrame) -> DataFrame:
    """Adds compactness: 1 for a circle."""
    share = F.least(4 * F.pi() * F.col("area_m2") / F.pow("perimeter_m", 2), F.lit(1.0))
    return features.withColumn("compactness", F.when(F.col("perimeter_m") > 0, share).otherwise(F.lit(0.0)))


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def confidence(features: DataFrame, threshold: float, anomaly: str | None = None) -> DataFrame:
    """A 0 to 1 heuristic; without anomaly scores the other weights share theirs."""
    top = features.agg(F.max("mean_change").alias("mean"), F.max("area_m2").alias("area"), *([F.min(anomaly).alias("lo"), F.max(anomaly).alias("hi")] if anomaly else [])).first()
    if top["mean"] is None:
        return features.withColumn("confidence", F.lit(None).cast("double"))
    parts = {
        "excess": _clip((F.col("mean_change") - threshold) / F.lit(top["mean"] - threshold + EPS)),
        "consistency": _clip(1 - (F.col("max_change") - F.col("mean_change")) / (F.col("max_change") + EPS)),
        "size": _clip(F.log1p("area_m2") / F.log1p(F.lit(top["area"] + EPS))),
        "hotspot": F.coalesce(*[F.when(F.col("hotspot_class") == k, F.lit(v)) for k, v in HOTSPOT_SCORE.items()], F.lit(HOTSPOT_ELSE)),
    }
    if anomaly:
        span = (top["hi"] or 0.0) - (top["lo"] or 0.0)
        parts["anomaly"] = F.coalesce((F.col(anomaly) - F.lit(top["lo"])) / F.lit(span), F.lit(0.0)) if span > 0 else F.lit(0.0)
    whole = sum(WEIGHTS[k] for k in parts)
    return features.withColumn("confidence", _clip(sum((F.lit(WEIGHTS[k] / whole) * c for k, c in parts.items()), F.lit(0.0))))


def attach(labels: DataFrame, grid: DataFrame, cell_px: float, numeric: list[str], category: list[str], pixel_m: float) -> DataFrame:
    """(label, means of ``numeric`` by overlap, ``category`` of the cell with the greatest overlap, least cell first).

    A pixel that a cell's border cuts belongs to both cells by its share of area."""
    whole = float(cell_px).is_integer()
    cut = labels.select("label", "row", "col")
    for c in ("row", "col"):
        first = F.floor(F.col(c) / cell_px)
        if whole:  # borders of cells are borders of pixels
            cut = cut.withColumns({f"cell_{c}": first, f"_{c}": F.lit(1.0)})
        else:
            cut = cut.withColumn(f"cell_{c}", F.explode(F.sequence(first, F.ceil((F.col(c) + 1) / cell_px) - 1)))
            cut = cut.withColumn(f"_{c}", F.least(F.col(c) + 1.0, (F.col(f"cell_{c}") + 1) * cell_px) - F.greatest(F.col(c).cast("double"), F.col(f"cell_{c}") * cell_px))
    share = cut.groupBy("label", "cell_row", "cell_col").agg((F.sum(F.col("_row") * F.col("_col")) * F.lit(pixel_m * pixel_m)).alias("w"))
    met = share.join(grid, ["cell_row", "cell_col"])
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c)
    rank = F.struct(F.col("w"), -F.col("cell_row"), -F.col("cell_col"))
    return met.groupBy("label").agg(*[mean(c) for c in numeric], *[F.max_by(c, rank).alias(c) for c in category])


def numbered(features: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Sequential ids from 1."""
    return placed(features, [F.col(c) for c in order], name, 1).withColumn(name, F.col(name).cast("int"))

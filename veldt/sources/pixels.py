"""The pixel view: co-registered rasters as one row for each pixel, bands as columns.

The driver's tables hold no imagery, so a frame of 100 columns is derived from ``orders``, whose key is contiguous:
random background, a coherent block of change, speckle, and a first row and column without data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Geometry of the frame. Fixed values.
WIDTH, PIXEL_M, ORIGIN_X, ORIGIN_Y, CRS = 100, 10.0, 500_000.0, 8_600_000.0, "EPSG:32735"
BANDS = ("b04", "b03", "b02")
SCALE = 10_000.0


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, row, col, before_*, after_*): digital numbers of both dates; pixels without data are 0."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    row, col = F.floor(k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    before = {"b04": 1400 + F.floor("o_totalprice") % 500, "b03": 1200 + (cust * 31) % 500, "b02": 1000 + (k * 7919) % 500}
    noise = {"b04": (cust * 7919) % 41 - 20, "b03": (cust * 104729) % 31 - 15, "b02": (k * 1299709) % 21 - 10}
    block = F.when((row % 30).between(5, 14) & col.between(5, 14), 800).when((k * 48271) % 199 == 0, 800).otherwise(0)
    data = (row > 0) & (col > 0)
    bands = {f"before_{b}": F.when(data, before[b].cast("double")).otherwise(F.lit(0.0)) for b in BANDS}
    bands |= {f"after_{b}": F.when(data, (before[b] + noise[b] + block).cast("double")).otherwise(F.lit(0.0)) for b in BANDS}
    return o.select(k.alias("pid"), row.alias("row"), col.alias("col"), *[v.alias(n) for n, v in bands.items()])


def valid(prefix: str, nodata: float = 0.0):
    """A pixel has data when no band of the date holds the sentinel."""
    out = F.lit(True)
    for b in BANDS:
        out = out & (F.col(f"{prefix}_{b}") != nodata)
    return out


def reflectance(pixels: DataFrame, scale: float = SCALE) -> DataFrame:
    return pixels.withColumns({f"{d}_{b}": F.col(f"{d}_{b}") / F.lit(scale) for d in ("before", "after") for b in BANDS})


def usable(spark: SparkSession, sf_dir: str, nodata: float = 0.0) -> DataFrame:
    """Reflectances of the pixels that have data on both dates."""
    return reflectance(frame(spark, sf_dir).where(valid("before", nodata) & valid("after", nodata)))


def height(pixels: DataFrame) -> int:
    return (pixels.agg(F.max("row")).first()[0] or 0) + 1

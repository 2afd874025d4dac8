"""Change intensity: the baseline distance and robust change vectors, and thresholds on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.errors import AnalysisError
from veldt.functions.quantiles import quantiles
from veldt.operators.radiometry import MAD_SCALE, TINY_SCALE, median_mad
from veldt.sources.pixels import BANDS

TINY_RANGE, BINS = 1e-12, 256


def diff(b: str):
    return F.col(f"after_{b}") - F.col(f"before_{b}")


def baseline(df: DataFrame) -> DataFrame:
    """distance: Euclidean over bands; intensity: scaled to [0, 1] by the least and greatest distance."""
    out = df.withColumn("distance", F.sqrt(sum((diff(b) * diff(b) for b in BANDS[1:]), diff(BANDS[0]) * diff(BANDS[0]))))
    lo, hi = out.agg(F.min("distance"), F.max("distance")).first()
    if lo is None or hi - lo < TINY_RANGE:
        return out.withColumn("intensity", F.lit(0.0))
    return out.withColumn("intensity", F.least(F.greatest((F.col("distance") - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0)), F.lit(1.0)))


def as_bytes(df: DataFrame, intensity: str = "intensity") -> DataFrame:
    """change_byte: an intensity of 0 to 1 as 0 to 255, cut, not rounded; null where it is null."""
    return df.withColumn("change_byte", F.floor(F.col(intensity) * 255).cast("int"))


def scale_top(df: DataFrame, value: str, share: float = 0.98) -> float:
    """Where the scale of a picture ends: a quantile of the values above 0; 1 where there are none."""
    top = quantiles(df, {value: F.when(F.col(value) > 0, F.col(value))}, [share])[value][0]
    return 1.0 if top is None else top


def change_vectors(df: DataFrame) -> DataFrame:
    """z_* by median and MAD (or standard deviation where the MAD vanishes), cva: their length, brightness_diff."""
    diffs = {b: diff(b) for b in BANDS}
    stats = median_mad(df, diffs)
    spread = df.agg(*[F.stddev_pop(c).alias(b) for b, c in diffs.items()]).first()
    z = {}
    for b, c in diffs.items():
        med, mad = stats[b]
        scale = MAD_SCALE * mad if mad is not None else 0.0
        if scale < TINY_SCALE:
            scale = spread[b] if (spread[b] or 0) > TINY_SCALE else 1.0
        z[f"z_{b}"] = (c - F.lit(med)) / F.lit(scale)
    out = df.withColumns(z)
    length = F.sqrt(sum((F.col(k) * F.col(k) for k in list(z)[1:]), F.col(f"z_{BANDS[0]}") * F.col(f"z_{BANDS[0]}")))
    return out.withColumns({"cva": length, "brightness_diff": sum((diffs[b] for b in BANDS[1:]), diffs[BANDS[0]]) / len(BANDS)})


def histogram(df: DataFrame, col: str) -> tuple[DataFrame, float, float]:
    """(bin, n) over 256 equal bins between the least and greatest value, the last closed."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        raise AnalysisError("no valid pixels")
    width = hi - lo
    at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width) * BINS), F.lit(BINS - 1)).cast("int") if width > 0 else F.lit(0)
    return df.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")), lo, hi


def otsu(df: DataFrame, col: str) -> float:
    """The bin centre that parts the histogram with the greatest variance between classes; the least on ties."""
    hist, lo, hi = histogram(df, col)
    if hi == lo:
        return lo
    h = hist.withColumn("c", F.lit(lo) + (F.col("bin") + 0.5) * F.lit(hi - lo) / BINS)
    # At most 256 rows: one task is enough.
    up, every = Window.orderBy("bin"), Window.partitionBy()
    h = h.withColumns({"w1": F.sum("n").over(up), "s1": F.sum(F.col("n") * F.col("c")).over(up), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("c")).over(every)})
    w2 = F.col("w") - F.col("w1")
    h = h.where(w2 > 0).withColumn("between", F.col("w1").cast("double") * w2 * F.pow(F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / w2, 2))
    return h.orderBy(F.desc("between"), "c").select("c").first()[0]


def threshold(df: DataFrame, col: str, method: str = "otsu", percentile: float = 95.0, manual: float | None = None) -> float:
    if method == "otsu":
        return otsu(df, col)
    if method == "percentile":
        if not 0 <= percentile <= 100:
            raise AnalysisError("percentile must be from 0 to 100")
        value = quantiles(df, {"v": F.col(col)}, [percentile / 100])["v"][0]
        if value is None:
            raise AnalysisError("no valid pixels")
        return value
    if method == "manual":
        if manual is None:
            raise AnalysisError("a manual threshold needs a value")
        return manual
    raise AnalysisError(f"unknown threshold method {method!r}")

"""Radiometry: bringing the later date onto the earlier one's scale, and display stretches.

Global statistics come first, as a handful of numbers on the driver; the projection that applies them is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.quantiles import quantiles
from veldt.sources.pixels import BANDS

#: Fixed values of the method.
MAD_SCALE, TINY_MAD, TINY_SCALE = 1.4826, 1e-6, 1e-6
PIF_SHARE, PIF_LEAST = 0.10, 30


def median_mad(df: DataFrame, cols: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Median and median absolute deviation of each expression."""
    med = {k: v[0] for k, v in quantiles(df, cols, [0.5]).items()}
    mad = quantiles(df, {k: F.abs(c - F.lit(med[k])) for k, c in cols.items()}, [0.5])
    return {k: (med[k], mad[k][0]) for k in cols}


def _bands(date: str) -> dict[str, Column]:
    return {f"{date}_{b}": F.col(f"{date}_{b}") for b in BANDS}


def _linear(df: DataFrame, fits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"after_{b}": F.col(f"after_{b}") * F.lit(fits[b][0]) + F.lit(fits[b][1]) for b in BANDS})


def robust_median_mad(df: DataFrame) -> DataFrame:
    s = median_mad(df, _bands("before") | _bands("after"))
    out = {}
    for b in BANDS:
        (mb, db), (ma, da) = s[f"before_{b}"], s[f"after_{b}"]
        scale = db / da if da > TINY_MAD else 1.0
        out[f"after_{b}"] = (F.col(f"after_{b}") - F.lit(ma)) * F.lit(scale) + F.lit(mb)
    return df.withColumns(out)


def percentile_matching(df: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    q = quantiles(df, _bands("before") | _bands("after"), [low, high])
    fits = {}
    for b in BANDS:
        (bl, bh), (al, ah) = q[f"before_{b}"], q[f"after_{b}"]
        scale = (bh - bl) / ((ah - al) or 1.0)
        fits[b] = (scale, bl - al * scale)
    return _linear(df, fits)


def pif_linear(df: DataFrame) -> DataFrame:
    """A line for each band, fitted to the pixels that changed least; to all where those are too few."""
    dist = F.sqrt(sum((F.pow(F.col(f"after_{b}") - F.col(f"before_{b}"), 2) for b in BANDS), F.lit(0.0)))
    edge = quantiles(df, {"d": dist}, [PIF_SHARE])["d"][0]
    told = lambda d: d.agg(F.count("*").alias("n"), *[f(F.col(f"before_{b}"), F.col(f"after_{b}")).alias(f"{b}_{n}") for b in BANDS for n, f in (("a", F.regr_slope), ("b", F.regr_intercept))]).first()
    r = told(df.where(dist <= F.lit(edge)))
    if r["n"] < PIF_LEAST:
        r = told(df)
    return _linear(df, {b: (r[f"{b}_a"], r[f"{b}_b"]) for b in BANDS})


NORMALIZATIONS = {"robust_median_mad": robust_median_mad, "percentile_matching": percentile_matching, "pif_linear": pif_linear, "none": lambda df: df}


def normalize(df: DataFrame, method: str) -> DataFrame:
    if method not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization {method!r}")
    return NORMALIZATIONS[method](df)


def rgb_stretch(df: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Both dates as 0 to 255, by the earlier date's percentiles."""
    q = quantiles(df, _bands("before"), [low, high])
    out = {}
    for d in ("before", "after"):
        for b in BANDS:
            lo, hi = q[f"before_{b}"]
            hi = hi if hi > lo else lo + 1
            out[f"{d}_{b}"] = F.floor(F.least(F.greatest((F.col(f"{d}_{b}") - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return df.withColumns(out)

"""Exact order statistics of whole columns, at any size.

The built-in exact percentile gathers every distinct value in one task. Beyond ``GATHER`` rows a quantile sketch first
brackets each rank between two values, within its guaranteed error; what lies below a bracket is counted, and only the
few different values inside it are gathered. All columns and shares go together through each pass. Both ways give the
same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATHER = 100_000
#: A sketch's ranks are off by at most one ACCURACY-th of its rows; so many values are gathered at most.
ACCURACY, HELD = 10_000, 200_000


def _within(v: Column, lo: float, hi: float) -> Column:
    """A range's ends are infinite where it is open."""
    tests = [t for t, use in ((v >= F.lit(lo), lo > -math.inf), (v <= F.lit(hi), hi < math.inf)) if use]
    return F.when(tests[0] & tests[-1], v) if tests else v


def _nth(values: DataFrame, wanted: list[tuple[str, int]], sizes: dict[str, int]) -> list[tuple[float, float]]:
    """For each (column, rank) the values at that 0-based rank and, but for the last one, the next. ``sizes`` counts each
    column's values, which are not NaN."""
    spans = [(-math.inf, math.inf, 0, sizes[c]) for c, _ in wanted]  # least and greatest value, rows before, rows within
    pair = [(r, min(r + 1, sizes[c] - 1)) for c, r in wanted]
    slack = 2 / ACCURACY
    while True:
        shares, sketches = [], {}  # one sketch for all ranks in a column's range
        for (c, _), (r0, r1), (lo, hi, before, n) in zip(wanted, pair, spans, strict=True):
            shares.append((max((r0 - before) / n - slack, 0.0), min((r1 + 1 - before) / n + slack, 1.0)))
            sketches.setdefault((c, lo, hi), []).extend(shares[-1])
        got = values.agg(*[F.percentile_approx(_within(F.col(c), lo, hi), F.lit(sh), ACCURACY) for (c, lo, hi), sh in sketches.items()]).first()
        ends = {(*k, s): v for (k, sh), vs in zip(sketches.items(), got, strict=True) for s, v in zip(sh, vs, strict=True)}
        new = [(lo if a == 0 else ends[c, lo, hi, a], hi if b == 1 else ends[c, lo, hi, b]) for (c, _), (a, b), (lo, hi, _, _) in zip(wanted, shares, spans, strict=True)]
        told = []
        for i, ((c, _), (lo, hi)) in enumerate(zip(wanted, new, strict=True)):
            told += [F.count_if(F.col(c) < F.lit(lo)).alias(f"b{i}"), F.count(_within(F.col(c), lo, hi)).alias(f"n{i}"), F.count_if((F.col(c) > F.lit(lo)) & (F.col(c) < F.lit(hi))).alias(f"m{i}")]
        got = values.agg(*told).first()
        held = [got[f"b{i}"] <= r0 and r1 < got[f"b{i}"] + got[f"n{i}"] for i, (r0, r1) in enumerate(pair)]
        # A bracket that misses, which the sketch rules out, is taken wider.
        spans = [(*new[i], got[f"b{i}"], got[f"n{i}"]) if held[i] else spans[i] for i in range(len(wanted))]
        if not all(held):
            slack *= 8
        elif sum(got[f"m{i}"] for i in range(len(wanted))) <= HELD or slack > 1:
            break
    inside = F.array(*[F.when(_within(F.col(c), lo, hi).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(c).alias("x"))) for i, ((c, _), (lo, hi, _, _)) in enumerate(zip(wanted, spans, strict=True))])
    found: dict[int, list] = {}
    for r in values.select(F.explode(inside).alias("t")).where("t is not null").groupBy("t.i", "t.x").agg(F.count("*").alias("n")).collect():
        found.setdefault(r["i"], []).append((r["x"], r["n"]))
    out = []
    for i, ranks in enumerate(pair):
        up_to, v = spans[i][2], []
        for x, n in sorted(found[i]):
            v += [x] * sum(up_to <= r < up_to + n for r in ranks)
            up_to += n
        out.append((v[0], v[1]))
    return out


def quantiles(df: DataFrame, cols: dict[str, Column], shares: list[float], rows: int | None = None) -> dict[str, list[float | None]]:
    """For each named expression its quantiles, interpolated linearly; nulls are left out, NaN is the greatest value; None
    without values."""
    n = df.count() if rows is None else rows
    if n <= GATHER:
        r = df.agg(*[F.percentile(c, F.array(*[F.lit(float(s)) for s in shares])).alias(k) for k, c in cols.items()]).first()
        return {k: list(r[k]) if r[k] is not None else [None] * len(shares) for k in cols}
    names = {k: f"v{i}" for i, k in enumerate(cols)}
    values = df.select(*[c.cast("double").alias(names[k]) for k, c in cols.items()])
    told = values.agg(*[F.count(v).alias(v) for v in names.values()], *[F.count_if(F.isnan(v)).alias(f"{v}_nan") for v in names.values()]).first()
    values = values.select(*[F.when(~F.isnan(v), F.col(v)).alias(v) if told[f"{v}_nan"] else F.col(v) for v in names.values()])
    sizes = {v: told[v] - told[f"{v}_nan"] for v in names.values()}
    at = {(k, s): s * (told[v] - 1) for k, v in names.items() for s in shares if told[v]}
    wanted = sorted({(names[k], int(a)) for (k, _), a in at.items() if int(a) < sizes[names[k]]})
    found = dict(zip(wanted, _nth(values, wanted, sizes), strict=True)) if wanted else {}

    def value(k: str, s: float) -> float | None:
        v, a = names[k], at.get((k, s))
        if a is None:
            return None
        if min(int(a) + (a > int(a)), told[v] - 1) >= sizes[v]:
            return math.nan
        x, y = found[v, int(a)]
        return x + (a - int(a)) * (y - x)

    return {k: [value(k, s) for s in shares] for k in cols}

"""The analysis grid, contiguity weights, and spatial autocorrelation on its cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import scratch
from veldt.errors import AnalysisError
from veldt.functions.permutation import permuted, places
from veldt.operators.ranks import placed, running
from veldt.sources.pixels import BANDS

QUEEN = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
ROOK = [(-1, 0), (1, 0), (0, -1), (0, 1)]
LEAST_CELLS = 8


def grid(pixels: DataFrame, cell_px: float, cva: str = "cva", changed: str = "changed") -> DataFrame:
    """A row for each cell with a valid pixel: counts, means, order statistics and spreads."""
    if cell_px <= 1:
        raise AnalysisError("cells must be larger than pixels")
    by = [F.floor((F.col("row") + 0.5) / cell_px).cast("long").alias("cell_row"), F.floor((F.col("col") + 0.5) / cell_px).cast("long").alias("cell_col")]
    v = F.col(cva)
    diffs = [F.avg(F.col(f"after_{b}") - F.col(f"before_{b}")).alias(f"mean_diff_{b}") for b in BANDS]
    out = pixels.groupBy(*by).agg(
        F.count("*").alias("valid_pixel_count"), F.avg(v).alias("mean_cva"), F.median(v).alias("median_cva"), F.percentile(v, F.lit(0.9)).alias("p90_cva"), F.percentile(v, F.lit(0.95)).alias("p95_cva"),
        F.avg(F.col(changed).cast("double")).alias("changed_proportion"), *diffs, F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("local_std_cva"),
    )
    return out.withColumn("total_pixel_count", F.col("valid_pixel_count"))


def cell_id() -> Column:
    """A cell's number: order of (row, column), stable whatever other cells exist."""
    return F.col("cell_row") * (1 << 31) + F.col("cell_col")


def contiguity(cells: DataFrame, kind: str = "queen") -> DataFrame:
    """(src, dst): neighbours by an equi-join on moved cells, never by a range join."""
    if kind not in ("queen", "rook"):
        raise AnalysisError(f"unknown weights {kind!r}")
    to = F.explode(F.array(*[F.struct((F.col("cell_row") + a).alias("r"), (F.col("cell_col") + b).alias("c")) for a, b in (QUEEN if kind == "queen" else ROOK)]))
    at = cells.select(cell_id().alias("src"), to.alias("t")).select("src", (F.col("t.r") * (1 << 31) + F.col("t.c")).alias("dst"))
    return at.join(cells.select(cell_id().alias("dst")), "dst", "left_semi").select("src", "dst")


def nearest(cells: DataFrame, k: int = 8) -> DataFrame:
    """(src, dst): the k nearest other cells by centre, ties by number. Rings of cells around each are tried, wider
    until every cell has its k within the ring's safe distance; only cells that lack some go on."""
    ids = cells.select(cell_id().alias("id"), "cell_row", "cell_col")
    n = ids.count()
    want, todo, done, reach = min(k, n - 1), ids, None, 1
    while (2 * reach + 1) ** 2 - 1 < k:
        reach += 1
    extent = cells.agg(F.max("cell_row") - F.min("cell_row"), F.max("cell_col") - F.min("cell_col")).first()
    while want > 0:
        steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) != (0, 0)]))
        at = todo.select(F.col("id").alias("src"), "cell_row", "cell_col", steps.alias("s"))
        at = at.select("src", ((F.col("cell_row") + F.col("s.a")) * (1 << 31) + F.col("cell_col") + F.col("s.b")).alias("dst"), (F.col("s.a") * F.col("s.a") + F.col("s.b") * F.col("s.b")).alias("d2"))
        met = at.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        near = met.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("i") <= want)
        last = reach >= max(extent)
        good = near.groupBy("src").agg(F.count("*").alias("n"), F.max("d2").alias("far")).where((F.col("n") == want) & (F.lit(last) | (F.col("far") <= reach * reach))).select("src")
        found = near.join(good, "src", "left_semi").select("src", "dst")
        done = found if done is None else done.unionByName(found)
        if last:
            break
        todo = todo.join(good.withColumnRenamed("src", "id"), "id", "left_anti")
        if not todo.take(1):
            break
        reach *= 2
    return done if done is not None else ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)


def weights(cells: DataFrame, kind: str = "queen", k: int = 8, row_standardize: bool = True) -> DataFrame:
    """(src, dst, w)."""
    edges = nearest(cells, k) if kind == "knn" else contiguity(cells, kind)
    w = F.lit(1.0)
    if row_standardize:
        w = F.lit(1.0) / F.count("*").over(Window.partitionBy("src"))
    return edges.withColumn("w", w)


def islands(cells: DataFrame, edges: DataFrame) -> DataFrame:
    return cells.join(edges.select(F.col("src")), cell_id() == F.col("src"), "left_anti")


def _values(cells: DataFrame, value: str) -> tuple[DataFrame, dict]:
    v = cells.select(cell_id().alias("id"), F.col(value).cast("double").alias("y"))
    s = v.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.sum("y").alias("sum"), F.stddev_pop("y").alias("sd")).first().asDict()
    if s["n"] < LEAST_CELLS:
        raise AnalysisError(f"at least {LEAST_CELLS} cells are needed")
    return v, s


def global_moran(cells: DataFrame, edges: DataFrame, value: str) -> dict[str, float]:
    """I, its expectation, and variance, z and p under normality."""
    v, s = _values(cells, value)
    z = v.select("id", (F.col("y") - F.lit(s["mean"])).alias("z"))
    lag = edges.join(z.select(F.col("id").alias("src"), F.col("z").alias("zi")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst")
    a = lag.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0")).first()
    den = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("w2"))
    # A one-way edge counts as (w + 0)^2 from both its ends.
    s1 = edges.join(back, ["src", "dst"], "left").agg(F.sum(F.when(F.col("w2").isNull(), F.col("w") * F.col("w")).otherwise(0.5 * F.pow(F.col("w") + F.col("w2"), 2)))).first()[0]
    both = edges.select(F.col("src").alias("id"), "w").unionByName(edges.select(F.col("dst").alias("id"), "w"))
    s2 = both.groupBy("id").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    n, s0 = s["n"], a["s0"]
    i, ei = n / s0 * a["num"] / den, -1 / (n - 1)
    var = (n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - ei * ei
    zn = (i - ei) / math.sqrt(var)
    return {"i": i, "ei": ei, "var_norm": var, "z_norm": zn, "p_norm": math.erfc(abs(zn) / math.sqrt(2))}


def local_moran(cells: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(id, local_moran_stat, spatial_lag, quadrant)."""
    v, s = _values(cells, value)
    z = v.select("id", (F.col("y") - F.lit(s["mean"])).alias("z"))
    den = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    lag = edges.join(z.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    out = z.join(lag, "id", "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))
    up, high = F.col("z") > 0, F.col("lag") > 0
    quadrant = F.when(up & high, 1).when(high, 2).when(~up, 3).otherwise(4)
    return out.select("id", (F.lit(s["n"] - 1) * F.col("z") * F.col("lag") / F.lit(den)).alias("local_moran_stat"), F.col("lag").alias("spatial_lag"), quadrant.alias("quadrant"))


def gi_star(cells: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(id, gi_star, gi_zscore): binary weights, the cell itself included, closed form."""
    v, s = _values(cells, value)
    both = edges.select("src", "dst").unionByName(v.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    told = both.join(v.select(F.col("id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("y").alias("wy"), F.count("*").alias("w"))
    n = s["n"]
    spread = F.lit(s["sd"]) * F.sqrt((n * F.col("w") - F.col("w") * F.col("w")) / F.lit(float(n - 1)))
    return told.select("id", (F.col("wy") / F.lit(s["sum"])).alias("gi_star"), F.when(spread > 0, (F.col("wy") - F.lit(s["mean"]) * F.col("w")) / spread).alias("gi_zscore"))


#: Coefficients of a Chebyshev fit to ln(erfc(x) exp(x^2) / t), t = 1 / (1 + x / 2), highest last. Fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal: erfc(|z| / sqrt(2)) with a relative error under 1.2e-7 at any z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return t * F.exp(poly - x * x)


def bh_fdr(df: DataFrame, p: str, key: str, q: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values. Equal p take the rank of the last of them; ranks are running counts, and the least of
    what follows a running minimum from the largest p down, both by range partitions. A null p has no q and no rank."""
    df = scratch.kept(df, "tested")  # values are joined: they must be the same to the last bit
    counts = scratch.kept(df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p_value")).agg(F.count("*").alias("_c")), "p_values")
    n = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    rank = running(counts, [F.col("_p_value")], "_c", "sum", "_rank")
    rank = rank.withColumn("_v", F.col("_p_value") * F.lit(n) / F.col("_rank"))
    least = running(rank, [F.desc("_p_value")], "_v", "min", "_least").select("_p_value", F.least("_least", F.lit(1.0)).alias(q))
    return df.join(least, F.col(p) == F.col("_p_value"), "left").drop("_p_value")


def hotspot_class(z: Column, p: Column) -> Column:
    side = F.when(z > 0, F.lit("hot")).otherwise(F.lit("cold"))
    level = F.when(p < 0.01, "_99").when(p < 0.05, "_95").when(p < 0.10, "_90")
    return F.coalesce(F.concat(side, level), F.lit("not_significant"))


def lisa_cluster(quadrant: Column, p: Column, alpha: float = 0.05) -> Column:
    name = F.when(quadrant == 1, "High-High").when(quadrant == 2, "Low-High").when(quadrant == 3, "Low-Low").otherwise("High-Low")
    return F.when(p < alpha, name).otherwise("Not significant")


#: Permutations that are packed together; the places of a strip to which values move, and the side of the blocks of cells
#: in which a permuted grid is summed; the places of a permuted order that one window holds.
SLICE, STRIP, SIDE, STRETCH = 128, 1 << 12, 64, 1 << 16
#: Up to so many cells, with at most so many neighbours each, a task holds all of them and walks some of the permutations.
WHOLE, NEAR, WALKS = 2_000_000, 32, 24
#: Sums of one permutation in another order may differ by so much of themselves: they count as equal.
SAME = 1e-12


def _block(cell: Column) -> Column:
    """The block of cells that a cell number lies in."""
    row, col = F.shiftright(cell, 31), cell.bitwiseAND((1 << 31) - 1)
    return F.floor(row / SIDE) * (1 << 31) + F.floor(col / SIDE)


def moran_permutations(cells: DataFrame, edges: DataFrame, value: str, permutations: int = 999, seed: int = 42) -> dict[str, float]:
    """I under random relabelling. A keyed permutation of places says where each value goes, so values are shuffled to
    strips of places, SLICE permutations packed in one row; a strip passes its cells on to the blocks whose edges have
    them, and a block of cells returns a sum for each permutation. No one holds the grid."""
    v, s = _values(cells, value)
    n, spark = s["n"], cells.sparkSession
    z = scratch.kept(placed(v, [F.col("id")], "at").select("id", "at", (F.col("y") - F.lit(s["mean"])).alias("z")), "values")
    edges = scratch.kept(edges.select("src", "dst", "w", _block(F.col("src")).alias("block")), "edges")
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(permutations // SLICE).cast("long")))
    perms = lambda k: np.arange(k * SLICE, min((k + 1) * SLICE, permutations + 1))

    def move(batches):
        for b in batches:
            for k, g in b.groupby("slice"):
                ps, at = perms(k), g["at"].to_numpy()
                perm = np.repeat(ps, len(at))
                # Permutation 0 leaves all in its place.
                to = np.where(perm == 0, np.tile(at, len(ps)), places(n, seed, perm, np.tile(at, len(ps))))
                order = np.argsort(to // STRIP, kind="stable")
                strips, starts = np.unique(to[order] // STRIP, return_index=True)
                packed = [np.split(x[order], starts[1:]) for x in (to, (perm - ps[0]).astype(np.int16), np.tile(g["z"].to_numpy(), len(ps)))]
                yield pd.DataFrame({"slice": k, "strip": strips} | {c: [x.tobytes() for x in xs] for c, xs in zip(("to", "perm", "z"), packed, strict=True)})

    def settle(key, came: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        k, strip = key
        x = np.zeros((min(STRIP, n - strip * STRIP), len(perms(k))))
        for to, perm, zs in zip(came["to"], came["perm"], came["z"], strict=True):
            x[np.frombuffer(to, np.int64) - strip * STRIP, np.frombuffer(perm, np.int16)] = np.frombuffer(zs)
        out = [(k, block, g["id"].to_numpy(np.int64).tobytes(), x[g["at"].to_numpy() - strip * STRIP].tobytes()) for block, g in need.groupby("block")]
        return pd.DataFrame(out, columns=["s", "b", "ids", "xs"])

    def add(key, own: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in has["ids"]])
        x = np.concatenate([np.frombuffer(i).reshape(-1, len(perms(key[1]))) for i in has["xs"]])
        order, out = np.argsort(ids), 0.0
        own = own.sort_values(["src", "dst"])
        for start in range(0, len(own), 1 << 14):
            e = own.iloc[start : start + (1 << 14)]
            i, j = (order[np.searchsorted(ids, e[c], sorter=order)] for c in ("src", "dst"))
            out = out + (e["w"].to_numpy()[:, None] * x[i] * x[j]).sum(axis=0)
        return pd.DataFrame({"perm": perms(key[1]), "part": out})

    dealt = z.select("at", "z", slices.alias("slice")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice", F.floor(F.col("at") / STRIP))
    moved = dealt.mapInPandas(move, "slice long, strip long, to binary, perm binary, z binary")
    ends = edges.select("block", F.col("src").alias("id")).unionByName(edges.select("block", F.col("dst").alias("id"))).distinct()
    need = ends.join(z.select("id", "at"), "id").select("id", "at", "block", F.floor(F.col("at") / STRIP).alias("strip"), slices.alias("slice"))
    told = moved.groupBy("slice", "strip").cogroup(need.groupBy("slice", "strip")).applyInPandas(settle, "s long, b long, ids binary, xs binary")
    parts = edges.withColumn("slice", slices).groupBy("block", "slice").cogroup(told.groupBy("b", "s")).applyInPandas(add, "perm long, part double")
    total, squares = edges.agg(F.sum("w")).first()[0], z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    got = {r["perm"]: n / total * r["i"] / squares for r in parts.groupBy("perm").agg(F.sum("part").alias("i")).collect()}
    i, sim = got[0], np.array([got[p] for p in range(1, permutations + 1)])
    larger = int((sim >= i - SAME * abs(i)).sum())
    c = min(larger, permutations - larger)
    return {"i": float(f"{i:.12g}"), "p_sim": (c + 1) / (permutations + 1), "z_sim": round(float((i - sim.mean()) / sim.std()), 9)}


def local_permutations(cells: DataFrame, edges: DataFrame, value: str, statistic: str = "moran", permutations: int = 999, seed: int = 42) -> DataFrame:
    """(id, p_sim, z_sim) of each cell that has neighbours: the cell is held, as many others as it has neighbours are drawn
    without replacement. In each permutation a cell draws those that come next behind it, the first following the last.
    Up to WHOLE cells, permutations are dealt to tasks. Beyond, values are shuffled to stretches of a permuted order, which
    windows read, each stretch with the start of the next. Both draw the same."""
    if statistic not in ("moran", "gi"):
        raise AnalysisError(f"unknown statistic {statistic!r}")
    v, s = _values(cells, value)
    n = s["n"]
    x = F.col("y") - F.lit(s["mean"]) if statistic == "moran" else F.col("y")
    v = scratch.kept(placed(v, [F.col("id")], "at").select("id", "at", x.alias("x")), "values")
    # Lists are sorted before they are summed: reruns agree to the last bit.
    met = edges.select("src", "dst", F.col("w").cast("double").alias("w")).join(v.select(F.col("id").alias("dst"), F.col("x").alias("xj")), "dst")
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    near = met.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sort_array(F.collect_list(F.col("w") * F.col("xj"))).alias("lags"))
    base = scratch.kept(v.join(near, "id", "left").select("id", "at", "x", "ws", add(F.col("lags")).alias("real")), "drawn_for")
    most = base.agg(F.max(F.size("ws"))).first()[0]
    if most is None or most <= 0 or permutations < 1:
        return base.limit(0).select("id", F.lit(1.0).alias("p_sim"), F.lit(0.0).alias("z_sim"))
    # A statistic grows with its lag, or, for a cell below the mean or a negative total, against it: only their order counts.
    sign = F.when(F.col("x") < 0, -1.0).when(F.col("x") > 0, 1.0).otherwise(0.0) if statistic == "moran" else F.lit(-1.0 if s["sum"] < 0 else 1.0)
    told = _walked(base, sign, n, most, permutations, seed) if n <= WHOLE and most <= NEAR else _stretched(base, sign, n, most, permutations, seed)
    p = (F.least("larger", F.lit(permutations) - F.col("larger")) + 1) / (permutations + 1)
    return told.select("id", p.alias("p_sim"), F.when(F.col("sd") > 0, F.round((F.col("real") - F.col("mean")) / F.col("sd"), 9)).otherwise(0.0).alias("z_sim"))


def _stretched(base: DataFrame, sign: Column, n: int, most: int, permutations: int, seed: int) -> DataFrame:
    """(id, larger, mean, sd, real): draws by windows over stretches of the permuted orders."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    stretches = max(1, n // max(STRETCH, most))
    rows = base.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("pos", permuted(n, seed, F.col("perm"), F.col("at")))
    part = F.floor(F.col("pos") * stretches / n)
    own = F.struct(part.alias("part"), F.col("pos").alias("pos"), F.lit(True).alias("own"))
    ahead = F.struct(F.pmod(part - 1, F.lit(stretches)).alias("part"), (F.col("pos") + F.when(part == 0, n).otherwise(0)).alias("pos"), F.lit(False).alias("own"))
    start = F.ceil(part * n / stretches)
    spots = F.explode(F.when(F.col("pos") - start < most, F.array(own, ahead)).otherwise(F.array(own)))
    rows = rows.select("id", "x", "ws", "real", "perm", spots.alias("spot")).select("id", "x", "ws", "real", "perm", "spot.*")
    behind = Window.partitionBy("perm", "part").orderBy("pos").rowsBetween(1, most)
    drawn = rows.withColumn("next", F.collect_list("x").over(behind)).where("own and ws is not null")
    # Others' draws go through the same sorted sum, so equal draws are equal sums.
    lag = add(F.sort_array(F.zip_with(F.slice("next", F.lit(1), F.size("ws")), "ws", lambda a, w: a * w)))
    drawn = drawn.select("id", lag.alias("sim"), "real", "x")
    sim, real = sign * F.col("sim"), sign * F.col("real")
    return drawn.groupBy("id").agg(
        F.sum((sim >= real - SAME * F.abs(real)).cast("long")).alias("larger"), F.avg(sim).alias("mean"), F.stddev_pop(sim).alias("sd"), F.first(real).alias("real"),
    )


def _walked(base: DataFrame, sign: Column, n: int, most: int, permutations: int, seed: int) -> DataFrame:
    """(id, larger, mean, sd, real): each task has all cells and some permutations, and returns each cell's counts, mean and
    squares over these; sums are added up in the order of their values here too."""
    walks = min(WALKS, permutations)
    ws = [f"w{i}" for i in range(most)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, x, has = pdf["at"].to_numpy(np.int64), pdf["x"].to_numpy(), np.flatnonzero(pdf["w0"].notna().to_numpy())
        w, sgn, real = (pdf[c].to_numpy(float)[has] for c in (ws, "sign", "real"))
        ids, larger, mean, m2, done = pdf["id"].to_numpy(np.int64)[has], np.zeros(len(has), np.int64), np.zeros(len(has)), np.zeros(len(has)), 0
        del pdf
        bar, order = sgn * real - SAME * np.abs(real), np.empty(n + most)
        for p in range(int(key[0]) + 1, permutations + 1, walks):
            pos = places(n, seed, np.full(n, p), at)
            order[pos] = x
            order[n:] = np.resize(order[:n], most)
            pos, done = pos[has], done + 1
            for lo in range(0, len(has), 1 << 15):
                part = slice(lo, lo + (1 << 15))
                lags = np.sort(order[pos[part, None] + np.arange(1, most + 1)] * w[part], axis=1)  # what lacks comes last
                sim = np.zeros(len(lags))
                for i in range(most):
                    sim += np.nan_to_num(lags[:, i])
                sim *= sgn[part]
                larger[part] += sim >= bar[part]
                off = sim - mean[part]
                mean[part] += off / done
                m2[part] += off * (sim - mean[part])
        return pd.DataFrame({"id": ids, "walk": int(key[0]), "n": done, "larger": larger, "mean": mean, "m2": m2, "real": sgn * real})

    rows = base.select("id", "at", "x", "real", sign.alias("sign"), *[F.get("ws", F.lit(i)).alias(c) for i, c in enumerate(ws)], F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    parts = rows.groupBy("walk").applyInPandas(run, "id long, walk long, n long, larger long, mean double, m2 double, real double")
    told = parts.groupBy("id").agg(F.sum("larger").alias("larger"), F.max("real").alias("real"), F.sort_array(F.collect_list(F.struct("walk", "n", "mean", "m2"))).alias("each"))
    # Means are taken from the first walk's, so that equal draws have no spread.
    first, count = F.col("each")[0]["mean"], F.lit(float(permutations))
    told = told.withColumn("off", F.aggregate("each", F.lit(0.0), lambda a, e: a + e["n"] * (e["mean"] - first)) / count)
    squares = F.aggregate("each", F.lit(0.0), lambda a, e: a + e["m2"] + e["n"] * F.pow(e["mean"] - first - F.col("off"), F.lit(2.0)))
    return told.select("id", "larger", (first + F.col("off")).alias("mean"), F.sqrt(squares / count).alias("sd"), "real")

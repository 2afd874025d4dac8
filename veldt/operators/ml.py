"""Exploratory, unsupervised scores of cells: robust scaling, isolation forest, DBSCAN, stability."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import scratch
from veldt.errors import AnalysisError
from veldt.functions.quantiles import quantiles
from veldt.operators.graph import connected_components
from veldt.operators.ranks import placed, running

FEATURES = ("mean_cva", "p95_cva", "changed_proportion", "mean_diff_b04", "mean_diff_b03", "mean_diff_b02", "local_std_cva")
LEAST_CELLS, SAMPLE = 20, 256


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Centred on medians, by interquartile ranges; a range of zero counts as 1."""
    q = quantiles(df, {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75])
    return df.withColumns({c: (F.col(c) - F.lit(q[c][1])) / F.lit((q[c][2] - q[c][0]) or 1.0) for c in cols})


def features(cells: DataFrame, coordinates: bool = False) -> tuple[DataFrame, list[str]]:
    cols = [c for c in FEATURES if c in cells.columns]
    if coordinates:
        s = cells.agg(*[f(c).alias(f"{c}_{n}") for c in ("cell_row", "cell_col") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        cells = cells.withColumns({f"z_{c}": (F.col(c) - F.lit(s[f"{c}_m"])) / F.lit(s[f"{c}_s"] + 1e-9) for c in ("cell_row", "cell_col")})
        cols += ["z_cell_row", "z_cell_col"]
    return cells, cols


def ranked(df: DataFrame, score: str) -> DataFrame:
    """Adds ml_anomaly_rank (1 for the highest score, ties at their best, nulls last) and ml_anomaly_quantile (the rank from
    below as a share, ties at their mean). Different scores are ordered with their counts, by range partitions."""
    df = scratch.kept(df, "to_rank")  # scores are joined: they must be the same to the last bit
    counts = scratch.kept(df.groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_c")), "scores")
    n = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    put = running(counts, [F.desc_nulls_last("_score")], "_c", "sum", "_up_to")
    above = F.col("_up_to") - F.col("_c")
    told = put.select("_score", (above + 1).alias("ml_anomaly_rank"), ((F.lit(n) - F.col("_up_to") + 1 + (F.col("_c") - 1) / 2.0) / F.lit(max(n, 1))).alias("ml_anomaly_quantile"))
    return df.join(told, F.col(score).eqNullSafe(F.col("_score"))).drop("_score")


def _depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, left: int) -> list:
    span = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(0)
    some = np.flatnonzero(span > 0)
    if left == 0 or len(x) <= 1 or not len(some):
        return [_depth(len(x))]
    f = int(rng.choice(some))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    go = x[:, f] < cut
    return [f, cut, _grow(x[go], rng, left - 1), _grow(x[~go], rng, left - 1)]


def _path(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    go = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[go], out[~go] = 1 + _path(tree[2], x[go]), 1 + _path(tree[3], x[~go])
    return out


def _grown(scaled: DataFrame, key: str, cols: list[str], forests: list[tuple[list[int] | None, int]], trees: int, psi: int, seeds: list[int]) -> list[tuple[list, int]]:
    """Forests, each of ``trees`` trees, over cells (key, *cols, _block). ``forests`` names for each the blocks that it may
    draw from (None: all) and how many cells those have. A tree's sample are the ``psi`` cells with the least hash of tree
    and key: each cell tells by its own hashes which trees may want it, and one task for each tree picks and grows. What
    comes to the driver are the trees, of at most 2 psi nodes each."""

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, t = int(key_[0]), int(key_[1])
        size = min(psi, forests[f][1])
        own = pdf.sort_values(["h", "k"]).head(size)
        tree = _grow(own[cols].to_numpy(float), np.random.default_rng([seeds[f], t]), math.ceil(math.log2(max(size, 2))))
        return pd.DataFrame({"f": [f], "t": [t], "tree": [json.dumps(tree)]})

    def wanted(f: int, blocks: list[int] | None, n: int) -> Column:
        """What trees of a forest may want a cell."""
        # About four times as many as are needed, and no fewer than some hundreds: the least hashes are surely among them.
        share = min(1.0, (4 * psi + 256) / max(n, 1))
        each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.lit(f).alias("f"), t.alias("t"), F.pmod(F.xxhash64(F.lit(seeds[f]), t, F.col(key)), F.lit(1 << 40)).alias("h")))
        few = F.filter(each, lambda x: x["h"] < int(share * (1 << 40)))
        return few if blocks is None else F.when(F.col("_block").isin(blocks), few).otherwise(F.slice(each, 1, 0))

    wants = [wanted(f, blocks, n) for f, (blocks, n) in enumerate(forests)]
    at = scaled.select(F.col(key).alias("k"), *cols, F.explode(F.flatten(F.array(*wants))).alias("w")).select("k", *cols, "w.*")
    rows = at.groupBy("f", "t").applyInPandas(run, "f int, t int, tree string").collect()
    out: list[tuple[list, int]] = [([], min(psi, n)) for _, n in forests]
    for r in sorted(rows, key=lambda r: (r["f"], r["t"])):
        out[r["f"]][0].append(json.loads(r["tree"]))
    return out


def _scores(scaled: DataFrame, cols: list[str], forests: list[tuple[list, int]]) -> Column:
    """An array: each forest's score of a cell, in (0, 1), higher for odder."""
    told = scaled.sparkSession.sparkContext.broadcast(forests)

    @F.pandas_udf("array<double>")
    def score(*v: pd.Series) -> pd.Series:
        at = np.column_stack([s.to_numpy(float) for s in v])
        return pd.Series(list(np.column_stack([2.0 ** (-np.mean([_path(t, at) for t in trees], axis=0) / _depth(psi)) for trees, psi in told.value])))

    return score(*cols)


def isolation_forest(cells: DataFrame, key: str, cols: list[str], trees: int = 200, seed: int = 42) -> DataFrame:
    """``cells`` with ml_anomaly_score in (0, 1), higher for odder. Each tree is grown by a task, on at most 256 cells, so the
    forest is of bounded size; scoring is one pass."""
    n = cells.count()
    if n < LEAST_CELLS:
        raise AnalysisError(f"at least {LEAST_CELLS} cells are needed")
    scaled = scratch.kept(robust_scale(cells, cols).select(key, *cols), "scaled")
    forest = _grown(scaled, key, cols, [(None, n)], trees, SAMPLE, [seed])
    own = scaled.select(F.col(key).alias("_key"), F.get(_scores(scaled, cols, forest), F.lit(0)).alias("ml_anomaly_score"))
    return cells.join(own, F.col(key) == F.col("_key")).drop("_key")


#: Boxes of at most so many points are no longer halved, but compared point by point.
LEAF = 32


def _gap(cols: int, far: bool) -> Column:
    """Squared distance of the nearest, or farthest, places of two boxes (lo, hi) and (lo2, hi2), arrays by dimension."""
    out = F.lit(0.0)
    for i in range(cols):
        lo, hi, lo2, hi2 = (F.get(c, F.lit(i)) for c in ("lo", "hi", "lo2", "hi2"))
        d = F.greatest(hi2 - lo, hi - lo2) if far else F.greatest(lo2 - hi, lo - hi2, F.lit(0.0))
        out = out + d * d
    return out


def _boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, lo, hi, who): counts, tight boxes and least keys of groups of points (a, x)."""
    d = F.size("x")
    dims = len(points.select("x").first()["x"])
    lo, hi = ([f(F.get("x", F.lit(i))) for i in range(dims)] for f in (F.min, F.max))
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.array(*lo).alias("lo"), F.array(*hi).alias("hi"), F.min("a").alias("who"), F.max(d).alias("_d")).drop("_d")


def dbscan(points: DataFrame, key: str, cols: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, ml_cluster_id): -1 for noise; clusters are numbered by their least core key.

    Points fall into cells of side eps / sqrt(d), within which all are neighbours: cells of ``min_samples`` points are core
    throughout and one cluster, without a pair being looked at. Only points of thin cells count their neighbours, and whole
    boxes of points that are surely near or surely far count at once. Two core cells are linked if any of their core points
    are near: pairs of boxes that can't tell yet are halved along their widest side, round by round, down to ``LEAF`` points.
    So a crowd of any number of equal or close points costs a few boxes."""
    spark, d = points.sparkSession, len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    p = points.select(F.col(key).alias("a"), x.alias("x"))
    cell = F.xxhash64(*[F.floor(F.get("x", F.lit(i)) / side).cast("long") for i in range(d)])
    p = scratch.kept(p.withColumn("cell", cell), "points")
    if not p.take(1):
        return points.select(F.col(key), F.lit(-1).alias("ml_cluster_id"))
    cells = _boxes(p, ["cell"])
    # Cells near each other meet by the box of eps that the first corner of a cell is in, in the two leading dimensions.
    lead = min(2, d)
    corner = [F.floor(F.get("lo", F.lit(i)) / eps).cast("long").alias(f"_c{i}") for i in range(lead)]
    cells = scratch.kept(cells.select("*", *corner), "cells")
    steps = [(i, j)[:lead] for i in (-2, -1, 0, 1, 2) for j in ((-2, -1, 0, 1, 2) if lead > 1 else (0,))]
    to = F.explode(F.array(*[F.struct(*[(F.col(f"_c{i}") + s).alias(f"_c{i}") for i, s in enumerate(step)]) for step in steps]))
    other = cells.select(F.col("cell").alias("cell2"), F.col("n").alias("n2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), to.alias("_to")).select("*", "_to.*").drop("_to")
    near = cells.join(other, [f"_c{i}" for i in range(lead)]).where(_gap(d, False) <= eps * eps)
    near = scratch.kept(near.select("cell", "cell2", "n", "n2", (_gap(d, True) <= eps * eps).alias("all"), (F.col("n") >= min_samples).alias("dense")), "near_cells")
    dense = cells.where(F.col("n") >= min_samples).select("cell")

    # Neighbours of the points of thin cells: boxes that are near throughout count whole, others point by point, and a
    # point's own cell is near throughout.
    thin = p.join(cells.where(F.col("n") < min_samples).select("cell"), "cell", "left_semi")
    whole = near.where("not dense and all").groupBy("cell").agg(F.sum("n2").alias("whole"))
    part = near.where("not dense and not all").select("cell", "cell2")
    dist = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    q = p.select(F.col("cell").alias("cell2"), F.col("a").alias("b"), F.col("x").alias("y"))
    met = thin.join(part, "cell").join(q, "cell2").where(dist <= eps * eps).groupBy("a").agg(F.count("*").alias("part"))
    told = thin.join(whole, "cell", "left").join(met, "a", "left").withColumn("n", F.coalesce("whole", F.lit(0)) + F.coalesce("part", F.lit(0)))
    core = p.join(dense, "cell", "left_semi").select("a", "x", "cell").unionByName(told.where(F.col("n") >= min_samples).select("a", "x", "cell"))
    core = scratch.kept(core, "core")
    if not core.take(1):
        return points.select(F.col(key), F.lit(-1).alias("ml_cluster_id"))

    # Links of cells by their core points. A box is named by its cell and the halves taken in it so far.
    box = scratch.kept(_boxes(core.withColumn("path", F.lit("")), ["cell", "path"]), "boxes")
    open_pairs = near.where("cell < cell2").select("cell", F.lit("").alias("path"), "cell2", F.lit("").alias("path2"))
    links, held = None, core.withColumn("path", F.lit(""))
    while True:
        two = box.select(*[F.col(c).alias(f"{c}2") for c in ("cell", "path", "n", "lo", "hi", "who")])
        pairs = scratch.kept(open_pairs.join(box, ["cell", "path"]).join(two, ["cell2", "path2"]).where(_gap(d, False) <= eps * eps).withColumn("all", _gap(d, True) <= eps * eps), "pairs")
        sure = pairs.where("all").select("cell", "cell2").distinct()
        small = pairs.where((F.col("n") <= LEAF) & (F.col("n2") <= LEAF) & ~F.col("all"))
        one = held.select("cell", "path", "x")
        y = held.select(F.col("cell").alias("cell2"), F.col("path").alias("path2"), F.col("x").alias("y"))
        close = small.select("cell", "path", "cell2", "path2").join(one, ["cell", "path"]).join(y, ["cell2", "path2"]).where(dist <= eps * eps).select("cell", "cell2").distinct()
        new = sure.unionByName(close)
        links = scratch.kept(new if links is None else links.unionByName(new), "links").distinct()
        left = pairs.where(~F.col("all") & ((F.col("n") > LEAF) | (F.col("n2") > LEAF))).join(links, ["cell", "cell2"], "left_anti").select("cell", "path", "cell2", "path2", "n", "n2")
        left = scratch.kept(left, "open_pairs")
        if not left.take(1):
            break
        # Large boxes are halved at the middle of their widest side; a box of equal points never comes here.
        widths = F.zip_with("hi", "lo", lambda a, b: a - b)
        cut = box.where(F.col("n") > LEAF).select("cell", "path", (F.array_position(widths, F.array_max(widths)) - 1).cast("int").alias("_i"), "lo", "hi")
        cut = cut.select("cell", "path", "_i", ((F.get("lo", F.col("_i")) + F.get("hi", F.col("_i"))) / 2).alias("_at"))
        half = F.when(F.col("_at").isNull(), F.lit("")).when(F.get("x", F.col("_i")) > F.col("_at"), F.lit("1")).otherwise(F.lit("0"))
        held = scratch.kept(held.join(cut, ["cell", "path"], "left").withColumn("path", F.concat("path", half)).select("a", "x", "cell", "path"), "halved")
        box = scratch.kept(_boxes(held, ["cell", "path"]), "boxes")

        def halves(n: str, path: str) -> Column:
            return F.explode(F.when(F.col(n) > LEAF, F.array(F.concat(F.col(path), F.lit("0")), F.concat(F.col(path), F.lit("1")))).otherwise(F.array(F.col(path))))

        open_pairs = left.withColumn("path", halves("n", "path")).withColumn("path2", halves("n2", "path2")).select("cell", "path", "cell2", "path2")

    # Clusters are numbered by their least core key.
    firsts = core.groupBy("cell").agg(F.min("a").alias("first"))
    groups = connected_components(links, "cell", "cell2").withColumnRenamed("node", "cell")
    named = firsts.join(groups, "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    least = placed(named.groupBy("component").agg(F.min("first").alias("root")), [F.col("root")], "ml_cluster_id")
    clusters = scratch.kept(named.join(least, "component").select("cell", F.col("ml_cluster_id").cast("int").alias("ml_cluster_id")), "clusters")
    own = core.join(clusters, "cell").select("a", "ml_cluster_id")
    # Other points take the least cluster of a core point near them.
    rest = thin.join(core.select("a"), "a", "left_anti")
    c = core.join(clusters, "cell").select(F.col("cell").alias("cell2"), F.col("x").alias("y"), "ml_cluster_id")
    touching = near.where("not dense").select("cell", "cell2")
    border = rest.join(touching, "cell").join(c, "cell2").where(dist <= eps * eps).groupBy("a").agg(F.min("ml_cluster_id").alias("edge"))
    out = points.select(F.col(key).alias("a")).join(own, "a", "left").join(border, "a", "left")
    return out.select(F.col("a").alias(key), F.coalesce("ml_cluster_id", "edge", F.lit(-1)).cast("int").alias("ml_cluster_id"))


def top_k(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k).select(key)


def forest_stability(cells: DataFrame, key: str, cols: list[str], replicates: int = 20, k: int = 20, trees: int = 200, seed: int = 42) -> dict[str, float]:
    """How much of the top k stays when blocks of cells are left out: cells are dealt to max(4, 2 sqrt(replicates)) blocks,
    and each replicate draws four fifths of them without replacement. All forests score the cells in one pass."""
    n = cells.count()
    if n < LEAST_CELLS:
        raise AnalysisError(f"at least {LEAST_CELLS} cells are needed")
    k, blocks, rng = min(k, n), max(4, int(2 * math.sqrt(replicates))), np.random.default_rng(seed)
    scaled = robust_scale(cells, cols).select(key, *cols).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.lit(1), key), F.lit(blocks)).cast("int"))
    scaled = scratch.kept(scaled, "scaled")
    held = dict(scaled.groupBy("_block").count().collect())
    draws, wanted, seeds = [list(range(blocks))], [(None, n)], [seed]
    for r in range(replicates):
        keep = sorted(rng.choice(blocks, max(1, int(0.8 * blocks)), replace=False).tolist())
        m = sum(held.get(b, 0) for b in keep)
        if m >= k + 5:
            draws.append(keep)
            wanted.append((keep, m))
            seeds.append(seed + r + 1)
    forests = _grown(scaled, key, cols, wanted, trees, SAMPLE, seeds)
    each = scaled.select(key, "_block", F.posexplode(_scores(scaled, cols, forests)).alias("_r", "_score"))
    mine = F.array_contains(F.get(F.array(*[F.array(*[F.lit(b) for b in d]) for d in draws]), F.col("_r")), F.col("_block"))
    ranked = each.where(mine).withColumn("_rank", F.row_number().over(Window.partitionBy("_r").orderBy(F.desc("_score"), key))).where(F.col("_rank") <= k)
    tops: dict[int, set] = {}
    for row in ranked.select("_r", key).collect():  # at most k for each forest
        tops.setdefault(row[0], set()).add(row[1])
    seen = [len(tops[0] & tops[r]) / k for r in range(1, len(draws))]
    return {"replicates": len(seen), "overlap_mean": float(np.mean(seen)) if seen else None, "overlap_std": float(np.std(seen)) if seen else None}


def contamination_sensitivity(cells: DataFrame, key: str, cols: list[str], contamination: float = 0.05, k: int = 20, trees: int = 200, seed: int = 42) -> list[dict]:
    """(factor, contamination, n_flagged, top_k_overlap): when half or twice the share of anomalies is expected, a forest is
    grown again; cells whose score is beyond that share's percentile are flagged, and its top k held against the first's."""
    out, first = [], None
    for factor in (1.0, 0.5, 2.0):
        share = min(max(contamination * factor, 0.01), 0.49)
        scored = scratch.kept(isolation_forest(cells, key, cols, trees, seed).select(key, "ml_anomaly_score"), "scored")
        cut = quantiles(scored, {"s": F.col("ml_anomaly_score")}, [1 - share])["s"][0]
        top = {r[0] for r in top_k(scored, key, "ml_anomaly_score", k).collect()}
        first = top if first is None else first
        out.append({"factor": factor, "contamination": share, "n_flagged": scored.where(F.col("ml_anomaly_score") > cut).count(), "top_k_overlap": len(top & first) / max(1, len(first))})
    return sorted(out, key=lambda r: r["factor"])


def dbscan_sensitivity(points: DataFrame, key: str, cols: list[str], eps: float, min_samples: int) -> list[dict]:
    out = []
    for f in (0.8, 1.0, 1.2):
        r = dbscan(points, key, cols, eps * f, min_samples).agg(F.avg((F.col("ml_cluster_id") == -1).cast("double")), F.count_distinct(F.when(F.col("ml_cluster_id") != -1, F.col("ml_cluster_id")))).first()
        out.append({"eps": eps * f, "noise_fraction": r[0], "n_clusters": r[1]})
    return out

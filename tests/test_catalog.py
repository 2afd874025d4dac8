"""Every named query against its SQL on the smallest tables, and the invariants of those without SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.group import GroupedData

from veldt import scratch
from veldt.functions import permutation, quantiles
from veldt.operators import cells, change, features, graph, ml, radiometry, ranks, raster
from veldt.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module", autouse=True)
def one_scene(spark, sf):
    """The queries' shared steps run once for this module."""
    made = catalog.Scene(spark, sf)
    real, catalog.Scene = catalog.Scene, lambda *_: made
    yield
    catalog.Scene = real


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}".replace("-0", "0") if v == 0 else f"{v:.6g}"
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_normal_p_is_exact_in_the_tails(spark):
    z = [0.0, 0.1, 1.0, 2.5, -4.0, 8.0, -20.0, 37.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(cells.normal_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=3e-7)


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(8)
    m = rng.random((60, 150)) < 0.45
    df = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(m)], "row int, col int")
    for eight in (True, False):
        want, seen = {}, np.zeros_like(m)
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not a * b)]
        for r, c in np.argwhere(m):
            if not seen[r, c]:
                stack, part = [(r, c)], []
                seen[r, c] = True
                while stack:
                    x, y = stack.pop()
                    part.append((int(x), int(y)))
                    for a, b in steps:
                        if 0 <= x + a < 60 and 0 <= y + b < 150 and m[x + a, y + b] and not seen[x + a, y + b]:
                            seen[x + a, y + b] = True
                            stack.append((x + a, y + b))
                want |= {p: min(p0 * (1 << 31) + p1 for p0, p1 in part) for p in part}
        groups = {(r["row"], r["col"]): r["label"] for r in raster.components(df, eight).collect()}
        same = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
        assert same(groups) == same(want)


def test_quantiles_without_gathering(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1e-3, 500), rng.normal(0, 1e5, 500), [0.0] * 50, [1.0, 2.0, -2.0, 4.0, 0.5, -1.0] * 10]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    shares = [0, 0.02, 0.25, 0.5, 0.9, 1]
    one = quantiles.quantiles(df, {"v": F.col("v")}, shares)["v"]
    monkeypatch.setattr(quantiles, "GATHER", 0)
    assert quantiles.quantiles(df, {"v": F.col("v")}, shares)["v"] == one
    assert one == pytest.approx(list(np.quantile(x, shares)))


def test_quantiles_by_brackets(spark, monkeypatch):
    """Brackets of columns and shares together, with nulls, NaN, heavy ties and a lone value, also when they are narrowed."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1e3, 30_000), rng.choice([0.0, -1.5, 7.25], 30_000)
    rows = [(float(x), float(y) if i % 3 else None, math.nan if i % 10 == 0 else float(i % 7), 4.0 if i == 5 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    cols, shares = {c: F.col(c) for c in "abcd"} | {"none": F.lit(None).cast("double")}, [0, 0.02, 0.5, 0.98, 1]
    want = quantiles.quantiles(df, cols, shares)
    monkeypatch.setattr(quantiles, "GATHER", 0)
    for held, accuracy in ((200_000, 10_000), (200, 100)):
        monkeypatch.setattr(quantiles, "HELD", held)
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        got = quantiles.quantiles(df, cols, shares)
        assert {k: [str(x) if x is None or x != x else x for x in v] for k, v in got.items()} == {k: [str(x) if x is None or x != x else pytest.approx(x, rel=1e-12) for x in v] for k, v in want.items()}


def test_quantiles_of_long_expressions_keep_plans_small(spark, monkeypatch):
    """A filter on a quantile's expression once repeated it hundreds of times in the plan, which filled the driver."""
    monkeypatch.setattr(quantiles, "GATHER", 0)
    longest = []
    agg = DataFrame.agg
    monkeypatch.setattr(DataFrame, "agg", lambda self, *e: longest.append(len(agg(self, *e)._jdf.queryExecution().optimizedPlan().toString())) or agg(self, *e))
    group = GroupedData.agg
    monkeypatch.setattr(GroupedData, "agg", lambda self, *e: longest.append(len(group(self, *e)._jdf.queryExecution().optimizedPlan().toString())) or group(self, *e))
    spark.conf.set("spark.sql.maxPlanStringLength", str(10_000_000))
    try:
        change.scale_top(change.change_vectors(pixels(spark)), "cva")
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert longest and max(longest) < 60_000


def test_positions_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    got = ranks.positions(df, ["g"], ["id"], 7).toPandas()
    assert all(sorted(p) == list(range(len(p))) for _, p in got.groupby("g")["pos"])


def test_connected_components_of_long_paths(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert set(got.values()) == {0} and len(got) == 301
    assert graph.connected_components(edges.limit(0)).count() == 0


def pixels(spark, block=True):
    rng = np.random.default_rng(0)
    rows = []
    for r in range(20):
        for c in range(20):
            b = [float(x) for x in rng.normal(0.15, 0.01, 3)]
            rows.append((r, c, *b, *[x + (0.3 if block and 5 <= r < 15 and 5 <= c < 15 else 0.0) for x in b]))
    return spark.createDataFrame(rows, "row int, col int, before_b04 double, before_b03 double, before_b02 double, after_b04 double, after_b03 double, after_b02 double")


def test_change(spark):
    px = pixels(spark)
    base = change.baseline(px)
    assert base.where("row = 8 and col = 8").first()["intensity"] > 0.9 > base.where("row = 1 and col = 1").first()["intensity"]
    assert change.baseline(pixels(spark, False)).agg(F.max("intensity")).first()[0] == 0.0
    v = change.change_vectors(px)  # half of the pixels or more don't change: MAD is 0, the spread steps in
    assert v.agg(F.max("cva")).first()[0] > v.agg(F.median("cva")).first()[0] and v.where("isnan(cva)").count() == 0
    t = change.threshold(v, "cva", "otsu")
    assert v.where(F.col("cva") > t).count() == 100
    for method, options in (("percentile", {"percentile": 120}), ("manual", {}), ("none", {})):
        with pytest.raises(change.AnalysisError):
            change.threshold(v, "cva", method, **options)
    with pytest.raises(change.AnalysisError):
        change.threshold(v.limit(0), "cva", "otsu")


def test_normalization_matches_medians(spark):
    px = pixels(spark, False).withColumns({f"after_{b}": F.col(f"after_{b}") * 1.7 + 0.05 for b in ("b04", "b03", "b02")})
    for method in ("robust_median_mad", "percentile_matching", "pif_linear"):
        r = radiometry.normalize(px, method).agg(F.median("before_b04"), F.median("after_b04")).first()
        assert abs(r[0] - r[1]) < 0.01
    with pytest.raises(ValueError):
        radiometry.normalize(px, "other")


def test_opening_and_area(spark):
    fg = spark.createDataFrame([(1, 1), *[(r, c) for r in range(5, 8) for c in range(5, 8)]], "row int, col int")
    assert raster.morphology(fg, 10, 10, "opening").count() == 9
    assert raster.morphology(fg, 10, 10, "none").count() == 10
    assert raster.min_pixels(450, 100) == 5 and raster.min_pixels(0, 100) == 1
    with pytest.raises(change.AnalysisError):
        raster.min_pixels(1, 0)
    lab = raster.large(raster.components(fg), 2)
    v = lab.select("row", "col", F.lit(5.0).alias("v"))
    r = features.metrics(lab, v, "v", 10.0).first()
    assert (r["area_m2"], r["perimeter_m"], r["mean_change"]) == (900.0, 120.0, 5.0) and 0 < r["compactness"] <= 1


def grid(spark, n=10):
    rows = [(int(r), int(c), 8.0 if 2 <= r < 5 and 2 <= c < 5 else 1.0 + 0.01 * ((r * 7 + c * 3) % 5)) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "cell_row long, cell_col long, mean_cva double")


def test_spatial_statistics(spark):
    g = grid(spark)
    w = cells.weights(g)
    assert cells.global_moran(g, w, "mean_cva")["i"] > 0.3
    one, two = (cells.moran_permutations(g, w, "mean_cva", 99, 42) for _ in range(2))
    assert one == two and one["p_sim"] == pytest.approx(0.01) and one["z_sim"] > 3
    local = cells.local_permutations(g, w, "mean_cva", "moran", 99).toPandas()
    assert len(local) == 100 and local.p_sim.between(0.01, 1).all()
    middle = 3 * (1 << 31) + 3
    assert local.set_index("id").p_sim[middle] <= 0.05
    assert cells.islands(g, w).count() == 0
    with pytest.raises(change.AnalysisError):
        cells.global_moran(g.limit(7), w, "mean_cva")
    with pytest.raises(change.AnalysisError):
        cells.grid(pixels(spark), 1)
    with pytest.raises(change.AnalysisError):
        cells.weights(g, "other")


def test_bytes_and_scale(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (0.999, 0.0), (0.5, -2.0), (None, None)], "intensity double, v double")
    assert [r["change_byte"] for r in change.as_bytes(rows).collect()] == [0, 255, 254, 127, None]
    assert change.scale_top(rows, "v") == pytest.approx(np.percentile([1.0, 3.0], 98))
    assert change.scale_top(rows.where("v <= 0"), "v") == 1.0 and change.scale_top(rows.limit(0), "v") == 1.0


def test_keyed_permutations(spark):
    for n in (1, 2, 7, 100, 1009):
        for key in (1, 2):
            assert sorted(permutation.places(n, 42, np.full(n, key), np.arange(n))) == list(range(n))
    keys = np.arange(20_000)
    for n, at in ((8, 3), (50, 0)):  # each value is as likely at each place, and with each successor
        to, then = permutation.places(n, 1, keys, np.full(len(keys), at)), permutation.places(n, 1, keys, np.full(len(keys), at + 1))
        for counts, kinds in ((np.bincount(to, minlength=n), n), (np.bincount((then - to) % n, minlength=n)[1:], n - 1)):
            assert ((counts - len(keys) / kinds) ** 2).sum() * kinds / len(keys) < kinds + 5 * (2 * kinds) ** 0.5
    told = spark.range(50).withColumn("to", permutation.permuted(50, 3, F.lit(9).cast("long"), F.col("id"))).toPandas()
    assert told.to.tolist() == permutation.places(50, 3, np.full(50, 9), told.id.to_numpy()).tolist() and sorted(told.to) == list(range(50))


def test_permutations_in_blocks_and_stretches(spark, monkeypatch):
    """How a grid is cut changes nothing, and what is drawn follows a plain walk over the permuted places."""
    g, reps = grid(spark), 99
    w = cells.weights(g, "knn", 3).unionByName(cells.contiguity(g, "rook").withColumn("w", F.lit(0.5))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    w = w.where("src != 0")  # an island: it has no row, but is drawn
    whole = cells.moran_permutations(g, w, "mean_cva", reps), *[cells.local_permutations(g, w, "mean_cva", k, reps).toPandas().set_index("id").sort_index() for k in ("moran", "gi")]
    monkeypatch.setattr(cells, "SLICE", 7)
    monkeypatch.setattr(cells, "SIDE", 3)
    monkeypatch.setattr(cells, "STRIP", 13)
    monkeypatch.setattr(cells, "STRETCH", 11)
    cut = cells.moran_permutations(g, w, "mean_cva", reps), *[cells.local_permutations(g, w, "mean_cva", k, reps).toPandas().set_index("id").sort_index() for k in ("moran", "gi")]
    assert whole[0] == pytest.approx(cut[0])
    y = {r["cell_row"] << 31 | r["cell_col"]: r["mean_cva"] for r in g.collect()}
    ids, n = sorted(y), len(y)
    mean = sum(y.values()) / n
    near = {i: [] for i in ids}
    for r in w.collect():
        near[r["src"]].append((r["dst"], r["w"]))
    to = {p: permutation.places(n, 42, np.full(n, p), np.arange(n)) for p in range(1, reps + 1)}
    for got, again, kind in ((whole[1], cut[1], "moran"), (whole[2], cut[2], "gi")):
        assert list(got.index) == list(again.index) == ids[1:]
        assert np.allclose(got, again)
        for at, i in list(enumerate(ids))[1::9]:
            ws, c = sorted(x for _, x in near[i]), mean if kind == "moran" else 0.0
            stat = lambda lag: (y[i] - c) * lag if kind == "moran" else lag + y[i]  # noqa: B023, E731
            real, sims = stat(sum(x * (y[j] - c) for j, x in near[i])), []
            for p in to:
                back = np.argsort(to[p])
                draws = [ids[back[(to[p][at] + k) % n]] for k in range(1, len(ws) + 1)]
                assert i not in draws and len(set(draws)) == len(ws)
                sims.append(stat(sum(x * (y[j] - c) for j, x in zip(draws, ws, strict=True))))
            larger = sum(x >= real - 1e-12 * abs(real) for x in sims)
            assert got.p_sim[i] == pytest.approx((min(larger, reps - larger) + 1) / (reps + 1))
            assert got.z_sim[i] == pytest.approx((real - np.mean(sims)) / np.std(sims), abs=1e-6)
    z = np.array([y[i] - mean for i in ids])
    number = {i: k for k, i in enumerate(ids)}
    src, dst, ws = (np.array(x) for x in zip(*[(number[i], number[j], x) for i in ids for j, x in near[i]], strict=True))
    def moran(x):
        return n * (ws * x[src] * x[dst]).sum() / ws.sum() / (z * z).sum()
    sims = np.array([moran(z[np.argsort(to[p])]) for p in to])
    larger = int((sims >= moran(z)).sum())
    assert whole[0] == pytest.approx({"i": moran(z), "p_sim": (min(larger, reps - larger) + 1) / (reps + 1), "z_sim": (moran(z) - sims.mean()) / sims.std()})


def test_local_permutations_walked_and_stretched(spark, monkeypatch):
    """Up to WHOLE cells no cell and permutation is a row of its own; both ways count alike, also islands and equal values."""
    g, reps = grid(spark).where("not (cell_row = 0 and cell_col = 0)").coalesce(1), 60
    g = scratch.kept(g.unionByName(g.where("cell_row = 5 and cell_col = 5").withColumn("cell_row", F.lit(900).cast("long"))), "cells")
    w = scratch.kept(cells.contiguity(g, "queen").withColumn("w", 1.0 / (1 + F.pmod("dst", F.lit(3)))), "weights")
    flat = g.withColumn("mean_cva", F.lit(0.3))
    for cs, how in ((g, "moran"), (flat, "gi")):
        got = []
        for whole in (1 << 20, 0):
            monkeypatch.setattr(cells, "WHOLE", whole)
            asked = cells.local_permutations(cs, w, "mean_cva", how, reps)
            assert (("Window" in asked._jdf.queryExecution().optimizedPlan().toString()) == (whole == 0))
            got.append({r["id"]: (r["p_sim"], r["z_sim"]) for r in asked.collect()})
        walked, stretched = got
        assert walked.keys() == stretched.keys() and len(walked) == cs.count() - 1
        for k, (p, z) in walked.items():
            assert p == stretched[k][0] and z == pytest.approx(stretched[k][1], rel=1e-7, abs=1e-8)


def test_fdr(spark):
    p = [0.001, 0.2, 0.03, 0.5, 0.9, 0.04]
    q = [r["q"] for r in cells.bh_fdr(spark.createDataFrame(list(enumerate(p)), "id int, p double"), "p", "id").orderBy("p").collect()]
    assert all(a >= b for a, b in zip(q, sorted(p), strict=True)) and q == sorted(q)
    assert cells.bh_fdr(spark.createDataFrame([], "id int, p double"), "p", "id").count() == 0


def test_forest_and_stability(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(625, 3))
    x[0] = 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    one, two = (ml.isolation_forest(df, "id", ["a", "b", "c"], 60).orderBy(F.desc("ml_anomaly_score")).collect() for _ in range(2))
    assert one == two and one[0]["id"] == 0 and all(0 < r["ml_anomaly_score"] < 1 for r in one)
    with pytest.raises(change.AnalysisError):
        ml.isolation_forest(df.limit(19), "id", ["a"])


def test_dbscan(spark):
    pts = [(i, 0.1 * i, 0.0) for i in range(8)] + [(20 + i, 5.0 + 0.1 * i, 5.0) for i in range(8)] + [(99, 50.0, 50.0)]
    got = {r["id"]: r["ml_cluster_id"] for r in ml.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), "id", ["x", "y"], 0.25, 3).collect()}
    assert got == {**{i: 0 for i in range(8)}, **{20 + i: 1 for i in range(8)}, 99: -1}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _plain_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            todo.append(j)
            k += 1
    return label


def test_dbscan_of_crowds(spark, monkeypatch):
    """Crowds, rings around each other, bridges and noise, in one to four dimensions, with boxes that are halved."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(ml, "LEAF", 4)
    for d, eps in ((1, 0.02), (2, 0.11), (4, 0.5)):
        a = rng.uniform(0, 1, (120, d))
        b = rng.normal(3, 0.01, (150, d))
        c = rng.normal(3 + 0.9 * eps / d**0.5, 0.01, (150, d))
        x = np.concatenate([a, b, c, np.repeat(a[:1] + 7, 60, axis=0), rng.uniform(5, 6, (40, d))])
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{i} double" for i in range(d))).repartition(3)
        got = {r["id"]: r["ml_cluster_id"] for r in ml.dbscan(df, "id", [f"x{i}" for i in range(d)], eps, 5).collect()}
        assert [got[i] for i in range(len(x))] == _plain_dbscan(x, eps, 5).tolist(), d
    same = spark.range(100_000).selectExpr("id", "double(id % 2) * 1e-9 x", "0d y")
    got = ml.dbscan(same, "id", ["x", "y"], 0.5, 5).groupBy("ml_cluster_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 100_000)]
    assert ml.dbscan(same.limit(0), "id", ["x", "y"], 0.5, 5).count() == 0


def test_running_and_ranks(spark):
    rng = np.random.default_rng(8)
    v = [float(x) for x in rng.permutation(500)]
    df = spark.createDataFrame([(x, float(i % 7)) for i, x in enumerate(v)], "k double, v double").repartition(9)
    total = least = 0.0
    least = float("inf")
    sums = {r["k"]: r["s"] for r in ranks.running(df, [F.col("k")], "v", "sum", "s").collect()}
    mins = {r["k"]: r["m"] for r in ranks.running(df, [F.desc("k")], "v", "min", "m").collect()}
    by = dict(zip(v, (float(i % 7) for i in range(500))))
    for k in sorted(by):
        total += by[k]
        assert sums[k] == total
    for k in sorted(by, reverse=True):
        least = min(least, by[k])
        assert mins[k] == least
    scores = spark.createDataFrame([(i, s) for i, s in enumerate([0.5, 0.9, 0.5, None, 0.1, 0.9, 0.9])], "id int, s double")
    got = {r["id"]: (r["ml_anomaly_rank"], r["ml_anomaly_quantile"]) for r in ml.ranked(scores, "s").collect()}
    assert {i: g[0] for i, g in got.items()} == {1: 1, 5: 1, 6: 1, 0: 4, 2: 4, 4: 6, 3: 7}
    assert got[1][1] == pytest.approx(6 / 7) and got[3][1] == pytest.approx(1 / 7) and got[0][1] == pytest.approx(3.5 / 7)


def test_contamination_is_counted(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 2)))], "id int, a double, b double")
    got = ml.contamination_sensitivity(df, "id", ["a", "b"], 0.05, trees=30)
    assert [r["factor"] for r in got] == [0.5, 1.0, 2.0] and [r["contamination"] for r in got] == [0.025, 0.05, 0.1]
    assert [r["n_flagged"] for r in got] == [8, 15, 30] and all(r["top_k_overlap"] == 1.0 for r in got)


def test_attach_by_area(spark):
    """Pixels that a cell's border cuts count for both cells by their share."""
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2)], "label int, row int, col int")
    g = spark.createDataFrame([(0, 0, 1.0, "a"), (0, 1, 4.0, "b")], "cell_row long, cell_col long, v double, c string")
    r = features.attach(labels, g, 1.75, ["v"], ["c"], 10.0).first()
    assert r["v"] == pytest.approx((1.75 * 1 + 1.25 * 4) / 3) and r["c"] == "a"


def test_store_of_runs(spark, tmp_path):
    from veldt.plans.store import RunStore

    s = RunStore(spark, str(tmp_path / "runs"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    with pytest.raises(KeyError):
        s.read("t")
    assert s.put("a", {"t": rows(1, 2), "u": rows(9)}) == 1 and s.put("b", {"t": rows(3).selectExpr("v", "'x' w")}) == 2
    told = lambda t, n=None: sorted((r["run_id"], r["v"]) for r in s.read(t, n).collect())
    assert told("t") == [("a", 1), ("a", 2), ("b", 3)] and told("u") == [("a", 9)]
    assert s.put("a", {"t": rows(7)}) == 3
    assert told("t") == [("a", 7), ("b", 3)] and told("t", 1) == [("a", 1), ("a", 2)]
    with pytest.raises(KeyError):
        s.read("u")  # the run's new version has none
    assert {r["w"] for r in s.read("t").collect()} == {None, "x"}
    # a writer that comes too late begins again from what the other wrote
    late = RunStore(spark, str(tmp_path / "runs"))
    seen = late._version
    late._version = lambda n=[2]: n.pop() if n else seen()
    assert late.put("c", {"t": rows(5)}) == 4 and told("t") == [("a", 7), ("b", 3), ("c", 5)]


def test_latest_of_runs_that_share_a_time(spark, tmp_path):
    o = "select id o_orderkey, id o_custkey, 'F' o_orderstatus, 1d o_totalprice, timestamp'2001-08-01 00:00:00' - make_interval(0, 0, 0, if(id > 2, 1, 0)) o_orderdate, concat(%s, '-P') o_orderpriority from range(5)"
    for i, (digit, want) in enumerate((("5 - id", "5-p"), ("id + 1", "3-p"))):  # three runs share the last time
        sf = str(tmp_path / str(i))
        spark.sql(o % digit).write.parquet(f"{sf}/orders.parquet")
        assert [tuple(r) for r in catalog.QUERIES["sql_n07"](spark, sf).collect()] == [(want, "2001-08-01 00:00:00", "manual")]


def test_latest_of_runs_within_a_second(tmp_path, spark):
    """Times that differ by a fraction of a second are no tie: the latest run is the SQL's."""
    p, con = tmp_path / "orders.parquet", duckdb.connect()
    con.execute(f"copy (select i o_orderkey, i o_custkey, 'F' o_orderstatus, 1e0 o_totalprice, timestamp '2001-08-01 00:00:00' + interval (900 - 225 * i) milliseconds as o_orderdate, (i + 1) || '-P' as o_orderpriority from range(5) t(i)) to '{p}' (format parquet)")
    con.execute(f"create view orders as select * from read_parquet('{p}')")
    want = con.execute(catalog.SQL["sql_n07"]).fetchall()
    assert want == [("1-p", "2001-08-01 00:00:00.9", "manual")]
    assert [tuple(r) for r in catalog.QUERIES["sql_n07"](spark, str(tmp_path)).collect()] == want
    runs = {r["run_timestamp"] for r in catalog._runs(spark, str(tmp_path)).read("run_metadata").collect()}
    assert runs == {"2001-08-01 00:00:00" + f for f in ("", ".225", ".45", ".675", ".9")}

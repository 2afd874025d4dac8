"""Named queries over the pixel view, and the SQL that DuckDB holds them against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt import scratch
from veldt.functions import projection
from veldt.functions.quantiles import quantiles
from veldt.operators import cells, change, features, ml, overlay, radiometry, raster
from veldt.plans import store
from veldt.plans.oracles import K, ROOK, projection_sql, sql
from veldt.sources import discovery, pixels, tiff, vectors
from veldt.sources.pixels import BANDS, PIXEL_M
from veldt.sources.tiff import Grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CELL_PX, LEAST_PX = 6, 4


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def told(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits from one engine to another."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def once(step: Callable) -> Callable:
    """A step of a scene that is taken once, however many others build on it."""

    @functools.wraps(step)
    def run(self: Scene):
        if step.__name__ not in self.made:
            self.made[step.__name__] = step(self)
        return self.made[step.__name__]

    return run


class Scene:
    """What a query's steps share, each built once: change vectors, threshold, foreground, components, grid."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.made = spark, {}
        self.px = pixels.usable(spark, sf_dir)
        self.height = pixels.height(pixels.frame(spark, sf_dir))
        self.width = pixels.WIDTH

    @once
    def vectors(self) -> DataFrame:
        return scratch.kept(change.change_vectors(self.px), "vectors")

    @once
    def binary(self) -> tuple[DataFrame, float]:
        v = self.vectors()
        t = change.threshold(v, "cva", "otsu")
        return v.withColumn("changed", F.col("cva") > F.lit(t)), t

    @once
    def foreground(self) -> DataFrame:
        return scratch.kept(self.binary()[0].where("changed").select("row", "col"), "foreground")

    @once
    def cleaned(self) -> DataFrame:
        return scratch.kept(raster.morphology(self.foreground(), self.height, self.width), "cleaned")

    @once
    def labels(self) -> DataFrame:
        return scratch.kept(raster.large(raster.components(self.cleaned()), LEAST_PX), "labels")

    @once
    def grid(self) -> DataFrame:
        return scratch.kept(cells.grid(self.binary()[0], CELL_PX), "grid")

    @once
    def hotspots(self) -> DataFrame:
        g = self.grid()
        z = cells.gi_star(g, cells.contiguity(g), "mean_cva").withColumn("gi_pvalue", cells.normal_p(F.col("gi_zscore")))
        z = cells.bh_fdr(z, "gi_pvalue", "id", "gi_qvalue").withColumn("hotspot_class", cells.hotspot_class(F.col("gi_zscore"), F.col("gi_qvalue")))
        return scratch.kept(g.join(z, cells.cell_id() == F.col("id")), "hotspots")

    @once
    def features(self) -> DataFrame:
        v, t = self.binary()
        lab = self.labels()
        made = features.metrics(lab, v, "cva", PIXEL_M)
        at = features.attach(lab, self.hotspots(), CELL_PX, ["gi_zscore", "gi_qvalue"], ["hotspot_class"], PIXEL_M)
        made = features.confidence(scratch.kept(made.join(at, "label", "left"), "features"), t)
        return features.numbered(made, ["label"])


AFTER = ", ".join(f"round(a{b[2]}, 9) after_{b}" for b in BANDS)


@query(sql(f"select pid, {', '.join(f'round(p{b[2]}, 9) before_{b}' for b in BANDS)}, {AFTER} from px"))
def reflectance(spark, sf):
    return told(pixels.usable(spark, sf).select("pid", *[f"{d}_{b}" for d in ("before", "after") for b in BANDS]), 9)


@query(sql("select pid, round(a4 - p4, 9) + 0e0 diff_b04, round(a3 - p3, 9) + 0e0 diff_b03, round(a2 - p2, 9) + 0e0 diff_b02 from px"))
def band_diff(spark, sf):
    return told(pixels.usable(spark, sf).select("pid", *[change.diff(b).alias(f"diff_{b}") for b in BANDS]), 9)


@query(sql("select pid, round(sqrt((a4-p4)*(a4-p4)+(a3-p3)*(a3-p3)+(a2-p2)*(a2-p2)), 9) distance from px"))
def baseline_distance(spark, sf):
    return told(change.baseline(pixels.usable(spark, sf)).select("pid", "distance"), 9)


@query(sql("select pid, round(least(greatest((d - lo) / (hi - lo), 0e0), 1e0), 6) intensity from (select pid, d, min(d) over () lo, max(d) over () hi from (select pid, sqrt((a4-p4)*(a4-p4)+(a3-p3)*(a3-p3)+(a2-p2)*(a2-p2)) d from px))"))
def baseline_intensity(spark, sf):
    return told(change.baseline(pixels.usable(spark, sf)).select("pid", "intensity"))


def _normalized(spark, sf, method):
    return told(radiometry.normalize(pixels.usable(spark, sf), method).select("pid", *[f"after_{b}" for b in BANDS]))


_DISTANCE = "select pid, sqrt((a4-p4)*(a4-p4)+(a3-p3)*(a3-p3)+(a2-p2)*(a2-p2)) d from px"


@query(sql(
    "select pid, cast(floor(least(greatest((d - lo) / (hi - lo), 0e0), 1e0) * 255) as int) change_byte "
    f"from (select pid, d, min(d) over () lo, max(d) over () hi from ({_DISTANCE}))"
))
def change_map(spark, sf):
    return change.as_bytes(change.baseline(pixels.usable(spark, sf))).select("pid", "change_byte")


@query(sql("select round(coalesce(quantile_cont(v, 0.98), 1e0), 6) top from cva where v > 0"))
def figure_scale(spark, sf):
    return told(spark.createDataFrame([(change.scale_top(change.change_vectors(pixels.usable(spark, sf)), "cva"),)], "top double"))


@query(sql("select pid, " + ", ".join(f"round((a{k} - ma{k}) * (case when da{k} > 1e-6 then db{k} / da{k} else 1e0 end) + mb{k}, 6) after_b0{k}" for k in (4, 3, 2)) + " from px, (select " + ", ".join(f"median(p{k}) mb{k}, median(a{k}) ma{k}, mad(p{k}) db{k}, mad(a{k}) da{k}" for k in (4, 3, 2)) + " from px)"))
def norm_median_mad(spark, sf):
    return _normalized(spark, sf, "robust_median_mad")


@query(sql("select pid, " + ", ".join(f"round(a{k} * (bh{k} - bl{k}) / (ah{k} - al{k}) + bl{k} - al{k} * (bh{k} - bl{k}) / (ah{k} - al{k}), 6) after_b0{k}" for k in (4, 3, 2)) + " from px, (select " + ", ".join(f"quantile_cont(p{k}, 0.02) bl{k}, quantile_cont(p{k}, 0.98) bh{k}, quantile_cont(a{k}, 0.02) al{k}, quantile_cont(a{k}, 0.98) ah{k}" for k in (4, 3, 2)) + " from px)"))
def norm_percentile(spark, sf):
    return _normalized(spark, sf, "percentile_matching")


@query(sql("select pid, " + ", ".join(f"round(a{k} * s{k} + i{k}, 6) after_b0{k}" for k in (4, 3, 2)) + " from px, (select " + ", ".join(f"regr_slope(p{k}, a{k}) s{k}, regr_intercept(p{k}, a{k}) i{k}" for k in (4, 3, 2)) + " from (select *, quantile_cont(d, 0.1) over () e from (select *, sqrt((a4-p4)*(a4-p4)+(a3-p3)*(a3-p3)+(a2-p2)*(a2-p2)) d from px)) where d <= e)"))
def norm_pif(spark, sf):
    return _normalized(spark, sf, "pif_linear")


@query(sql("select pid, " + ", ".join(f"cast(floor(least(greatest(({d}{k} - lo{k}) / (hi{k} - lo{k}), 0e0), 1e0) * 255) as int) {n}_b0{k}" for d, n in (("p", "before"), ("a", "after")) for k in (4, 3, 2)) + " from px, (select " + ", ".join(f"quantile_cont(p{k}, 0.02) lo{k}, quantile_cont(p{k}, 0.98) hi{k}" for k in (4, 3, 2)) + " from px)"))
def rgb_stretch(spark, sf):
    return radiometry.rgb_stretch(pixels.usable(spark, sf)).select("pid", *[f"{d}_{b}" for d in ("before", "after") for b in BANDS])


@query(sql("select pid, round(z4, 6) + 0e0 z_b04, round(z3, 6) + 0e0 z_b03, round(z2, 6) + 0e0 z_b02 from z"))
def cva_zscore(spark, sf):
    return told(change.change_vectors(pixels.usable(spark, sf)).select("pid", *[f"z_{b}" for b in BANDS]))


@query(sql("select pid, round(v, 6) cva, round(bright, 6) + 0e0 brightness_diff from cva"))
def cva_magnitude(spark, sf):
    return told(change.change_vectors(pixels.usable(spark, sf)).select("pid", "cva", "brightness_diff"))


@query(sql("select bin, n from hist"))
def otsu_hist(spark, sf):
    return change.histogram(change.change_vectors(pixels.usable(spark, sf)), "cva")[0]


def _threshold(spark, sf, method, **options):
    v = change.change_vectors(pixels.usable(spark, sf))
    t = change.threshold(v, "cva", method, **options)
    over = (F.col("cva") > F.lit(t)).cast("long")
    return told(v.agg(F.lit(t).alias("threshold"), F.sum(over).alias("n_changed"), (100.0 * F.avg(over.cast("double"))).alias("pct")))


_COUNT = "select round(t, 6) threshold, cast(count_if(v > t) as bigint) n_changed, round(100e0 * avg(case when v > t then 1e0 else 0e0 end), 6) pct from cva, "


@query(sql(_COUNT + "thr group by t"))
def threshold_otsu(spark, sf):
    return _threshold(spark, sf, "otsu")


@query(sql(_COUNT + "(select quantile_cont(v, 0.95) t from cva) group by t"))
def threshold_percentile(spark, sf):
    return _threshold(spark, sf, "percentile", percentile=95.0)


@query(sql(_COUNT + "(select 2.5e0 t) group by t"))
def threshold_manual(spark, sf):
    return _threshold(spark, sf, "manual", manual=2.5)


@query(sql("select pid, r > 0 and c > 0 valid_before, r > 0 and c > 0 valid_after, r > 0 and c > 0 valid from px0"))
def valid_mask(spark, sf):
    f = pixels.frame(spark, sf)
    return f.select("pid", pixels.valid("before").alias("valid_before"), pixels.valid("after").alias("valid_after"), (pixels.valid("before") & pixels.valid("after")).alias("valid"))


#: A quadrilateral a little inside the frame, in shares of its width and height.
AOI = [(0.055, 0.032), (0.951, 0.071), (0.913, 0.934), (0.027, 0.887)]


def _edges(spark, sf, polygons: list):
    """Sides of polygons whose points are shares of the frame's width and height."""
    h = pixels.height(pixels.frame(spark, sf))
    return vectors.edges(spark, [[[(x * 100, y * h) for x, y in ring] for ring in rings] for rings in polygons])


_RING = " union all ".join(f"select {a[0] * 100}e0 x1, {a[1]}e0 * h y1, {b[0] * 100}e0 x2, {b[1]}e0 * h y2 from dims" for a, b in zip(AOI, AOI[1:] + AOI[:1], strict=True))


@query(sql(f"select pid, (select count(*) from ({_RING}) e where (r + 0.5e0) >= least(y1, y2) and (r + 0.5e0) < greatest(y1, y2) and x1 + ((r + 0.5e0) - y1) * (x2 - x1) / (y2 - y1) > c + 0.5e0) % 2 = 1 in_aoi from px0"))
def aoi_rasterize(spark, sf):
    f = pixels.frame(spark, sf).select("pid", "row", "col")
    inside = overlay.inside(f, _edges(spark, sf, [[AOI]])).select("pid", F.lit(True).alias("yes"))
    return f.join(inside, "pid", "left").select("pid", F.coalesce("yes", F.lit(False)).alias("in_aoi"))


@query(sql("select r as row, c as col from er"))
def erode(spark, sf):
    s = Scene(spark, sf)
    return raster.erode(s.foreground(), s.height, s.width)


@query(sql("select r as row, c as col from di"))
def dilate(spark, sf):
    s = Scene(spark, sf)
    return raster.dilate(s.foreground(), s.height, s.width)


@query(sql("select r as row, c as col from op"))
def opening(spark, sf):
    s = Scene(spark, sf)
    return raster.morphology(s.foreground(), s.height, s.width, "opening")


@query(sql("select r as row, c as col from cl"))
def closing(spark, sf):
    s = Scene(spark, sf)
    return raster.morphology(s.foreground(), s.height, s.width, "closing")


@query(sql("select r as row, c as col from oc"))
def open_close(spark, sf):
    s = Scene(spark, sf)
    return raster.morphology(s.foreground(), s.height, s.width, "opening_then_closing")


@query(sql("select r as row, c as col, label from lab"))
def components(spark, sf):
    return raster.components(Scene(spark, sf).cleaned())


@query(sql("select r as row, c as col, label from big"))
def min_area_filter(spark, sf):
    return raster.large(raster.components(Scene(spark, sf).cleaned()), LEAST_PX)


_HOLED = "ring as (select r, c from oc except select r, c from oc where r % 30 between 8 and 10 and c between 8 and 10)"


@query(sql(f""", {_HOLED}, bg as (select i // 100 r, i % 100 c from range((select h * 100 from dims)) t(i) where (i // 100, i % 100) not in (select (r, c) from ring)),
outside as (select r, c from bg where r = 0 or c = 0 or c = 99 or r = (select h - 1 from dims) union select bg.r, bg.c from outside, {'(values (-1,0),(1,0),(0,-1),(0,1))'} o(a, b) join bg on bg.r = outside.r + a and bg.c = outside.c + b)
select cast(r as int) as row, cast(c as int) as col from (select r, c from ring union select r, c from bg except select r, c from outside)"""))
def fill_holes(spark, sf):
    """The cleaned components, first bored through in their middle."""
    s = Scene(spark, sf)
    bored = s.cleaned().where(~((F.col("row") % 30).between(8, 10) & F.col("col").between(8, 10)))
    return raster.fill_holes(bored, s.height, s.width)


@query(sql("select label, round(area_m2, 6) area_m2, round(perimeter_m, 6) perimeter_m, round(compactness, 6) compactness, round(mean_change, 6) mean_change, round(max_change, 6) max_change, round(p95_change, 6) p95_change from met"))
def feature_metrics(spark, sf):
    s = Scene(spark, sf)
    return told(features.metrics(s.labels(), s.vectors(), "cva", PIXEL_M).select("label", "area_m2", "perimeter_m", "compactness", "mean_change", "max_change", "p95_change"))


@query(sql("select label, round(confidence, 6) confidence from conf"))
def confidence(spark, sf):
    return told(Scene(spark, sf).features().select("label", "confidence"))


@query(sql("select label, round(least(greatest(0.3e0 * c1 + 0.2e0 * c2 + 0.2e0 * c3 + 0.2e0 * c4 + 0.1e0 * (case when hi > lo then (compactness - lo) / (hi - lo) else 0e0 end), 0e0), 1e0), 6) confidence from conf1, (select min(compactness) lo, max(compactness) hi from conf1)"))
def confidence_ml(spark, sf):
    """With anomaly scores; compactness stands in for them."""
    s = Scene(spark, sf)
    return told(features.confidence(s.features().drop("confidence"), s.binary()[1], "compactness").select("label", "confidence"))


GRID = ["cell_row", "cell_col", "valid_pixel_count", "mean_cva", "median_cva", "p90_cva", "p95_cva", "changed_proportion", *[f"mean_diff_{b}" for b in BANDS], "local_std_cva", "total_pixel_count"]


@query(sql("select " + ", ".join(c if c.endswith(("row", "col", "count")) else f"round({c}, 6) + 0e0 {c}" for c in GRID) + " from grid"))
def analysis_grid(spark, sf):
    return told(cells.grid(Scene(spark, sf).binary()[0], CELL_PX).select(*GRID))


def _overview(how, factor):
    return lambda spark, sf: told(raster.overview(pixels.frame(spark, sf).where(pixels.valid("after")).withColumnRenamed("after_b04", "v"), "v", factor, how))


for _f in (2, 4, 8):
    QUERIES[f"overview_avg_{_f}"] = _overview("average", _f)
    SQL[f"overview_avg_{_f}"] = sql(f"select cast(floor(r / {_f}e0) as int) as row, cast(floor(c / {_f}e0) as int) as col, round(avg(v), 6) v from dn group by 1, 2")
    QUERIES[f"overview_nearest_{_f}"] = _overview("nearest", _f)
    SQL[f"overview_nearest_{_f}"] = sql(f"select cast(floor(r / {_f}e0) as int) as row, cast(floor(c / {_f}e0) as int) as col, round(arg_min(v, r * 1000 + c), 6) v from dn group by 1, 2")


@query(sql("select r as row, c as col, round(sum(w * v) / sum(w), 6) v from (select r, c, 0.7e0 w, v from dn union all select r, c - 1, 0.3e0, v from dn) group by 1, 2"))
def resample_bilinear(spark, sf):
    """The later date, moved by 3 m, on the frame's own centres."""
    f = pixels.frame(spark, sf).where(pixels.valid("after")).withColumnRenamed("after_b04", "v")
    return told(raster.resample_bilinear(f, "v", 0.3, 0.0))


@query(sql("select src, dst from queen"))
def weights_queen(spark, sf):
    return cells.contiguity(Scene(spark, sf).grid(), "queen")


@query(sql("select src, dst from rook"))
def weights_rook(spark, sf):
    return cells.contiguity(Scene(spark, sf).grid(), "rook")


@query(sql("select src, dst from (select a.id src, b.id dst, row_number() over (partition by a.id order by (a.cr - b.cr) * (a.cr - b.cr) + (a.cc - b.cc) * (a.cc - b.cc), b.id) k from cell a join cell b on a.id <> b.id) where k <= 8"))
def weights_knn(spark, sf):
    return cells.nearest(Scene(spark, sf).grid(), 8)


@query(sql("select src, dst, round(w, 9) w from wr"))
def row_standardize(spark, sf):
    return told(cells.weights(Scene(spark, sf).grid(), "queen"), 9)


@query(sql("""select round(i, 6) i, round(ei, 6) ei, round(v, 9) var_norm, round((i - ei) / sqrt(v), 6) z_norm from (
select i, -1e0 / (n - 1) ei, (n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1e0)) - 1e0 / ((n - 1e0) * (n - 1e0)) v from
(select n / s0 * num / d i, * from g0, den, (select sum(w * a.z * b.z) num, sum(w) s0 from wr join zc a on a.id = src join zc b on b.id = dst),
(select sum(0.5e0 * (a.w + b.w) * (a.w + b.w)) s1 from wr a join wr b on a.src = b.dst and a.dst = b.src),
(select sum(w * w) s2 from (select id, sum(w) w from (select src id, w from wr union all select dst, w from wr) group by id))))"""))
def global_moran(spark, sf):
    g = Scene(spark, sf).grid()
    r = cells.global_moran(g, cells.weights(g), "mean_cva")
    out = spark.createDataFrame([(r["i"], r["ei"], r["var_norm"], r["z_norm"])], "i double, ei double, var_norm double, z_norm double")
    return out.select(F.round("i", 6).alias("i"), F.round("ei", 6).alias("ei"), F.round("var_norm", 9).alias("var_norm"), F.round("z_norm", 6).alias("z_norm"))


@query(sql("select zc.id, round((n - 1) * z * coalesce(lag, 0e0) / d, 6) + 0e0 local_moran_stat, round(coalesce(lag, 0e0), 6) + 0e0 spatial_lag, cast(case when z > 0 and lag > 0 then 1 when lag > 0 then 2 when z <= 0 then 3 else 4 end as int) quadrant from zc left join lag using (id), g0, den"))
def local_moran(spark, sf):
    g = Scene(spark, sf).grid()
    return told(cells.local_moran(g, cells.weights(g), "mean_cva"))


@query(sql("select id, round(g, 9) gi_star, round(z, 9) gi_zscore from gi"))
def gi_star(spark, sf):
    g = Scene(spark, sf).grid()
    return told(cells.gi_star(g, cells.contiguity(g), "mean_cva"), 9)


@query(sql("select id, round(p, 6) gi_pvalue, round(q, 6) gi_qvalue from fdr"))
def bh_fdr(spark, sf):
    return told(Scene(spark, sf).hotspots().select("id", "gi_pvalue", "gi_qvalue"))


@query(sql("select id, cls hotspot_class from hot"))
def hotspot_class(spark, sf):
    return Scene(spark, sf).hotspots().select("id", "hotspot_class")


@query(sql("select label, round(gi_zscore, 6) gi_zscore, round(gi_qvalue, 6) gi_qvalue, hotspot_class from att"))
def overlay_attach(spark, sf):
    s = Scene(spark, sf)
    return told(features.attach(s.labels(), s.hotspots(), CELL_PX, ["gi_zscore", "gi_qvalue"], ["hotspot_class"], PIXEL_M))


@query(sql("select id, cast(rank() over (order by round(y, 6) desc) as int) ml_anomaly_rank from cell"))
def anomaly_rank(spark, sf):
    g = Scene(spark, sf).grid().select(cells.cell_id().alias("id"), F.round("mean_cva", 6).alias("y"))
    return ml.ranked(g, "y").select("id", F.col("ml_anomaly_rank").cast("int").alias("ml_anomaly_rank"))


@query(sql("select id, round((rank() over (order by y) + (count(*) over (partition by y) - 1) / 2e0) / count(*) over (), 6) ml_anomaly_quantile from (select id, round(y, 1) y from cell)"))
def anomaly_quantile(spark, sf):
    g = Scene(spark, sf).grid().select(cells.cell_id().alias("id"), F.round("mean_cva", 1).alias("y"))
    return told(ml.ranked(g, "y").select("id", "ml_anomaly_quantile"))


@query(sql(f"select cell_row * {K} + cell_col id, " + ", ".join(f"round(({c} - {c}_m) / (case when {c}_h = {c}_l then 1e0 else {c}_h - {c}_l end), 6) + 0e0 {c}" for c in ml.FEATURES) + " from grid, (select " + ", ".join(f"quantile_cont({c}, 0.25) {c}_l, median({c}) {c}_m, quantile_cont({c}, 0.75) {c}_h" for c in ml.FEATURES) + " from grid)"))
def robust_scale(spark, sf):
    g = Scene(spark, sf).grid()
    return told(ml.robust_scale(g, list(ml.FEATURES)).select(cells.cell_id().alias("id"), *ml.FEATURES))


@query(sql("""
, pt as (select id, (y - mean) / sd x, cast(cr as double) / 4 yy from cell, g0),
nb as (select a.id a, b.id b from pt a join pt b on (a.x - b.x) * (a.x - b.x) + (a.yy - b.yy) * (a.yy - b.yy) <= 0.01e0),
core as (select a id from nb group by a having count(*) >= 5),
cc as (select id, id root from core union select cc.id, nb.b from cc join nb on nb.a = cc.root join core on core.id = nb.b),
root as (select id, min(root) root from cc group by id),
num as (select id, cast(dense_rank() over (order by root) - 1 as int) k from root)
select pt.id, coalesce(num.k, (select min(k) from nb join num on num.id = nb.a where nb.b = pt.id), -1)::int ml_cluster_id from pt left join num on num.id = pt.id"""))
def dbscan(spark, sf):
    g = Scene(spark, sf).grid()
    s = g.agg(F.avg("mean_cva"), F.stddev_pop("mean_cva")).first()
    p = scratch.kept(g.select(cells.cell_id().alias("id"), ((F.col("mean_cva") - F.lit(s[0])) / F.lit(s[1])).alias("x"), (F.col("cell_row") / 4.0).alias("y")), "points")
    return ml.dbscan(p, "id", ["x", "y"], 0.1, 5)


_NAMES = """
with f(folder, name) as (select 'sentinel2_20230812_' || o_orderkey % 5, 'T35LTG_20230812_' || (case o_orderkey % 7 when 0 then 'B02_x_B02' when 1 then 'B03' when 2 then 'b04' when 3 then 'B8A' when 4 then 'B08' when 5 then 'XB02X' else 'note' end) || (case when o_orderkey % 3 = 0 then '_10m.jp2' when o_orderkey % 3 = 1 then '.TIF' else '.txt' end) from orders),
t as (select folder, upper(regexp_extract(regexp_replace(name, '[.][^.]*$', ''), '(?i)(^|[^A-Za-z0-9])(B0[2348]|B8A)($|[^A-Za-z0-9])', 2)) band from f where regexp_matches(lower(name), '[.](tif|tiff|jp2)$')),
w as (select folder, band from (select distinct folder from f) cross join (values ('B02'), ('B03'), ('B04')) b(band))
select folder, band, count(t.band)::bigint n, case when count(t.band) = 0 then 'missing' when count(t.band) > 1 then 'duplicate' else 'ok' end status from w left join t using (folder, band) group by 1, 2"""


@query(_NAMES)
def band_discovery(spark, sf):
    k = F.col("o_orderkey")
    band = F.get(F.array(*[F.lit(x) for x in ("B02_x_B02", "B03", "b04", "B8A", "B08", "XB02X", "note")]), (k % 7).cast("int"))
    ext = F.get(F.array(F.lit("_10m.jp2"), F.lit(".TIF"), F.lit(".txt")), (k % 3).cast("int"))
    names = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("sentinel2_20230812_"), (k % 5).cast("string")).alias("folder"), F.concat(F.lit("T35LTG_20230812_"), band, ext).alias("name"))
    return discovery.band_table(names)


@query("select folder, coalesce(nullif(regexp_extract(folder, '(20[0-9]{6})', 1), ''), folder) label from (select distinct case when o_orderkey % 2 = 0 then 'sentinel2_' || (20230000 + o_orderkey % 50) else 'scene' || o_orderkey % 7 end folder from orders)")
def date_label(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("sentinel2_"), (20230000 + k % 50).cast("string"))).otherwise(F.concat(F.lit("scene"), (k % 7).cast("string")))
    f = spark.read.parquet(f"{sf}/orders.parquet").select(name.alias("folder")).distinct()
    return f.select("folder", discovery.date_label(F.col("folder")).alias("label"))


# Band files as orders tell of them: a date for each priority, a band for each remainder of the key.
_META = """select o_orderpriority as date, 'B0' || cast(2 + o_orderkey % 3 as varchar(1)) as band,
case when max(o_custkey) % 5 = 0 then null when max(o_custkey) % 5 = 1 then 'EPSG:32736' else 'EPSG:32735' end as crs,
cast(100 + count(*) % 2 as int) as width, cast(150 as int) as height, case when min(o_orderkey) % 4 = 0 then '10|0|3|10' else '10|0|0|10' end as transform,
avg(case when o_totalprice > 200000 then 1e0 else 0e0 end) - 0.1e0 * cast(min(o_orderkey) % 3 as int) as valid_ratio
from orders where o_orderpriority is not null group by o_orderpriority, o_orderkey % 3"""


@query(f"""with m as ({_META}), f as (select date, arg_min(row(crs), band) c0, arg_min(width, band) w0, arg_min(height, band) h0, arg_min(transform, band) t0 from m group by 1)
select severity, code, count(*)::bigint n from (
select 'error' severity, 'missing_crs' code from m where crs is null union all select 'warning', 'low_valid_ratio' from m where valid_ratio < 0.5
union all select 'error', 'band_crs_mismatch' from m join f using (date) where row(crs) is distinct from c0 union all select 'error', 'band_dimension_mismatch' from m join f using (date) where width <> w0 or height <> h0
union all select 'error', 'band_transform_mismatch' from m join f using (date) where transform <> t0) group by 1, 2""")
def validation_rules(spark, sf):
    from veldt.operators import validation

    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders_of_bands")
    m = spark.sql(_META.replace("from orders ", "from orders_of_bands ").replace("varchar(1)", "string"))
    return validation.issues(scratch.kept(m, "bands")).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query(sql("select r as row, c as col, round(500000 + (c + 0.5e0) * 10, 6) x, round(8600000 - (r + 0.5e0) * 10, 6) y from px"))
def pixel_centres(spark, sf):
    p = pixels.usable(spark, sf)
    return told(p.select("row", "col", (F.lit(pixels.ORIGIN_X) + (F.col("col") + 0.5) * PIXEL_M).alias("x"), (F.lit(pixels.ORIGIN_Y) - (F.col("row") + 0.5) * PIXEL_M).alias("y")))


@query(sql("select cell_row, cell_col, 500000e0 + cell_col * 60 x0, 8600000e0 - (cell_row + 1) * 60 y0, 500000e0 + (cell_col + 1) * 60 x1, 8600000e0 - cell_row * 60 y1 from grid"))
def cell_boxes(spark, sf):
    g, s = Scene(spark, sf).grid(), PIXEL_M * CELL_PX
    return g.select("cell_row", "cell_col", (pixels.ORIGIN_X + F.col("cell_col") * s).alias("x0"), (pixels.ORIGIN_Y - (F.col("cell_row") + 1) * s).alias("y0"), (pixels.ORIGIN_X + (F.col("cell_col") + 1) * s).alias("x1"), (pixels.ORIGIN_Y - F.col("cell_row") * s).alias("y1"))


_CUT = f"""(select label, 100e0 * sum(abs(a)) area_m2 from (
  select label, r, c, sum(case when y2 > y1 then 1e0 else -1e0 end * (t - s) * case when abs(v - u) > 1e-9 then (case when v <= 0 then 0e0 when v < 1 then v * v / 2 else v - 0.5e0 end - case when u <= 0 then 0e0 when u < 1 then u * u / 2 else u - 0.5e0 end) / (v - u) else least(greatest(u, 0e0), 1e0) end) a
  from (select *, x1 + (s - y1) * (x2 - x1) / (y2 - y1) - c u, x1 + (t - y1) * (x2 - x1) / (y2 - y1) - c v from (
    select big.label, big.r, big.c, e.*, greatest(least(y1, y2), r) s, least(greatest(y1, y2), r + 1) t from big join ({_RING}) e on y1 <> y2 and least(y1, y2) < r + 1 and greatest(y1, y2) > r) p0) p1
  group by 1, 2, 3) p2 group by 1 having sum(abs(a)) * 100e0 > 1e-9)"""


def _clip(spark, sf, polygons=((AOI,),)):
    s = Scene(spark, sf)
    return s.labels(), scratch.kept(overlay.clip(overlay.runs(s.labels()), _edges(spark, sf, polygons)), "clipped")


def _measured(traps: DataFrame) -> DataFrame:
    return features.rounded(overlay.measures(overlay.boundary(traps), PIXEL_M)).select("label", "area_m2", "perimeter_m", "compactness")


@query(sql(f"select label, round(area_m2, 6) area_m2 from {_CUT}"))
def feature_clip(spark, sf):
    """What the area of interest leaves of each component; those outside are gone."""
    return told(_measured(_clip(spark, sf)[1]).select("label", "area_m2"))


@query(sql(f"select (select count(distinct label) from big) n_raw, count(*) n_after_aoi, count_if(area_m2 >= 700)::bigint n_after_min_area from {_CUT}"))
def clip_counts(spark, sf):
    """Components before the clip, after it, and with enough area left."""
    labels, traps = _clip(spark, sf)
    n = labels.select("label").distinct().count()
    return _measured(traps).agg(F.count("*").alias("n_after_aoi"), F.count_if(F.col("area_m2") >= 700).alias("n_after_min_area")).select(F.lit(n).cast("long").alias("n_raw"), "*")


# The perimeter of a clip by a convex area, in closed form: what is inside of the pixels' sides that face another component,
# and what is on the component's pixels of the area's sides.
_CLIP = f"""(
  with side as (select *, row_number() over () e from ({_RING})),
  face as (
    select f.label, f.r, f.c, o.a, o.b from big f, {ROOK} o(a, b) left join big g on g.r = f.r + o.a and g.c = f.c + o.b
    where g.label is distinct from f.label),
  seg as (
    select label, r, c, a, b, c + (case when b = 1 then 1e0 else 0e0 end) px, r + (case when a = 1 then 1e0 else 0e0 end) py,
      c + (case when b = -1 then 0e0 else 1e0 end) qx, r + (case when a = -1 then 0e0 else 1e0 end) qy from face),
  cut as (
    select label, r, c, a, b, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) p, (x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1) q from seg, side),
  inner_part as (
    select label, greatest(0e0, min(case when q < 0 then case when p < 0 then -1e0 else p / (p - q) end else 1e0 end)
      - max(case when p < 0 then case when q < 0 then 2e0 else p / (p - q) end else 0e0 end)) len from cut group by label, r, c, a, b),
  own_part as (
    select label, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * greatest(0e0,
      least(1e0, greatest((c - x1) / (x2 - x1), (c + 1 - x1) / (x2 - x1)), greatest((r - y1) / (y2 - y1), (r + 1 - y1) / (y2 - y1)))
      - greatest(0e0, least((c - x1) / (x2 - x1), (c + 1 - x1) / (x2 - x1)), least((r - y1) / (y2 - y1), (r + 1 - y1) / (y2 - y1)))) len
    from big join side on c + 1 >= least(x1, x2) and c <= greatest(x1, x2) and r + 1 >= least(y1, y2) and r <= greatest(y1, y2)),
  long as (select label, 10e0 * sum(len) perimeter_m from (select * from inner_part union all select * from own_part) group by 1)
  select label, area_m2, perimeter_m, least(4 * pi() * area_m2 / (perimeter_m * perimeter_m), 1e0) compactness from {_CUT} join long using (label))"""
_CLIPPED = f"select label, round(area_m2, 6) area_m2, round(perimeter_m, 6) perimeter_m, round(compactness, 6) compactness from {_CLIP}"


@query(sql(_CLIPPED))
def clip_metrics(spark, sf):
    """Area, perimeter and compactness of what the area of interest leaves."""
    return told(_measured(_clip(spark, sf)[1]))


def _between(a: tuple, b: tuple, t: float) -> tuple:
    return (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))


@query(sql(_CLIPPED))
def clip_union(spark, sf):
    """The same area as two polygons that overlap in a fifth of it, sides along sides: their union is clipped, once."""
    a, b, c, d = AOI
    west = [a, _between(a, b, 0.6), _between(d, c, 0.6), d]
    east = [_between(a, b, 0.4), b, c, _between(d, c, 0.4)]
    return told(_measured(_clip(spark, sf, [[west], [east[::-1]]])[1]))


def _lobes() -> str:
    """Sides of the two triangles that a ring A, C, B, D makes of the area's corners, its diagonals crossing."""
    a, b, c, d = AOI
    t = ((b[0] - a[0]) * (d[1] - b[1]) - (b[1] - a[1]) * (d[0] - b[0])) / ((c[0] - a[0]) * (d[1] - b[1]) - (c[1] - a[1]) * (d[0] - b[0]))
    x = _between(a, c, t)
    rows = [(k, *p, *q) for k, tri in enumerate(((x, c, b), (x, a, d))) for p, q in zip(tri, tri[1:] + tri[:1], strict=True)]
    return " union all ".join(f"select {k} part, {p * 100}e0 x1, {q}e0 * h y1, {r * 100}e0 x2, {s}e0 * h y2 from dims" for k, p, q, r, s in rows)


_BOW = _CUT.replace(_RING, _lobes()).replace("select label, r, c, sum(", "select label, r, c, part, sum(").replace("group by 1, 2, 3)", "group by 1, 2, 3, 4)")


@query(sql(f"select label, round(area_m2, 4) area_m2 from {_BOW}"))
def clip_repair(spark, sf):
    """A ring that crosses itself is repaired: both its lobes are clipped."""
    a, b, c, d = AOI
    return told(_measured(_clip(spark, sf, [[[a, c, b, d]]])[1]).select("label", "area_m2"), 4)


# A point of the lattice is a corner where one or three of its four pixels belong to the component, and two where two
# pixels do that meet there alone.
@query(sql("""select label, n_corners, round(area_m2, 6) area_m2, round(perimeter_m, 6) perimeter_m from met join (
  select label, sum(case when n in (1, 3) then 1 when n = 2 and abs(d) = 2 then 2 else 0 end)::bigint n_corners from (
    select label, count(*) n, sum(case when i = j then 1 else -1 end) d
    from big, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) group by label, r + i, c + j) group by 1) using (label)"""))
def feature_outlines(spark, sf):
    """Outlines as rings of corners: how many, and the area and length that the rings enclose."""
    traps = scratch.kept(overlay.pieces(overlay.runs(Scene(spark, sf).labels())), "traps")
    linked = scratch.kept(overlay.rings(scratch.kept(overlay.boundary(traps), "boundary")), "rings")
    corners = F.aggregate(F.flatten(F.transform("shape", lambda p: p["rings"])), F.lit(0).cast("long"), lambda n, r: n + F.size(r["points"]))
    return told(overlay.shapes(linked).select("label", corners.alias("n_corners")).join(overlay.measures(linked, PIXEL_M), "label").select("label", "n_corners", "area_m2", "perimeter_m"))


#: A grid in the neighbouring zone, of pixels twice as large, that begins above and left of the frame.
_EAST, _NORTH = projection.between(pixels.ORIGIN_X, pixels.ORIGIN_Y, pixels.CRS, "EPSG:32736")
NEXT_ZONE = {"width": 60, "a": 20.0, "c": round(_EAST / 20) * 20 - 100.0, "e": -20.0, "f": round(_NORTH / 20) * 20 + 100.0, "crs": "EPSG:32736"}


@query(sql(f"""
, spot as (select i // 60 r, i % 60 c, {NEXT_ZONE["c"]}e0 + (i % 60 + 0.5e0) * 20 x, {NEXT_ZONE["f"]}e0 - (i // 60 + 0.5e0) * 20 y from range((select (h // 2 + 10) * 60 from dims)) t(i)),
{projection_sql("spot", "x", "y", "EPSG:32736", "EPSG:32735")},
uv as (select r, c, (x - {pixels.ORIGIN_X}e0) / 10 - 0.5e0 u, ({pixels.ORIGIN_Y}e0 - y) / 10 - 0.5e0 v from spot_moved),
four as (select r, c, cast(floor(v) as int) + i rr, cast(floor(u) as int) + j cc, abs(1 - i - (v - floor(v))) * abs(1 - j - (u - floor(u))) w
  from uv, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j), dims where u between -0.5e0 and 99.5e0 and v between -0.5e0 and h - 0.5e0)
select cast(four.r as int) as row, cast(four.c as int) as col, round(sum(w * v) / sum(w), 4) v from four join dn on dn.r = rr and dn.c = cc where w > 0 group by 1, 2"""))
def resample_zone(spark, sf):
    """The later date on a grid of 20 m in the next zone."""
    f = pixels.frame(spark, sf)
    h = pixels.height(f)
    have = Grid(pixels.WIDTH, h, PIXEL_M, pixels.ORIGIN_X, -PIXEL_M, pixels.ORIGIN_Y, pixels.CRS)
    want = Grid(height=h // 2 + 10, **NEXT_ZONE)
    return told(raster.regrid(f.where(pixels.valid("after")).withColumnRenamed("after_b04", "v"), ["v"], have, want), 4)


@query(sql(f"""
, spot as (select cell_row, cell_col, {pixels.ORIGIN_X}e0 + cell_col * 60 x, {pixels.ORIGIN_Y}e0 - cell_row * 60 y from grid),
{projection_sql("spot", "x", "y", "EPSG:32735", "EPSG:4326")}
select cell_row, cell_col, round(x, 9) lon, round(y, 9) lat from spot_moved"""))
def cells_degrees(spark, sf):
    """The upper left corner of each cell in degrees, by way of its GeoJSON coordinates."""
    size = PIXEL_M * CELL_PX
    x0, y1 = F.lit(pixels.ORIGIN_X) + F.col("cell_col") * size, F.lit(pixels.ORIGIN_Y) - F.col("cell_row") * size
    boxes = Scene(spark, sf).grid().withColumn("at", projection.in_degrees(overlay.box(x0, y1 - size, x0 + size, y1), pixels.CRS))
    corner = F.col("at")[0][0][3]
    return told(boxes.select("cell_row", "cell_col", corner[0].alias("lon"), corner[1].alias("lat")), 9)


@query(sql("""select (r // 64 * 2 + c // 64)::int tile, count(*) n, sum(b04 + n4 + blk)::bigint b04, sum(b03 + n3 + blk)::bigint b03,
max(c - c // 64 * 64)::int last_col from px0 where r > 0 and c > 0 group by 1"""))
def tile_codec(spark, sf):
    """The later date as deflated and differenced tiles of two bands, encoded in tasks and decoded again: sums by tile."""
    f = pixels.frame(spark, sf)
    grid = Grid(pixels.WIDTH, pixels.height(f), PIXEL_M, pixels.ORIGIN_X, -PIXEL_M, pixels.ORIGIN_Y, pixels.CRS, 0.0)
    layout = tiff.Layout(grid, "<", "u2", 2, False, tiff.DEFLATE, 2, True, (64, 64), (), ())

    def read(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for tile, data in zip(pdf["tile"], pdf["data"], strict=True):
                x = tiff.unpacked(layout, tile, data)[3].astype(np.int64)
                yield pd.DataFrame({"tile": [tile], "n": [int((x[:, :, 0] > 0).sum())], "b04": [x[:, :, 0].sum()], "b03": [x[:, :, 1].sum()], "last_col": [int(np.nonzero(x[:, :, 0])[1].max(initial=-1))]})

    held = tiff.tiles(f.where(pixels.valid("after")), ["after_b04", "after_b03"], grid, "u2", 2, 64)
    return held.mapInPandas(read, "tile int, n long, b04 long, b03 long, last_col int").where("n > 0")


# The catalog's SQL surface, over this engine's own tables.
VIEWS = ("change_features", "spatial_grid", "run_metadata", "quality_checks")
# A run for each priority of orders: when its last order came, how its status is checked. The first run is put twice, older
# and with other checks at first, so what is read is what a later put left.
_RUN_ROWS = """select lower(replace(o_orderpriority, ' ', '_')) run_id, cast(max(o_orderdate) as varchar) run_timestamp,
case when count(*) % 2 = 0 then 'otsu' else 'manual' end threshold_method from orders where o_orderpriority is not null group by 1"""
_CHECK_ROWS = """select lower(replace(o_orderpriority, ' ', '_')) run_id, 'status_' || lower(o_orderstatus) check_name,
case o_orderstatus when 'F' then 'error' when 'P' then 'warning' else 'info' end severity, count(*) n from orders
where o_orderpriority is not null and o_orderstatus is not null group by 1, 2, 3"""
_STORED = f"run_metadata as ({_RUN_ROWS}), quality_checks as ({_CHECK_ROWS})"


def _runs(spark, sf) -> store.RunStore:
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority is not null")
    o = o.withColumn("run_id", F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("_"))))
    when = F.max("o_orderdate").cast("string")  # with its fraction of a second, lest runs share a time that don't
    meta = scratch.kept(o.groupBy("run_id").agg(when.alias("run_timestamp"), F.when(F.count("*") % 2 == 0, "otsu").otherwise("manual").alias("threshold_method")), "meta")
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "warning").otherwise("info")
    checks = o.where("o_orderstatus is not null").groupBy("run_id", F.concat(F.lit("status_"), F.lower("o_orderstatus")).alias("check_name"), severity.alias("severity")).agg(F.count("*").alias("n"))
    checks = scratch.kept(checks, "checks")
    held = store.RunStore(spark, scratch.fresh(spark, "runs"))
    ids = sorted(r[0] for r in meta.select("run_id").collect())  # as many as there are priorities
    for run in [*ids[:1], *ids]:
        held.put(run, {"run_metadata": meta.where(F.col("run_id") == run), "quality_checks": checks.where(F.col("run_id") == run)})
    return held


_TABLES = f""", change_features as (select id, round(area_m2, 6) area_m2, round(mean_change, 6) mean_change, round(confidence, 6) confidence, round(gi_zscore, 6) gi_zscore, hotspot_class, case when compactness > 0.5 then round(compactness, 6) end ml_anomaly_score, case when id % 3 = 0 then null when gi_zscore > 0 then 'High-High' else 'Low-Low' end lisa_cluster from feature),
spatial_grid as (select round(mean_cva, 6) mean_cva, round(changed_proportion, 6) changed_proportion, cls hotspot_class from grid join hot on id = cell_row * {K} + cell_col),
{_STORED}
"""


def _latest_puts(runs: DataFrame) -> DataFrame:
    """Of runs that share a time the one that was put last, which is that of the greatest id: what is latest by time is one
    run then, on any layout."""
    return runs.groupBy("run_timestamp").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "run_timestamp"]), "run_id").alias("_r")).select("run_timestamp", "_r.*")


def _views(spark, sf, text):
    """Registers the tables that a text names."""
    s = Scene(spark, sf)
    if "change_features" in text:
        f = told(s.features())
        score = F.when(F.col("compactness") > 0.5, F.col("compactness"))
        lisa = F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("gi_zscore") > 0, F.lit("High-High")).otherwise(F.lit("Low-Low"))
        f = f.select("id", "area_m2", "mean_change", "confidence", "gi_zscore", "hotspot_class", score.alias("ml_anomaly_score"), lisa.alias("lisa_cluster"))
        scratch.kept(f, "view").createOrReplaceTempView("change_features")
    if "spatial_grid" in text:
        told(s.hotspots().select("mean_cva", "changed_proportion", "hotspot_class")).createOrReplaceTempView("spatial_grid")
    if "run_metadata" in text:
        _latest_puts(_runs(spark, sf).read("run_metadata")).createOrReplaceTempView("run_metadata")
    if "quality_checks" in text:
        _runs(spark, sf).read("quality_checks").createOrReplaceTempView("quality_checks")


# Texts that users of the catalog run as they are. Fixed values.
N = {
    "sql_n01": "select count(*) n, round(cast(coalesce(sum(area_m2), 0) as double), 6) total_area_m2 from change_features",
    "sql_n02": "select id, area_m2, mean_change, confidence from change_features order by area_m2 desc, id limit 10",
    "sql_n03": "select id, gi_zscore, hotspot_class from change_features where hotspot_class in ('hot_95', 'hot_99') order by gi_zscore desc",
    "sql_n04": "select id, ml_anomaly_score, area_m2 from change_features where ml_anomaly_score is not null order by ml_anomaly_score desc, id limit 10",
    "sql_n05": "select lisa_cluster, count(*) n, round(sum(area_m2), 6) total_area_m2 from change_features group by lisa_cluster",
    "sql_n06": "select id, confidence, area_m2 from change_features where confidence >= 0.6 order by confidence desc",
    "sql_n07": "select run_id, run_timestamp, threshold_method from run_metadata order by run_timestamp desc limit 1",
    "sql_n08": "select check_name, severity from quality_checks order by severity desc",
    "sql_n09": "select hotspot_class, count(*) n, round(avg(mean_cva), 6) mean_cva, round(avg(changed_proportion), 6) changed_proportion from spatial_grid group by hotspot_class",
    "sql_n12": "select id, area_m2 from change_features order by area_m2 desc, id limit 10",
    "sql_n13": "select count(*) n from change_features where hotspot_class in ('hot_95', 'hot_99')",
    "sql_n14": "select id, ml_anomaly_score from change_features where ml_anomaly_score is not null order by ml_anomaly_score desc, id limit 10",
}
N["sql_n11"] = N["sql_n01"]


def _named(text):
    def run(spark, sf):
        _views(spark, sf, text)
        return spark.sql(text)

    return run


for _k, _text in sorted(N.items()):
    QUERIES[_k] = _named(_text)
    SQL[_k] = sql(_TABLES + _text)


@query(sql("select cast(min(c) as int) col_min, cast(max(c) as int) col_max, cast(min(r) as int) row_min, cast(max(r) as int) row_max from big"))
def sql_n10(spark, sf):
    """The features' extent."""
    return Scene(spark, sf).labels().agg(F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.min("row").alias("row_min"), F.max("row").alias("row_max"))


@query(sql("select round(100e0 * (select count(*) from oc) / count(*), 6) changed_area_percent, (select count(*) from oc) * 100e0 changed_area_m2, round(count(*) * 100e0 / 1e6, 6) valid_km2, round(100e0 * (1 - count(*) / (select count(*) from px0)::double), 6) nodata_percent from px"))
def run_totals(spark, sf):
    s = Scene(spark, sf)
    n, k, every = s.px.count(), s.cleaned().count(), pixels.frame(spark, sf).count()
    return told(spark.createDataFrame([(100.0 * k / n, k * 100.0, n * 100.0 / 1e6, 100.0 * (1 - n / every))], "changed_area_percent double, changed_area_m2 double, valid_km2 double, nodata_percent double"))


# Without SQL: draws and forests. Tests hold their invariants.
@query()
def moran_perm(spark, sf):
    g = Scene(spark, sf).grid()
    r = cells.moran_permutations(g, cells.weights(g), "mean_cva")
    return spark.createDataFrame([tuple(r.values())], "i double, p_sim double, z_sim double")


@query()
def lisa_perm(spark, sf):
    g = Scene(spark, sf).grid()
    w = cells.weights(g)
    p = cells.local_permutations(g, w, "mean_cva", "moran")
    return cells.local_moran(g, w, "mean_cva").join(p, "id", "left").withColumn("lisa_cluster", cells.lisa_cluster(F.col("quadrant"), F.coalesce("p_sim", F.lit(1.0))))


@query()
def gi_perm(spark, sf):
    g = Scene(spark, sf).grid()
    return cells.local_permutations(g, cells.contiguity(g).withColumn("w", F.lit(1.0)), "mean_cva", "gi")


@query()
def isolation_forest(spark, sf):
    g = Scene(spark, sf).grid().withColumn("id", cells.cell_id())
    return ml.ranked(ml.isolation_forest(g, "id", list(ml.FEATURES)), "ml_anomaly_score").select("id", "ml_anomaly_score", "ml_anomaly_rank", "ml_anomaly_quantile")


@query()
def if_stability(spark, sf):
    g = scratch.kept(Scene(spark, sf).grid().withColumn("id", cells.cell_id()), "cells")
    r = ml.forest_stability(g, "id", list(ml.FEATURES))
    return spark.createDataFrame([tuple(r.values())], "replicates int, overlap_mean double, overlap_std double")


@query()
def contamination_sensitivity(spark, sf):
    g = scratch.kept(Scene(spark, sf).grid().withColumn("id", cells.cell_id()), "cells")
    rows = ml.contamination_sensitivity(g, "id", list(ml.FEATURES))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "factor double, contamination double, n_flagged long, top_k_overlap double")


@query()
def dbscan_sensitivity(spark, sf):
    g = Scene(spark, sf).grid().withColumn("id", cells.cell_id()).where("changed_proportion > 0")
    p = scratch.kept(ml.robust_scale(g, list(ml.FEATURES)).select("id", *ml.FEATURES), "points")
    r = ml.dbscan_sensitivity(p, "id", list(ml.FEATURES), 1.5, 5)
    return spark.createDataFrame([tuple(x.values()) for x in r], "eps double, noise_fraction double, n_clusters long")

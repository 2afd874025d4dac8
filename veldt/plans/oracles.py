"""DuckDB SQL that the named queries are held against: one chain of common table expressions, and a last select."""

from __future__ import annotations

QUEEN = "(values (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1))"
ROOK = "(values (-1,0),(1,0),(0,-1),(0,1))"
SQUARE = "(values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1))"
K = 2147483648


def erode(src: str, h: str = "(select h from dims)") -> str:
    return f"select f.r, f.c from {src} f, {SQUARE} o(a, b) left join {src} g on g.r = f.r + a and g.c = f.c + b where f.r + a between 0 and {h} - 1 and f.c + b between 0 and 99 group by 1, 2 having count(*) = count(g.r)"


def dilate(src: str, h: str = "(select h from dims)") -> str:
    return f"select distinct f.r + a r, f.c + b c from {src} f, {SQUARE} o(a, b) where f.r + a between 0 and {h} - 1 and f.c + b between 0 and 99"


CHAIN = f"""with recursive px0 as (
  select o_orderkey pid, cast(floor(o_orderkey / 100.0) as int) r, cast(o_orderkey % 100 as int) c,
    cast(1400 + cast(floor(o_totalprice) as bigint) % 500 as double) b04, cast(1200 + (o_custkey * 31) % 500 as double) b03, cast(1000 + (o_orderkey * 7919) % 500 as double) b02,
    cast((o_custkey * 7919) % 41 - 20 as double) n4, cast((o_custkey * 104729) % 31 - 15 as double) n3, cast((o_orderkey * 1299709) % 21 - 10 as double) n2,
    case when cast(floor(o_orderkey / 100.0) as int) % 30 between 5 and 14 and o_orderkey % 100 between 5 and 14 then 800e0 when (o_orderkey * 48271) % 199 = 0 then 800e0 else 0e0 end blk
  from orders),
px as (select pid, r, c, b04 / 10000e0 p4, b03 / 10000e0 p3, b02 / 10000e0 p2, (b04 + n4 + blk) / 10000e0 a4, (b03 + n3 + blk) / 10000e0 a3, (b02 + n2 + blk) / 10000e0 a2 from px0 where r > 0 and c > 0),
dims as (select max(r) + 1 h from px0),
med as (select median(a4 - p4) m4, median(a3 - p3) m3, median(a2 - p2) m2 from px),
mad as (select 1.4826e0 * median(abs(a4 - p4 - m4)) s4, 1.4826e0 * median(abs(a3 - p3 - m3)) s3, 1.4826e0 * median(abs(a2 - p2 - m2)) s2, stddev_pop(a4 - p4) d4, stddev_pop(a3 - p3) d3, stddev_pop(a2 - p2) d2 from px, med),
scl as (select case when s4 < 1e-6 then case when d4 > 1e-6 then d4 else 1e0 end else s4 end s4, case when s3 < 1e-6 then case when d3 > 1e-6 then d3 else 1e0 end else s3 end s3, case when s2 < 1e-6 then case when d2 > 1e-6 then d2 else 1e0 end else s2 end s2 from mad),
z as (select px.*, (a4 - p4 - m4) / s4 z4, (a3 - p3 - m3) / s3 z3, (a2 - p2 - m2) / s2 z2 from px, med, scl),
cva as (select *, sqrt(z4 * z4 + z3 * z3 + z2 * z2) v, (a4 - p4 + a3 - p3 + a2 - p2) / 3e0 bright from z),
mm as (select min(v) lo, max(v) hi from cva),
hist as (select least(cast(floor((v - lo) / (hi - lo) * 256) as int), 255) bin, count(*) n, any_value(lo) lo, any_value(hi) hi from cva, mm group by 1),
cum as (select *, lo + (bin + 0.5e0) * (hi - lo) / 256 ctr from hist),
cum2 as (select *, sum(n) over (order by bin) w1, sum(n * ctr) over (order by bin) s1, sum(n) over () w, sum(n * ctr) over () s from cum),
thr as (select ctr t from cum2 where w > w1 order by cast(w1 as double) * cast(w - w1 as double) * (s1 / w1 - (s - s1) / (w - w1)) * (s1 / w1 - (s - s1) / (w - w1)) desc, ctr limit 1),
fg as (select r, c from cva, thr where v > t),
er as ({erode("fg")}),
op as ({dilate("er")}),
di as ({dilate("fg")}),
cl as ({erode("di")}),
opd as ({dilate("op")}),
oc as ({erode("opd")}),
reach as (select r, c, r r2, c c2 from oc union select reach.r, reach.c, oc.r, oc.c from reach, {QUEEN} o(a, b) join oc on oc.r = reach.r2 + a and oc.c = reach.c2 + b),
lab as (select r, c, min(cast(r2 as bigint) * {K} + c2) label from reach group by 1, 2),
keep as (select label, count(*) n from lab group by 1 having count(*) >= 4),
big as (select lab.* from lab join keep using (label)),
per as (select f.label, sum(case when g.label = f.label then 0 else 1 end) * 10e0 perimeter_m from big f, {ROOK} o(a, b) left join big g on g.r = f.r + a and g.c = f.c + b group by 1),
feat as (select label, count(*) * 100e0 area_m2, avg(v) mean_change, max(v) max_change, quantile_cont(v, 0.95) p95_change from big left join cva using (r, c) group by 1),
met as (select feat.*, perimeter_m, case when perimeter_m > 0 then least(4 * pi() * area_m2 / (perimeter_m * perimeter_m), 1e0) else 0e0 end compactness from feat join per using (label)),
grid as (
  select cast(floor(r / 6e0) as bigint) cell_row, cast(floor(c / 6e0) as bigint) cell_col, count(*) valid_pixel_count, avg(v) mean_cva, median(v) median_cva, quantile_cont(v, 0.9) p90_cva, quantile_cont(v, 0.95) p95_cva,
    avg(case when v > t then 1e0 else 0e0 end) changed_proportion, avg(a4 - p4) mean_diff_b04, avg(a3 - p3) mean_diff_b03, avg(a2 - p2) mean_diff_b02, coalesce(stddev_samp(v), 0e0) local_std_cva, count(*) total_pixel_count
  from cva, thr group by 1, 2),
cell as (select cell_row * {K} + cell_col id, cell_row cr, cell_col cc, mean_cva y from grid),
queen as (select a.id src, b.id dst from cell a, {QUEEN} o(i, j) join cell b on b.cr = a.cr + i and b.cc = a.cc + j),
rook as (select a.id src, b.id dst from cell a, {ROOK} o(i, j) join cell b on b.cr = a.cr + i and b.cc = a.cc + j),
wr as (select src, dst, 1e0 / count(*) over (partition by src) w from queen),
g0 as (select count(*) n, avg(y) mean, sum(y) total, stddev_pop(y) sd from cell),
zc as (select id, y - mean z from cell, g0),
den as (select sum(z * z) d from zc),
lag as (select src id, sum(w * z) lag from wr join zc on dst = id group by 1),
gi0 as (select src id, sum(y) wy, count(*) w from (select src, dst from queen union all select id, id from cell) join cell on dst = id group by 1),
gi as (select id, wy / total g, (wy - mean * w) / (sd * sqrt((n * w - w * w) / (n - 1e0))) z from gi0, g0),
pv as (select *, abs(z) / sqrt(2e0) x, 1 / (1 + 0.5e0 * abs(z) / sqrt(2e0)) u from gi),
pp as (select id, g, z, u * exp(-x * x - 1.26551223e0 + u * (1.00002368e0 + u * (0.37409196e0 + u * (0.09678418e0 + u * (-0.18628806e0 + u * (0.27886807e0 + u * (-1.13520398e0 + u * (1.48851587e0 + u * (-0.82215223e0 + u * 0.17087277e0))))))))) p from pv),
rk as (select *, row_number() over (order by p, id) k, count(*) over () m from pp),
fdr as (select *, least(1e0, min(p * m / k) over (order by k desc rows between unbounded preceding and current row)) q from rk),
hot as (select *, case when q < 0.1 then (case when z > 0 then 'hot' else 'cold' end) || (case when q < 0.01 then '_99' when q < 0.05 then '_95' else '_90' end) else 'not_significant' end cls from fdr),
ov as (select label, cast(floor(r / 6e0) as bigint) * {K} + cast(floor(c / 6e0) as bigint) id, count(*) * 100e0 w from big group by 1, 2),
att as (select label, sum(w * z) / sum(w) gi_zscore, sum(w * q) / sum(w) gi_qvalue, arg_max(cls, row(w, -id)) hotspot_class from ov join hot using (id) group by 1),
conf0 as (select met.*, gi_zscore, hotspot_class, max(mean_change) over () mm, max(area_m2) over () ma from met left join att using (label)),
conf1 as (
  select conf0.*, least(greatest((mean_change - t) / (mm - t + 1e-9), 0e0), 1e0) c1, least(greatest(1 - (max_change - mean_change) / (max_change + 1e-9), 0e0), 1e0) c2, least(greatest(ln(1 + area_m2) / ln(1 + ma + 1e-9), 0e0), 1e0) c3,
    case hotspot_class when 'hot_99' then 1e0 when 'hot_95' then 0.85e0 when 'hot_90' then 0.6e0 when 'cold_99' then 0e0 when 'cold_95' then 0e0 when 'cold_90' then 0e0 else 0.3e0 end c4
  from conf0, thr),
conf as (select *, least(greatest((0.3e0 * c1 + 0.2e0 * c2 + 0.2e0 * c3 + 0.2e0 * c4) / 0.9e0, 0e0), 1e0) confidence from conf1),
feature as (select cast(row_number() over (order by label) as int) id, label, area_m2, perimeter_m, compactness, mean_change, max_change, p95_change, confidence, gi_zscore, hotspot_class from conf),
dn as (select pid, r, c, (b04 + n4 + blk) v from px0 where r > 0 and c > 0)
"""


def sql(last: str) -> str:
    return CHAIN + last


def projection_sql(table: str, x: str, y: str, source: str, target: str) -> str:
    """Common table expressions that end in ``table``_moved, with x and y of one reference system in another."""
    from veldt.functions import projection as p

    a, b = p.code_of(source), p.code_of(target)
    n, steps, last = p._N, [], table
    if a != p.DEGREES:
        steps += [
            f"{table}_a as (select * exclude ({x}, {y}), ({y} - {p.NORTH if a > 32700 else 0.0!r}) / {p._RADIUS!r} xi, ({x} - {p.EAST!r}) / {p._RADIUS!r} eta from {last})",
            f"{table}_b as (select * exclude (xi, eta), xi " + "".join(f"- {c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta) " for j, c in enumerate(p._BETA, 1)) + "up, eta " + "".join(f"- {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta) " for j, c in enumerate(p._BETA, 1)) + f"across from {table}_a)",
            f"{table}_c as (select *, asin(sin(up) / cosh(across)) chi from {table}_b)",
            f"{table}_d as (select * exclude (up, across, chi), degrees(atan2(sinh(across), cos(up))) + {(a % 100) * 6 - 183} {x}, degrees(chi " + "".join(f"+ {c!r} * sin({2 * j} * chi) " for j, c in enumerate(p._DELTA, 1)) + f") {y} from {table}_c)",
        ]
        last = f"{table}_d"
    if b != p.DEGREES:
        k = 2 * n**0.5 / (1 + n)
        steps += [
            f"{table}_e as (select *, radians({x} - {(b % 100) * 6 - 183}) lam, sinh(atanh(sin(radians({y}))) - {k!r} * atanh({k!r} * sin(radians({y})))) t from {last})",
            f"{table}_f as (select * exclude ({x}, {y}, lam, t), atan2(t, cos(lam)) xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) eta from {table}_e)",
            f"{table}_g as (select * exclude (xi, eta), {p.EAST!r} + {p._RADIUS!r} * (eta " + "".join(f"+ {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta) " for j, c in enumerate(p._ALPHA, 1)) + f") {x}, {p.NORTH if b > 32700 else 0.0!r} + {p._RADIUS!r} * (xi " + "".join(f"+ {c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta) " for j, c in enumerate(p._ALPHA, 1)) + f") {y} from {table}_f)",
        ]
        last = f"{table}_g"
    return ", ".join([*steps, f"{table}_moved as (select * from {last})"])

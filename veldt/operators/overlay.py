"""Overlay of polygons and pixel components: unions, repairs, clips and outlines, all as joins and windows.

Everything is cut into slabs: strips of a pixel row in which no two sides of a polygon cross or end. Inside a slab sides
stand in a fixed order of columns, so counting windings along it tells which intervals are inside: of a ring (a winding
that isn't zero, which also repairs rings that cross themselves), of a polygon (inside its outer ring and no hole), of
the union (inside any polygon). Components are runs of pixels; a run meets the intervals of its row in an equi-join on
(row, lane of columns), and what is left of it are trapezoids. The boundary of any set of trapezoids is their left and
right sides, and along each line between slabs the difference of what lies above and below. Areas and perimeters are sums
over that boundary; outlines are its sides linked into rings: each side finds the next one by an equi-join on their common
point, and rings are ranked by pointer jumping, so no component is the work of one task.

Coordinates are in pixels, rows growing downwards. Points closer than 1 / ``GRID`` of a pixel are one point. In a row, each
side is cut at every place where another one of that row ends or crosses: work there grows with the square of the sides.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import scratch

GRID = float(1 << 24)
#: Columns of a lane: sides and runs meet by row and lane.
LANE = 256
#: Rounds of pointer jumping: rings of up to 2 ** ROUNDS sides.
ROUNDS = 40


def _key(c: Column) -> Column:
    return F.round(c * GRID).cast("long")


def _lanes(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / LANE).cast("int"), F.floor(hi / LANE).cast("int"))


def _x(y: Column, prefix: str = "") -> Column:
    """Where a side is at y; exactly its ends there."""
    x1, y1, x2, y2 = (F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))
    return F.when(y == y2, x2).otherwise(x1 + (y - y1) * (x2 - x1) / (y2 - y1))


def runs(labels: DataFrame) -> DataFrame:
    """(label, row, c0, c1): pixels (label, row, col) as runs of columns, c1 being behind the last."""
    island = F.col("col") - F.row_number().over(Window.partitionBy("label", "row").orderBy("col"))
    told = labels.select("label", "row", "col").distinct().withColumn("_island", island)
    return told.groupBy("label", "row", "_island").agg(F.min("col").cast("double").alias("c0"), (F.max("col") + 1).cast("double").alias("c1")).drop("_island")


def _sides(edges: DataFrame) -> DataFrame:
    """(part, ring, turn, x1, y1, x2, y2): sides that aren't level, all downwards; turn tells which way they went."""
    down = F.col("y2") > F.col("y1")
    pick = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    ring = F.col("ring") if "ring" in edges.columns else F.lit(0)
    return edges.where("y1 <> y2").select("part", ring.alias("ring"), F.when(down, 1).otherwise(-1).alias("turn"), pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"))


def slabs(edges: DataFrame, rows: tuple[int, int]) -> DataFrame:
    """(row, y0, y1, l0, r0, l1, r1): the union of polygons in the given rows (first, last) as disjoint trapezoids, with
    their left and right ends at y0 and y1. ``edges`` has (part, x1, y1, x2, y2) and, if polygons have holes, ring, which
    is 0 for the outer ones; rings may cross themselves and each other, and run either way round."""
    sides = _sides(edges)
    first, last = F.greatest(F.floor("y1"), F.lit(rows[0])).cast("int"), F.least(F.ceil("y2") - 1, F.lit(rows[1])).cast("int")
    sides = sides.withColumn("side", F.monotonically_increasing_id()).where(first <= last)
    cut = sides.withColumn("row", F.explode(F.sequence(first, last)))
    cut = cut.withColumns({"s": F.greatest("y1", F.col("row").cast("double")), "t": F.least("y2", F.col("row") + 1.0)})
    cut = scratch.kept(cut.withColumns({"xs": _x(F.col("s")), "xt": _x(F.col("t"))}), "sides")
    near = cut.withColumn("lane", F.explode(_lanes(F.least("xs", "xt"), F.greatest("xs", "xt"))))
    own = ["side", "x1", "y1", "x2", "y2", "s", "t"]
    pair = near.select("row", "lane", *[F.col(c).alias(f"a_{c}") for c in own]).join(near.select("row", "lane", *[F.col(c).alias(f"b_{c}") for c in own]), ["row", "lane"]).where("a_side < b_side")
    pair = pair.withColumns({"s": F.greatest("a_s", "b_s"), "t": F.least("a_t", "b_t")}).where("s < t")
    d0, d1 = _x(F.col("s"), "a_") - _x(F.col("s"), "b_"), _x(F.col("t"), "a_") - _x(F.col("t"), "b_")
    met = F.round((F.col("s") + (F.col("t") - F.col("s")) * d0 / (d0 - d1)) * GRID) / GRID
    crossings = pair.where(d0 * d1 < 0).select("row", met.alias("y"))
    ends = cut.select("row", F.explode(F.array("s", "t", F.col("row").cast("double"), F.col("row") + 1.0)).alias("y"))
    events = ends.unionByName(crossings).groupBy("row").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    steps = F.transform(F.sequence(F.lit(0), F.size("ys") - 2), lambda i: F.struct(F.get("ys", i).alias("y0"), F.get("ys", i + 1).alias("y1")))
    strips = events.select("row", steps.alias("steps"))
    pieces = cut.join(strips, "row").withColumn("step", F.explode(F.filter("steps", lambda x: (x["y0"] >= F.col("s")) & (x["y1"] <= F.col("t")))))
    pieces = pieces.select("row", "part", "ring", "turn", F.col("step.y0").alias("y0"), F.col("step.y1").alias("y1"), _x(F.col("step.y0")).alias("x0"), _x(F.col("step.y1")).alias("x_1")).withColumnRenamed("x_1", "x1")

    return _united(pieces, ["row", "y0", "y1"])


def _united(pieces: DataFrame, slab: list[str]) -> DataFrame:
    """(*slab, l0, r0, l1, r1): the intervals inside the union along each slab, from (*slab, part, ring, turn, x0, x1)."""

    def flips(df: DataFrame, by: list[str], sums: dict[str, Column], inside) -> DataFrame:
        """Where ``inside`` of the running sums changes along a slab: +1 where it begins, -1 where it ends."""
        df = df.groupBy(*by, _key(F.col("x0")).alias("k0"), _key(F.col("x1")).alias("k1")).agg(F.min("x0").alias("x0"), F.min("x1").alias("x1"), *[F.sum(c).alias(f"d_{k}") for k, c in sums.items()])
        order = Window.partitionBy(*by).orderBy(F.col("k0") + F.col("k1"), "k0").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"c_{k}": F.sum(f"d_{k}").over(order) for k in sums})
        after, before = inside({k: F.col(f"c_{k}") for k in sums}), inside({k: F.col(f"c_{k}") - F.col(f"d_{k}") for k in sums})
        return df.withColumn("flip", after.cast("int") - before.cast("int")).where("flip <> 0").select(*by, "x0", "x1", "flip")

    rings = flips(pieces, [*slab, "part", "ring"], {"w": F.col("turn")}, lambda c: c["w"] != 0)
    outer = F.col("ring") == 0
    parts = flips(rings, [*slab, "part"], {"o": F.when(outer, F.col("flip")).otherwise(0), "h": F.when(outer, 0).otherwise(F.col("flip"))}, lambda c: (c["o"] > 0) & (c["h"] == 0))
    union = flips(parts, slab, {"n": F.col("flip")}, lambda c: c["n"] > 0)
    along = Window.partitionBy(*slab).orderBy(F.col("x0") + F.col("x1"), "x0")
    union = union.withColumns({"r0": F.lead("x0").over(along), "r1": F.lead("x1").over(along)}).where("flip = 1")
    return union.select(*slab, F.col("x0").alias("l0"), "r0", F.col("x1").alias("l1"), "r1")


def inside(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (row, col, ...) whose pixel's centre is inside the union of polygons."""
    at = pixels.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if at[0] is None:
        return pixels
    sides = _sides(edges)
    # A side crosses the lines through the centres of rows from its upper end to before its lower end.
    first, last = F.greatest(F.ceil(F.col("y1") - 0.5), F.lit(at[0])).cast("int"), F.least(F.ceil(F.col("y2") - 0.5) - 1, F.lit(at[1])).cast("int")
    met = sides.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x = _x(F.col("row") + 0.5)
    spans = _united(met.select("row", "part", "ring", "turn", x.alias("x0"), x.alias("x1")), ["row"])
    spans = spans.select("row", F.greatest(F.ceil(F.col("l0") - 0.5), F.lit(at[2])).cast("int").alias("_from"), F.least(F.ceil(F.col("r0") - 0.5) - 1, F.lit(at[3])).cast("int").alias("_to")).where("_from <= _to")
    spans = spans.withColumn("_lane", F.explode(_lanes(F.col("_from"), F.col("_to")))).withColumnRenamed("row", "_row")
    return pixels.join(spans, (F.col("row") == F.col("_row")) & (F.floor(F.col("col") / LANE) == F.col("_lane")) & F.col("col").between(F.col("_from"), F.col("_to")), "left_semi")


def pieces(found: DataFrame) -> DataFrame:
    """Runs (label, row, c0, c1) as trapezoids."""
    top = F.col("row").cast("double")
    return found.select("label", top.alias("y0"), (top + 1).alias("y1"), F.col("c0").alias("l0"), F.col("c1").alias("r0"), F.col("c0").alias("l1"), F.col("c1").alias("r1"))


def clip(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, y0, y1, l0, r0, l1, r1): what the union of polygons leaves of runs (label, row, c0, c1)."""
    at = found.agg(F.min("row"), F.max("row"), F.min("c0"), F.max("c1")).first()
    if at[0] is None:
        return pieces(found)
    kept = scratch.kept(slabs(edges, (at[0], at[1])), "slabs")
    west, east = F.least("l0", "l1"), F.greatest("r0", "r1")
    area = kept.where((east > at[2]) & (west < at[3])).withColumn("lane", F.explode(_lanes(F.greatest(west, F.lit(at[2])), F.least(east, F.lit(at[3])))))
    held = found.withColumn("lane", F.explode(_lanes(F.col("c0"), F.col("c1") - 1)))
    met = held.join(area, ["row", "lane"]).where((F.col("lane") == F.floor(F.greatest(F.col("c0"), west) / LANE)) & (east > F.col("c0")) & (west < F.col("c1")))

    def side(name: str, y: Column) -> Column:
        a, b = F.col(f"{name}0"), F.col(f"{name}1")
        return F.when(y == F.col("y1"), b).otherwise(a + (y - F.col("y0")) * (b - a) / (F.col("y1") - F.col("y0")))

    def crossing(name: str, c: str) -> Column:
        """Where a side of the area passes an end of the run."""
        a, b = F.col(f"{name}0") - F.col(c), F.col(f"{name}1") - F.col(c)
        return F.when(a * b < 0, F.col("y0") + (F.col("y1") - F.col("y0")) * a / (a - b))

    ys = F.array_sort(F.array_compact(F.array(F.col("y0"), F.col("y1"), *[crossing(n, c) for n in "lr" for c in ("c0", "c1")])))
    steps = F.transform(F.sequence(F.lit(0), F.size("ys") - 2), lambda i: F.struct(F.get("ys", i).alias("s"), F.get("ys", i + 1).alias("t")))
    cut = met.withColumn("ys", F.array_distinct(ys)).withColumn("step", F.explode(steps))
    s, t = F.col("step.s"), F.col("step.t")
    out = cut.select("label", s.alias("s"), t.alias("t"), *[F.greatest(side("l", y), F.col("c0")).alias(f"l{k}") for k, y in ((0, s), (1, t))], *[F.least(side("r", y), F.col("c1")).alias(f"r{k}") for k, y in ((0, s), (1, t))])
    return out.where("l0 + l1 < r0 + r1").select("label", F.col("s").alias("y0"), F.col("t").alias("y1"), "l0", "r0", "l1", "r1")


def boundary(traps: DataFrame) -> DataFrame:
    """(label, x1, y1, x2, y2): the sides of each label's trapezoids that bound it, with the inside on the right as one goes
    along them on the screen. ``traps`` is read several times: a kept table."""
    right = traps.select("label", F.col("r0").alias("x1"), F.col("y0").alias("y1"), F.col("r1").alias("x2"), F.col("y1").alias("y2"))
    left = traps.select("label", F.col("l1").alias("x1"), F.col("y1").alias("y1"), F.col("l0").alias("x2"), F.col("y0").alias("y2"))
    upright = _joined_up(left.unionByName(right))
    # Along each line, +1 where something lies above it alone, -1 where below it alone.
    at = lambda y, x, d: F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.lit(d).alias("d"))
    ends = traps.select("label", F.explode(F.array(at("y1", "l1", 1), at("y1", "r1", -1), at("y0", "l0", -1), at("y0", "r0", 1))).alias("e"))
    ends = ends.groupBy("label", F.col("e.y").alias("y"), _key(F.col("e.x")).alias("k")).agg(F.min("e.x").alias("x"), F.sum("e.d").alias("d"))
    along = Window.partitionBy("label", "y").orderBy("k")
    level = ends.withColumns({"n": F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)), "to": F.lead("x").over(along)}).where("n <> 0 and to is not null")
    up = F.col("n") > 0  # the bottom of what lies above: leftwards
    flat = level.select("label", F.when(up, F.col("to")).otherwise(F.col("x")).alias("x1"), F.col("y").alias("y1"), F.when(up, F.col("x")).otherwise(F.col("to")).alias("x2"), F.col("y").alias("y2"))
    return upright.unionByName(flat)


def _joined_up(sides: DataFrame) -> DataFrame:
    """Upright sides that follow each other on one column as one."""
    straight = sides.where("x1 = x2").select("label", F.col("x1").alias("x"), (F.col("y2") > F.col("y1")).alias("down"), F.least("y1", "y2").alias("lo"), F.greatest("y1", "y2").alias("hi"))
    order = Window.partitionBy("label", "x", "down").orderBy("lo")
    begins = (~F.lag("hi").over(order).eqNullSafe(F.col("lo"))).cast("int")
    straight = straight.withColumn("b", begins).withColumn("island", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    straight = straight.groupBy("label", "x", "down", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = lambda a, b: F.when(F.col("down"), F.col(a)).otherwise(F.col(b))
    return straight.select("label", F.col("x").alias("x1"), ends("lo", "hi").alias("y1"), F.col("x").alias("x2"), ends("hi", "lo").alias("y2")).unionByName(sides.where("x1 <> x2"))


def measures(sides: DataFrame, pixel_m: float = 1.0) -> DataFrame:
    """(label, area_m2, perimeter_m) from a boundary."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    length = F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return sides.groupBy("label").agg((twice * F.lit(pixel_m * pixel_m / 2)).alias("area_m2"), (length * F.lit(pixel_m)).alias("perimeter_m"))


def rings(sides: DataFrame) -> DataFrame:
    """(label, ring, pos, x1, y1, x2, y2, corner): a boundary's sides linked into rings, in order from 0; corner tells that a
    side doesn't run on straight from the one before. Where several rings touch in a point, each keeps to its right."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Sides are numbered after their order by place, so that rings begin alike on each run.
    named = scratch.kept(sides.withColumns({"dx": dx, "dy": dy}).repartitionByRange("label", "y1", "x1", "y2", "x2").sortWithinPartitions("label", "y1", "x1", "y2", "x2").withColumn("id", F.monotonically_increasing_id()), "named_sides")
    here = named.select("label", F.col("id").alias("from"), _key(F.col("x2")).alias("kx"), _key(F.col("y2")).alias("ky"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    there = named.select("label", F.col("id").alias("to"), _key(F.col("x1")).alias("kx"), _key(F.col("y1")).alias("ky"), "dx", "dy")
    met = here.join(there, ["label", "kx", "ky"])
    cross, dot = F.col("ax") * F.col("dy") - F.col("ay") * F.col("dx"), F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")
    turn = met.withColumn("turn", F.atan2(cross, dot)).groupBy("from").agg(F.max_by(F.struct("to", "turn"), F.struct("turn", "to")).alias("best"))
    follow = turn.select("from", F.col("best.to").alias("to"), (F.abs("best.turn") > 1e-9).alias("corner"))
    follow = scratch.kept(follow, "next_sides")
    # ahead: the side 2 ** round steps on; least: the least side until there, and how many steps away it first is.
    now = scratch.kept(follow.select(F.col("from").alias("id"), F.col("to").alias("ahead"), F.col("from").alias("least"), F.lit(0).cast("long").alias("steps")), "jumps")
    for k in range(ROUNDS):
        far = now.select(F.col("id").alias("ahead"), F.col("ahead").alias("ahead2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"))
        less = F.col("least2") < F.col("least")
        new = now.join(far, "ahead").select("id", F.col("ahead2").alias("ahead"), F.least("least", "least2").alias("least"), F.when(less, F.col("steps2") + (1 << k)).otherwise(F.col("steps")).alias("steps"), (F.col("least") != F.col("least2")).alias("moved"))
        new = scratch.kept(new, "jumps")
        # Windows that follow each other and agree cover the whole ring.
        if not new.where("moved").take(1):
            break
        now = new.drop("moved")
    else:
        raise RuntimeError("rings did not close")
    sizes = new.groupBy("least").agg(F.count("*").alias("n"))
    place = new.join(sizes, "least").select("id", F.col("least").alias("ring"), F.pmod(F.col("n") - F.col("steps"), F.col("n")).alias("pos"))
    bends = follow.select(F.col("to").alias("id"), "corner")
    return named.join(place, "id").join(bends, "id").select("label", "ring", "pos", "x1", "y1", "x2", "y2", "corner")


def polygons(linked: DataFrame) -> DataFrame:
    """(label, ring, outer): which outer ring each ring belongs to, itself if it is one. A hole belongs to the smallest outer
    ring that has an odd number of sides to the left of the hole's first upright side, in the strip that they share."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    signed = scratch.kept(linked.groupBy("label", "ring").agg(twice.alias("twice")), "signed_rings")
    holes = signed.where("twice < 0").select("label", "ring")
    outers = signed.where("twice > 0").select("label", F.col("ring").alias("outer"), "twice")
    own = outers.select("label", F.col("outer").alias("ring"), "outer")
    if not holes.take(1):
        return own
    upright = linked.where("y1 <> y2")
    probe = upright.join(holes, ["label", "ring"], "left_semi").groupBy("label", "ring").agg(F.min_by(F.struct(((F.col("y1") + F.col("y2")) / 2).alias("y"), ((F.col("x1") + F.col("x2")) / 2).alias("x")), F.struct("y1", "x1", "y2")).alias("p"))
    probe = probe.select("label", "ring", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.floor("p.y").cast("int").alias("row"))
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    walls = upright.select("label", F.col("ring").alias("outer"), "x1", "y1", "x2", "y2", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo).cast("int"), F.ceil(hi).cast("int") - 1)).alias("row"))
    met = probe.join(walls, ["label", "row"]).where((F.col("py") >= F.col("lo")) & (F.col("py") < F.col("hi")) & (_x(F.col("py")) < F.col("px")))
    odd = met.groupBy("label", "ring", "outer").agg(F.count("*").alias("n")).where("n % 2 = 1").join(outers, ["label", "outer"])
    parents = odd.groupBy("label", "ring").agg(F.min_by("outer", F.struct("twice", "outer")).alias("outer"))
    return own.unionByName(parents)


def as_wkb(df: DataFrame) -> DataFrame:
    """The column ``shape``, polygons of rings of points with the outer rings first, as a last column ``geometry``."""

    def ring(points) -> bytes:
        xy = [(p["x"], p["y"]) for p in points]
        return struct.pack("<I", len(xy) + 1) + b"".join(struct.pack("<dd", *p) for p in [*xy, xy[0]])

    def polygon(found) -> bytes:
        return struct.pack("<BII", 1, 3, len(found)) + b"".join(ring(r["points"]) for r in found)

    @F.pandas_udf("binary")
    def packed(shapes: pd.Series) -> pd.Series:
        out = []
        for shape in shapes:
            parts = [polygon(p["rings"]) for p in shape]
            out.append(parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts))
        return pd.Series(out)

    return df.withColumn("geometry", packed("shape")).drop("shape")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A shape of one box."""
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    return F.array(F.struct(F.array(F.struct(points.alias("points"))).alias("rings")))


def shapes(linked: DataFrame, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = 1.0) -> DataFrame:
    """(label, shape): polygons as arrays of rings of points, in map coordinates; a row is as large as its geometry."""
    point = F.struct(F.col("pos"), (F.lit(x0) + F.col("x1") * dx).alias("x"), (F.lit(y0) + F.col("y1") * dy).alias("y"))
    corners = linked.where("corner").groupBy("label", "ring").agg(F.sort_array(F.collect_list(point)).alias("points"))
    of = corners.join(polygons(linked), ["label", "ring"])
    one = of.groupBy("label", "outer").agg(F.sort_array(F.collect_list(F.struct((F.col("ring") != F.col("outer")).alias("hole"), "ring", "points"))).alias("rings"))
    return one.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("outer", "rings"))).alias("shape"))


def geometries(traps: DataFrame, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = 1.0) -> DataFrame:
    """(label, geometry): each label's outline as WKB."""
    linked = scratch.kept(rings(scratch.kept(boundary(traps), "boundary")), "rings")
    return as_wkb(shapes(linked, x0, dx, y0, dy))

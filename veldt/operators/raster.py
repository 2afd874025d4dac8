"""Neighbourhood and topology operators on sparse foreground pixels (row, col), all by equi-joins on offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt import scratch
from veldt.errors import AnalysisError
from veldt.functions import projection
from veldt.operators.graph import connected_components


def offsets(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row once for each step, with (r2, c2) moved by it. Never a range join."""
    moved = F.explode(F.array(*[F.struct((F.col("row") + a).cast("int").alias("r2"), (F.col("col") + b).cast("int").alias("c2")) for a, b in steps]))
    return df.withColumn("_to", moved).select("*", "_to.r2", "_to.c2").drop("_to")


def square(size: int) -> list[tuple[int, int]]:
    lo, hi = -(size // 2), (size - 1) // 2
    return [(a, b) for a in range(lo, hi + 1) for b in range(lo, hi + 1)]


def _inside(df: DataFrame, height: int, width: int) -> DataFrame:
    return df.where(F.col("r2").between(0, height - 1) & F.col("c2").between(0, width - 1))


def erode(fg: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    """Pixels whose whole neighbourhood, as far as it is in the frame, is foreground."""
    at = _inside(offsets(fg.select("row", "col"), square(size)), height, width)
    other = fg.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.lit(1).alias("hit"))
    told = at.join(other, ["r2", "c2"], "left").groupBy("row", "col").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    return told.where("n = k").select("row", "col")


def dilate(fg: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    at = _inside(offsets(fg.select("row", "col"), [(-a, -b) for a, b in square(size)]), height, width)
    return at.select(F.col("r2").alias("row"), F.col("c2").alias("col")).distinct()


def opening(fg: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    return dilate(erode(fg, height, width, size), height, width, size)


def closing(fg: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    return erode(dilate(fg, height, width, size), height, width, size)


def morphology(fg: DataFrame, height: int, width: int, operation: str = "opening_then_closing", size: int = 3) -> DataFrame:
    if operation == "none" or size < 1:
        return fg.select("row", "col")
    if operation not in ("opening", "closing", "opening_then_closing"):
        raise AnalysisError(f"unknown morphology {operation!r}")
    out = fg if operation == "closing" else opening(fg, height, width, size)
    return out if operation == "opening" else closing(out, height, width, size)


def components(fg: DataFrame, eight: bool = True) -> DataFrame:
    """(row, col, label): label is the component's least row * 2**31 + col.

    Pixels become runs of columns; runs of adjacent rows that touch are linked by an equi-join on (row, block of
    columns), and the runs' components found on that much smaller graph."""
    island = F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col"))
    pixels = fg.select("row", "col").distinct().withColumn("island", island)
    runs = pixels.groupBy("row", "island").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).withColumn("run", F.col("row").cast("long") * (1 << 31) + F.col("c0"))
    reach, block = (1 if eight else 0), 64
    lane = lambda lo, hi: F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block)))
    a = runs.select((F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("run").alias("a"), lane(F.col("c0") - reach, F.col("c1") + reach).alias("lane"))
    b = runs.select("row", F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("run").alias("b"), lane(F.col("c0"), F.col("c1")).alias("lane"))
    links = a.join(b, ["row", "lane"]).where((F.col("b0") <= F.col("a1") + reach) & (F.col("b1") >= F.col("a0") - reach)).select("a", "b").distinct()
    named = connected_components(links).withColumnRenamed("node", "run")
    labels = runs.join(named, "run", "left").select("row", "island", F.coalesce("component", "run").alias("label"))
    return pixels.join(labels, ["row", "island"]).select("row", "col", "label")


def min_pixels(min_area_m2: float, pixel_area: float) -> int:
    import math

    if pixel_area <= 0:
        raise AnalysisError("pixel area must be positive")
    return max(1, math.ceil(min_area_m2 / pixel_area))


def large(labels: DataFrame, least: int) -> DataFrame:
    """Components of at least so many pixels."""
    keep = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    return labels.join(keep, "label", "left_semi")


def fill_holes(fg: DataFrame, height: int, width: int) -> DataFrame:
    """Foreground with the 4-connected background that does not reach the frame's edge."""
    spark = fg.sparkSession
    every = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    back = components(every.join(fg.select("row", "col"), ["row", "col"], "left_anti"), eight=False)
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    open_labels = back.where(edge).select("label").distinct()
    holes = back.join(open_labels, "label", "left_anti").select("row", "col")
    return fg.select("row", "col").unionByName(holes)


def perimeter(labels: DataFrame, pixel_m: float) -> DataFrame:
    """(label, perimeter_m): sides of pixels that don't face their own component, holes included."""
    at = offsets(labels, [(0, 1), (1, 0), (0, -1), (-1, 0)])
    other = labels.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("label").alias("l2"))
    met = at.join(other, ["r2", "c2"], "left")
    return met.groupBy("label").agg((F.sum(F.when(F.col("l2") == F.col("label"), 0).otherwise(1)) * F.lit(pixel_m)).cast("double").alias("perimeter_m"))


def overview(df: DataFrame, value: str, factor: int, how: str = "average") -> DataFrame:
    """A level of the pyramid: means, or the first pixel of each block."""
    by = [F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")]
    return df.groupBy(*by).agg((F.avg(value) if how == "average" else F.min_by(value, F.struct("row", "col"))).alias(value))


def resample_bilinear(df: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """Values at centres moved by (dx, dy) pixels; weights are renormalised over the pixels that have data."""
    import math

    a, b = math.floor(dy), math.floor(dx)
    fy, fx = dy - a, dx - b
    steps = [(i, j, wy * wx) for i, wy in ((a, 1 - fy), (a + 1, fy)) for j, wx in ((b, 1 - fx), (b + 1, fx)) if wy * wx > 0]
    to = F.explode(F.array(*[F.struct((F.col("row") - i).cast("int").alias("row"), (F.col("col") - j).cast("int").alias("col"), F.lit(w).alias("w")) for i, j, w in steps]))
    spread = df.select(F.col(value).alias("v"), to.alias("t")).select("v", "t.*").where(F.col("v").isNotNull())
    return spread.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))


def regrid(df: DataFrame, values: list[str], source, target) -> DataFrame:
    """(row, col, *values) on the grid ``target``: each of its pixels' centres is looked up in the grid ``source`` of
    ``df``, in its reference system, and takes the bilinear mean of the four centres around it, weights being renormalised
    over those that have data. Centres outside of the source's frame, and those without data around, give no row. The mean
    is not widened where the target's pixels are larger."""
    n = F.col("id")
    frame = df.sparkSession.range(target.width * target.height).select(F.floor(n / target.width).cast("int").alias("row"), (n % target.width).cast("int").alias("col"))
    frame = frame.withColumns({"x": F.lit(target.c) + (F.col("col") + 0.5) * target.a, "y": F.lit(target.f) + (F.col("row") + 0.5) * target.e})
    if source.crs != target.crs:  # kept, as conditions on what follows would spell the series out again and again
        frame = scratch.kept(projection.moved(frame, target.crs, source.crs), "looked_up")
    frame = frame.withColumns({"u": (F.col("x") - source.c) / source.a, "v": (F.col("y") - source.f) / source.e})
    frame = frame.where(F.col("u").between(0, source.width) & F.col("v").between(0, source.height)).withColumns({"u": F.col("u") - 0.5, "v": F.col("v") - 0.5})
    i, j = F.floor("v").cast("int"), F.floor("u").cast("int")
    fy, fx = F.col("v") - i, F.col("u") - j
    four = F.explode(F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j"), (wy * wx).alias("w")) for a, wy in ((0, 1 - fy), (1, fy)) for b, wx in ((0, 1 - fx), (1, fx))]))
    at = frame.select("row", "col", four.alias("n")).select("row", "col", "n.*").where("w > 0")
    met = at.join(df.select(F.col("row").alias("i"), F.col("col").alias("j"), *values), ["i", "j"])
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c)
    return met.groupBy("row", "col").agg(*[mean(c) for c in values])

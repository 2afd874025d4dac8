"""Gapless positions within groups of any size, without a window over a whole group, and ranks of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import scratch

#: Rows that one window partition is meant to hold.
BUCKET_ROWS = 20_000
#: More rows than this that agree in all columns of an order are one row of their weight while the others are placed.
HEAVY = 1_000


def buckets(rows: int, per: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // per))


def _same(a: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in a:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def _before(df: DataFrame, by: list[str], piece: Column, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the sum of _w before each row in its group; rows are dealt to windows by ``piece``, whose totals, a
    small table, give each its offset. ``df`` is read twice."""
    dealt = df.withColumn("_piece", piece)
    totals = dealt.groupBy(*by, "_piece").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_piece").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(offsets, _same(by, "_by_") & (F.col("_piece") == F.col("_p")))
    return out.withColumn(name, (F.col("_off") + F.col("_in")).cast("long")).drop("_piece", "_p", "_off", "_in", *[f"_by_{c}" for c in by])


def positions(df: DataFrame, by: list[str], order: list[str], n_buckets: int, name: str = "pos", weight: Column | None = None) -> DataFrame:
    """Add ``name``: the gapless position from 0 of each row in its group ``by`` (or, with ``weight``, which must be the
    same for rows that agree in ``order``, the sum of the weights before it). Rows are dealt into ``n_buckets`` pieces of a
    group by a hash of ``order``, and ordered by ``order`` within a piece: the places do not depend on the layout of ``df``.

    Rows that agree in all of ``order`` share their places in any order. Where they are many, one row stands for them,
    and they are numbered behind it, dealt by their row numbers. ``df`` is read several times and must be the same each
    time, row order included: a kept table.
    """
    rows = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    piece, keys = F.pmod(F.xxhash64(*order), F.lit(n_buckets)), [*by, *order]
    heavy = scratch.kept(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_w").alias("_one")).where(F.col("_n") > HEAVY), "ties")
    if not heavy.take(1):
        return _before(rows, by, piece, order, name).drop("_w")
    told = heavy.select(*[F.col(c).alias(f"_h_{c}") for c in keys])
    light = rows.join(F.broadcast(told) if heavy.limit(100_001).count() <= 100_000 else told, _same(keys, "_h_"), "left_anti")
    stand = heavy.select(*keys, (F.col("_n") * F.col("_one")).alias("_w"))
    placed = scratch.kept(_before(light.withColumn("_light", F.lit(True)).unionByName(stand, allowMissingColumns=True), by, piece, order, name), "placed")
    first = placed.where("_light is null").select(*[F.col(c).alias(f"_h_{c}") for c in keys], F.col(name).alias("_first"))
    many = rows.withColumn("_id", F.monotonically_increasing_id()).join(first, _same(keys, "_h_")).drop(*[f"_h_{c}" for c in keys])
    many = _before(many.withColumn("_w1", F.col("_w")).withColumn("_w", F.lit(1).cast("long")), keys, F.pmod(F.xxhash64("_id"), F.lit(n_buckets)), ["_id"], "_nth")
    many = many.withColumn(name, F.col("_first") + F.col("_nth") * F.col("_w1"))
    return placed.where("_light").drop("_light", "_w").unionByName(many.drop("_id", "_first", "_nth", "_w", "_w1"))


def placed(df: DataFrame, order: list[Column], name: str = "place", start: int = 0) -> DataFrame:
    """Add ``name``: the gapless place of each row in one order over the whole table, without a window over all rows:
    range partitions are sorted and numbered each on its own, and the counts before them, a number for each partition,
    are added. Rows that agree in all of ``order`` share their places in any order."""
    put = scratch.kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    counts = sorted((r["p"], r["n"]) for r in put.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before, at = [], start
    for p, n in counts:
        before.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(before, "_p long, _off long")
    return put.join(F.broadcast(offsets), F.shiftright("_id", 33) == F.col("_p")).withColumn(name, F.col("_off") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_off", "_id")


def running(df: DataFrame, order: list[Column], value: str, how: str, name: str) -> DataFrame:
    """Add ``name``: the sum (``how`` = "sum") or the least (``how`` = "min") of ``value`` over all rows up to this one in
    an order over the whole table, without a window over all rows: each range partition is scanned on its own, and what
    comes before it, a number for each partition, is put on top. Rows should not agree in all of ``order``."""
    put = scratch.kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33)), "running")
    total, own = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least)}[how]
    totals = sorted((r["_p"], r["v"]) for r in put.groupBy("_p").agg(total(value).alias("v")).collect())
    before, at = [], None
    for p, v in totals:
        before.append((p, None if at is None else float(at)))
        at = v if at is None else at if v is None else at + v if how == "sum" else min(at, v)
    offsets = df.sparkSession.createDataFrame(before, "_q long, _before double")
    within = total(value).over(Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    out = put.withColumn("_own", within).join(F.broadcast(offsets), F.col("_p") == F.col("_q"))
    kind = dict(df.dtypes)[value]
    return out.withColumn(name, F.when(F.col("_before").isNull(), F.col("_own")).otherwise(own(F.col("_own"), F.col("_before"))).cast(kind)).drop("_p", "_q", "_id", "_own", "_before")


def ranks(values: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """(value, rank): the different values that aren't null, numbered from 0 in their order."""
    return placed(values.select(value).where(F.col(value).isNotNull()).distinct(), [F.col(value)], name)

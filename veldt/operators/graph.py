"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one min-aggregate and one join, so a hub with a third of all edges costs a partial aggregate and
a join that adaptive execution can split; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours of every node to the least of them: the greater ones (large), or the lesser ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Rows with a null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, path = scratch.kept_at(now, "edges")
    seen = None
    for _ in range(rounds):
        new, new_path = scratch.kept_at(_star(_star(now, True), False), "edges")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(spark, path)
        now, path = new, new_path
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

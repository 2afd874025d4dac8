"""Embedding near-duplicates by an exact metric range join over pivots (operator 10).

Vectors that share a label (and a length) are compared by cosine; cosine >= c is, on unit vectors, a distance of at
most sqrt(2 - 2c). Equal vectors are joined into one first, so a very common vector costs nothing. Labels with more
than ``cell_rows`` distinct vectors get pivots, drawn by hash; a vector belongs to the cell of its nearest pivot and
is copied to each other cell whose pivot the triangle inequality doesn't rule out, tightened to the distance from
the plane between two pivots. Each vector then meets all its neighbours in its own cell. Cells are joined each on
their own, in blocks of at most ``block_rows`` x ``block_rows`` vectors, whatever a cell's size. A block returns a
count for each vector and a star of links for each of its components, never a row for a pair.

In data without clusters (random directions in many dimensions) distances are nearly alike and the boundary copies
approach the number of cells: that is the method's limit, results stay exact.

Defined results: vectors that are null, empty, zero, or have null or non-finite components, and vectors without a
label, link with nothing; so do vectors of unlike length; repeated rows (equal vectors) link with each other; a null
vec_id never names a component unless it has no other; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt import scratch
from veldt.operators.graph import connected_components

COSINE = 0.98
#: Distinct vectors of a label from which on it gets pivots, about one for each so many; and the most pivots in all.
CELL_ROWS, MAX_PIVOTS = 2048, 4096
BLOCK_ROWS = 2048
#: Allowance for rounding in distances. Cosines themselves are compared without any.
SLACK = 1e-6
#: Vectors that are held against all pivots at a time.
CHUNK = 256


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack(values.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # else squares of very large or small numbers leave the range of doubles
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _deal(pivots: dict[tuple, np.ndarray], reach: float):
    """Rows to their own cell and to those across a near boundary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, rows in pdf.groupby(["label", "dim"]):
                p = pivots.get((int(key[0]), int(key[1])))
                if p is None:
                    yield rows.assign(cell=0, inner=True)
                    continue
                x = _unit(rows["embedding"])
                for k in range(0, len(x), CHUNK):
                    d2 = np.maximum(2 - 2 * x[k : k + CHUNK] @ p.T, 0)
                    own = d2.argmin(axis=1)
                    least = d2[np.arange(len(own)), own][:, None]
                    apart = np.sqrt(np.maximum(2 - 2 * p[own] @ p.T, 0))
                    near = (d2 - least <= 2 * reach * apart + SLACK) & (np.sqrt(d2) <= np.sqrt(least) + 2 * reach + SLACK)
                    near[np.arange(len(own)), own] = True
                    i, j = np.nonzero(near)
                    yield rows.iloc[k + i].assign(cell=j.astype(np.int32), inner=j == own[i])

    return run


def _join(cosine: float):
    """One block: its inner vectors against its candidates."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        here, there = pdf[pdf["side"]], pdf[~pdf["side"]]
        if here.empty or there.empty:
            return pd.DataFrame({"uid": [], "links": [], "root": []})
        a, b = _unit(here["embedding"]), _unit(there["embedding"])
        ida, idb, n = here["uid"].to_numpy(), there["uid"].to_numpy(), there["n"].to_numpy()
        hits = np.empty((len(ida), len(idb)), bool)
        for k in range(0, len(ida), 256):
            hits[k : k + 256] = (a[k : k + 256] @ b.T >= cosine) & (ida[k : k + 256, None] != idb)
        rows, cols = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
        if not len(rows):
            return pd.DataFrame({"uid": [], "links": [], "root": []})
        hits, ida, idb, n = hits[np.ix_(rows, cols)], ida[rows], idb[cols], n[cols]
        ra, rb = ida.copy(), idb.copy()  # the least uid reached so far
        top = np.iinfo(np.int64).max
        while True:
            na = np.minimum(ra, [rb[h].min(initial=top) for h in hits])
            nb = np.minimum(rb, [na[h].min(initial=top) for h in hits.T])
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        return pd.DataFrame({"uid": np.r_[ida, idb], "links": np.r_[hits @ n, np.zeros(len(idb), np.int64)], "root": np.r_[ra, rb]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("long").alias("label"))
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.withColumn("dim", F.size(e)).withColumn("usable", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))
    # Equal vectors are told by 128 bits of hash, and numbered.
    rows = scratch.kept(rows.withColumns({c: F.when(F.col("usable"), F.xxhash64(F.lit(c), "label", F.size(e), e)) for c in ("u1", "u2")}), "vectors")
    ids = rows.where("usable").groupBy("u1", "u2").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), *[F.first(c).alias(c) for c in ("embedding", "label", "dim")])
    ids = scratch.kept(ids.withColumn("uid", F.monotonically_increasing_id()), "distinct_vectors")

    sizes = ids.groupBy("label", "dim").agg(F.count("*").alias("m"))
    n = ids.count()
    least = max(cell_rows, n // MAX_PIVOTS)
    # At most n / least <= MAX_PIVOTS labels are this large, and their pivots are at most twice as many.
    large = sizes.where(F.col("m") > least).withColumn("k", F.ceil(F.col("m") / least).cast("int"))
    drawn = ids.join(F.broadcast(large), ["label", "dim"]).withColumn("rank", F.xxhash64("uid", F.lit(7)))
    # A sample a little larger than wanted is cut by rank: no window over a whole label.
    drawn = drawn.where(F.pmod("rank", "m") < 4 * F.col("k") + 16).withColumn("i", F.row_number().over(Window.partitionBy("label", "dim").orderBy("rank"))).where("i <= k")
    found: dict[tuple, list] = {}
    for r in drawn.select("label", "dim", "embedding").collect():
        found.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    pivots = {k: _unit(pd.Series([np.array(x) for x in v])) for k, v in found.items()}

    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    held = "uid long, n long, embedding array<double>, label long, dim int"
    cells = scratch.kept(ids.select("uid", "n", "embedding", "label", "dim").mapInPandas(_deal(pivots, reach), held + ", cell int, inner boolean"), "cells")
    by = ["label", "dim", "cell"]
    counts = cells.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = cells.join(counts, by).withColumn("own", F.pmod(F.xxhash64("uid", F.lit(11)), "blocks"))
    each = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    keep = [*by, "uid", "n", "embedding"]
    inner = dealt.where("inner").select(*keep, F.lit(True).alias("side"), F.col("own").alias("i"), F.explode(each).alias("j"))
    other = dealt.select(*keep, F.lit(False).alias("side"), F.explode(each).alias("i"), F.col("own").alias("j"))
    told = inner.unionByName(other).groupBy(*by, "i", "j").applyInPandas(_join(cosine), "uid long, links long, root long")
    told = scratch.kept(told, "cell_links")
    links = told.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = connected_components(told.where("uid <> root"), "uid", "root").withColumnRenamed("node", "uid")

    named = ids.select("u1", "u2", "uid", "n", "first").join(links, "uid", "left").join(groups, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("u1", "u2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "u1", "u2").join(named, ["u1", "u2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("u1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

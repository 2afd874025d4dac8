"""Approximate nearest neighbours by learned partitions (operator 12).

The index is fitted on a bounded sample of at most ``SAMPLE`` vectors, drawn by hash: its graph of nearest neighbours by
inner product is cut into parts of equal size (halves at the median of a slow vector of the random walk, mended by swaps
of equal numbers of nodes, again and again), and a small network learns which part a vector, and its neighbours, are in.
The network then puts every vector into its most probable part, and a query into its most probable ones, where it meets
all their vectors.

How many parts a query is sent to is measured, not guessed: up to ``PROBED`` queries, drawn by hash, are held against
*all* vectors, and the least number of parts that finds ``RECALL`` of their true neighbours is taken. Where vectors have
no structure (random directions in many dimensions) that is most of the parts: the method's limit.

Parts are joined in blocks of at most ``BLOCK_ROWS`` vectors and ``BLOCK_QUERIES`` queries, so neither a part with a
third of all vectors nor a crowd of queries is one task; a block returns its best ``k`` for each query. Products are first
taken by matrix, with an allowance, then for what is left summed in the order of components, so equal vectors get equal
scores in any block.

Defined results: vectors that are null, empty, zero, or have null or non-finite components are neither queries nor
candidates; vectors meet those of their own length only (lengths other than the most frequent one are parts of their own,
searched whole); repeated rows are candidates of each other, and a query answers for each of its rows; a null vec_id is a
candidate, last among ties, but no query; with fewer candidates than ``k`` all are returned; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt import scratch

K = 20
#: The index: vectors it is fitted on, vectors of the table for each part, most parts, neighbours in the graph.
SAMPLE, PART_ROWS, MAX_PARTS, NEIGHBOURS = 8192, 128, 64, 16
#: The network: units of its hidden layer, readings of the sample, vectors of a step, first length of a step.
HIDDEN, EPOCHS, STEP_ROWS, RATE = 96, 30, 256, 3e-3
#: Queries that are held against all vectors, and the share of neighbours to be found for them.
PROBED, RECALL = 256, 0.95
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Allowance for the order of summation in products by matrix, as a share of the largest.
SLACK = 1e-9


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the numbers of its k nearest others by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        ip = x[i : i + 1024] @ x.T
        ip[np.arange(len(ip)), i + np.arange(len(ip))] = -np.inf
        out[i : i + 1024] = np.argpartition(-ip, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(near: np.ndarray, n_parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each node of a graph, parts (a power of two) being of equal size but for one node."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    key = np.unique(np.r_[a * n + b, b * n + a])  # both ways, once
    a, b = key // n, key % n
    part = np.zeros(n, np.int64)
    wide = 1
    while wide < n_parts:
        halves = part * 2
        for p in range(wide):
            nodes = np.flatnonzero(part == p)
            at = np.full(n, -1)
            at[nodes] = np.arange(len(nodes))
            inside = (at[a] >= 0) & (at[b] >= 0)
            halves[nodes[_half(at[a[inside]], at[b[inside]], len(nodes), rng)]] += 1
        part, wide = halves, wide * 2
    return part


def _half(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Nodes of one half: a cut through the slowest direction of a lazy walk, then swaps that lessen the cut."""
    degree = np.bincount(a, minlength=n) + 1e-9
    v = rng.normal(size=n)
    for _ in range(100):
        v = (v + np.bincount(a, weights=v[b], minlength=n) / degree) / 2
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(30):
        gain = degree - 2 * np.bincount(a, weights=side[a] == side[b], minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not good:
            break
        move = max(1, good // 3)  # few at a time, as neighbours' gains change
        side[left[:move]], side[right[:move]] = True, False
    return np.flatnonzero(side)


class Router:
    """A network of one hidden layer from a vector's direction to the logarithms of its parts' odds."""

    def __init__(self, dim: int, n_parts: int, rng: np.random.Generator) -> None:
        self.n_parts = n_parts
        self.w = [rng.normal(size=(dim, HIDDEN)) * np.sqrt(2.0), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, n_parts)) / np.sqrt(HIDDEN), np.zeros(n_parts)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy of each vector's shares of parts."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), STEP_ROWS):
                rows = order[i : i + STEP_ROWS]
                z = x[rows] @ self.w[0] + self.w[1]
                h = np.maximum(z, 0)
                out = h @ self.w[2] + self.w[3]
                p = np.exp(out - out.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - share[rows]) / len(rows)
                back = d @ self.w[2].T * (z > 0)
                t += 1
                for j, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= RATE * (1 - epoch / EPOCHS) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)


def fitted(x: np.ndarray, n_parts: int, seed: int = 7) -> Router:
    """A router trained on the sample's own parts, half by each vector's part and half by its neighbours'."""
    rng = np.random.default_rng(seed)
    router = Router(x.shape[1], n_parts, rng)
    if n_parts > 1:
        near = neighbours(x, NEIGHBOURS)
        part = balanced_parts(near, n_parts, rng)
        share = np.zeros((len(x), n_parts))
        np.add.at(share, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
        share[np.arange(len(x)), part] += 0.5
        router.fit(x, share, rng)
    return router


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of their components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(q: np.ndarray, q_uid: np.ndarray, x: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best; ties to the smaller vec_id."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), 256):
        ip = q[i : i + 256] @ x.T
        ip[q_uid[i : i + 256, None] == uid] = -np.inf
        if len(x) > k:
            least = np.partition(ip, len(x) - k, axis=1)[:, len(x) - k]
        else:
            least = np.full(len(ip), -np.inf)
        slack = SLACK * (np.abs(q[i : i + 256]).sum(axis=1) * np.abs(x).max(initial=0.0) + 1e-300)
        r, c = np.nonzero((ip >= (least - slack)[:, None]) & (ip > -np.inf))
        score = _exact(q[i + r], x[c])
        order = np.lexsort((vec_id[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        found.append((i + r[keep], c[keep], score[keep]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _ids(values: pd.Series) -> np.ndarray:
    return values.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)


def _put(router: Router, dim: int, k_parts: int):
    """Vectors with their most probable part; queries with all their parts, most probable first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part, route = np.zeros(len(pdf), np.int32), [[0]] * len(pdf)
            at = np.flatnonzero((pdf["dim"] == dim).to_numpy())
            if len(at):
                odds = router.odds(_matrix(pdf["embedding"].iloc[at]))
                part[at] = odds.argmax(axis=1)
                for i in np.flatnonzero(pdf["asks"].iloc[at].to_numpy()):
                    route[at[i]] = np.argsort(-odds[i], kind="stable").tolist()
            asks = pdf["asks"].to_numpy()
            yield pdf.assign(part=part, route=[r if a else None for r, a in zip(route, asks, strict=True)])

    return run


def _probed(q: np.ndarray, q_uid: np.ndarray, k: int):
    """The best k of a task's vectors for each of the probed queries, with their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            r, c, score = _best(q, q_uid, _matrix(pdf["embedding"]), pdf["uid"].to_numpy(), _ids(pdf["vec_id"]), k)
            new = pd.DataFrame({"q": q_uid[r], "part": pdf["part"].to_numpy()[c], "score": score, "vec_id": _ids(pdf["vec_id"])[c]})
            held = new if held is None else pd.concat([held, new])
            held = held.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
        if held is not None:
            yield held

    return run


def _searched(k: int):
    """One block: its queries against its vectors."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["side"].to_numpy()
        q, x = pdf[asks], pdf[~asks]
        if q.empty or x.empty:
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype({"q": "int64", "query_id": "int64", "vec_id": "Int64", "score": "float64"})
        r, c, score = _best(_matrix(q["embedding"]), q["uid"].to_numpy(), _matrix(x["embedding"]), x["uid"].to_numpy(), _ids(x["vec_id"]), k)
        return pd.DataFrame({"q": q["uid"].to_numpy()[r], "query_id": q["vec_id"].to_numpy()[r], "vec_id": x["vec_id"].astype("Int64").to_numpy()[c], "score": score})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("rank") <= k)


class Index:
    """All vectors in learned parts, in the shared folder; ``probes`` is the number of parts that a query is sent to."""

    def __init__(self, vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, recall: float = RECALL, probed: int = PROBED) -> None:
        self.k = k
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.coalesce(queries & F.col(vec_id).isNotNull(), F.lit(False)).alias("asks"))
        e = F.col("embedding")
        sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
        rows = rows.where(sound).withColumn("dim", F.size(e)).withColumn("uid", F.monotonically_increasing_id())
        rows = scratch.kept(rows, "vectors")
        dims = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        self.dim, n = (dims["dim"], dims["n"]) if dims else (1, 0)
        parts = 1
        while parts * 2 <= min(max_parts, n // part_rows):
            parts *= 2
        drawn = self._drawn(rows.where(F.col("dim") == self.dim), n, sample, 13)
        self.router = fitted(_matrix(pd.Series([r["embedding"] for r in drawn.collect()])) if n else np.ones((1, 1)), parts)
        schema = "vec_id long, embedding array<double>, asks boolean, dim int, uid long, part int, route array<int>"
        self.rows = scratch.kept(rows.mapInPandas(_put(self.router, self.dim, parts), schema), "indexed")
        self.probes = self._measured(recall, probed) if parts > 1 else 1

    @staticmethod
    def _drawn(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
        """At most so many rows, by a hash of what they hold: the same for any layout."""
        h = F.xxhash64("vec_id", "embedding", F.lit(seed))
        few = rows.where(F.pmod(h, F.lit(max(n, 1))) < 2 * most + 64) if n > 4 * most else rows
        return few.orderBy(h, "uid").limit(most)

    def _measured(self, recall: float, probed: int) -> int:
        """The least number of parts that finds ``recall`` of the true neighbours of the probed queries."""
        asked = self.rows.where(F.col("asks") & (F.col("dim") == self.dim))
        q = self._drawn(asked, asked.count(), probed, 29).select("uid", "embedding", "route").collect()
        if not q:
            return 1
        told = self.rows.where(F.col("dim") == self.dim).select("uid", "vec_id", "embedding", "part")
        uid = np.array([r["uid"] for r in q])
        met = told.mapInPandas(_probed(_matrix(pd.Series([r["embedding"] for r in q])), uid, self.k), "q long, part int, score double, vec_id long")
        place = {r["uid"]: {p: i for i, p in enumerate(r["route"])} for r in q}
        # At most probed x k rows.
        needed = np.sort([place[r["q"]][r["part"]] for r in _top(met, self.k).select("q", "part").collect()])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1

    def search(self) -> DataFrame:
        """(query_id, rank, vec_id, score) for all queries of the index."""
        by = ["dim", "part"]
        asked = self.rows.where("asks").select("dim", "uid", "vec_id", "embedding", F.explode(F.slice("route", 1, self.probes)).alias("part"))
        # Counts for each part: as many rows as there are parts and lengths of vectors.
        sizes = self.rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        crowds = asked.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("crowds"))
        cells = sizes.join(crowds, by)
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(c)).cast("int")
        keep = [*by, "uid", "vec_id", "embedding"]
        x = self.rows.join(cells, by).select(*keep, F.lit(False).alias("side"), own("blocks", 3).alias("i"), each("crowds").alias("j"))
        q = asked.join(cells, by).select(*keep, F.lit(True).alias("side"), each("blocks").alias("i"), own("crowds", 5).alias("j"))
        met = x.unionByName(q).groupBy(*by, "i", "j").applyInPandas(_searched(self.k), "q long, query_id long, vec_id long, score double")
        return _top(met, self.k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = K, **options) -> DataFrame:
    """The ``k`` vectors with the largest inner product with each row for which ``queries`` holds."""
    return Index(vectors, queries, k, **options).search()

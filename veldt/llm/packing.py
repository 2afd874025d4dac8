"""Packing into optimal length buckets (operator 3).

The lengths of all documents form one histogram. Dynamic programming over it chooses the bucket boundaries that
minimise padding, every document being padded to its bucket's boundary. Inside a bucket, documents are dealt to
batches of at most ``token_budget`` padded tokens; one longer than that is a batch of its own.

The histogram is exact at any size: one row for each distinct length, so a corpus of w words has at most sqrt(2 w) of
them. It comes to the driver, which keeps 8 bytes for each length and bucket. Boundaries come from all documents.

Defined results: a null text has length 0 and is padded like any other; a null length counts as 0; repeated rows are
packed each; ties in length stand in the order of a hash of doc_id; fewer distinct lengths than buckets give fewer
buckets; an empty table gives no rows; clashing extra columns are dropped.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import n_words
from veldt.operators.ranks import buckets as piece_count
from veldt.operators.ranks import positions

N_BUCKETS, TOKEN_BUDGET = 16, 65_536
PIECE_ROWS = 4_000


def boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """At most ``n_buckets`` boundaries, the last the greatest length, of least total padding. Each layer of the
    dynamic programme is a lower envelope of lines, so it takes time linear in the distinct lengths."""
    lengths = sorted(histogram)
    if not lengths:
        return []
    counts, total = [0], [0]
    for x in lengths:
        counts.append(counts[-1] + histogram[x])
        total.append(total[-1] + histogram[x] * x)
    m = len(lengths)
    cost: list[int | None] = [0] + [None] * m
    steps = []
    for _ in range(min(n_buckets, m)):
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, from)
        new: list[int | None] = [None] * (m + 1)
        back, at = array("q", bytes(8 * (m + 1))), 0
        for j in range(1, m + 1):
            if cost[j - 1] is not None:
                line = (-counts[j - 1], cost[j - 1] + total[j - 1], j - 1)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            at, x = min(at, len(hull) - 1), lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            new[j], back[j] = x * counts[j] - total[j] + hull[at][0] * x + hull[at][1], hull[at][2]
        steps.append(back)
        cost = new
    out, j = [], m
    for back in reversed(steps):
        out.append(lengths[j - 1])
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, doc_id: str = "doc_id", text: str = "text", n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, slot, padding), a row for each row of ``docs``: batch counts from 0
    within its bucket, slot within its batch. ``length`` gives tokens; words are counted where it isn't given."""
    size = F.coalesce((n_words(F.col(text)) if length is None else length).cast("long"), F.lit(0))
    slim = scratch.kept(docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_tokens")), "lengths")
    seen = slim.groupBy(F.col("n_tokens").alias("x")).agg(F.count("*").alias("n")).toArrow()
    told = dict(zip(seen.column("x").to_pylist(), seen.column("n").to_pylist(), strict=True))
    edges = boundaries(told, n_buckets)
    held = [0] * len(edges)
    for x, n in told.items():
        held[bisect_left(edges, x)] += n
    if not edges:
        return slim.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("boundary", "long"), ("batch", "long"), ("slot", "long"), ("padding", "long"))])
    bucket = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[i], F.lit(i)).otherwise(bucket)
    dealt = slim.withColumn("bucket", bucket)
    boundary = F.get(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket"))
    per = F.get(F.array(*[F.lit(max(1, token_budget // max(1, e))).cast("long") for e in edges]), F.col("bucket"))
    dealt = dealt.withColumns({"boundary": boundary, "per": per, "key": F.xxhash64("doc_id")})
    placed = positions(dealt, ["bucket"], ["key", "doc_id", "n_tokens"], piece_count(max(held), PIECE_ROWS), "pos")
    return placed.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("pos") / F.col("per")).alias("batch"), (F.col("pos") % F.col("per")).alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))

"""K-d tree sharding by bytes (operator 9), in DataFrame functions alone.

Documents with equal texts are one point, of their total bytes; its coordinates are metadata: the text's size, the
source and the language (the least of the group's). A node that is to hold more than one shard is split at the
weighted median (or the quantile that fits its number of shards) of its widest dimension, width being measured
against the whole table's. The median is found by refining histograms: each pass sums bytes by bin of all open
nodes at once, and only those bounded sums reach the driver. Points of one coordinate are ordered by a hash of the
text, so ties split where they must. A group of equal texts that holds more than ``1 / PIECES`` of a shard is cut,
by a hash of doc_id, into pieces that are points of their own, as a split can be off by half of its heaviest point; any
other group stays in one shard.

Law: ``bytes`` (the shards' sizes are near equal: off by a small share of a shard, or by a single document's size).

Defined results: a null text has size 1 and the CRC of no bytes, and is grouped with empty texts; null source and
language are less than any other; rows that agree in all columns are dealt side by side; an empty table gives no
rows; more shards than points leave shards empty; clashing extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import if_small
from veldt.operators.ranks import buckets, positions, ranks

#: Bins of a histogram, for each node.
BIN_BITS = 13
#: A group of equal texts is cut from this share of a shard on.
PIECES = 16
#: A bin of at most this share of a shard's bytes need not be refined.
FINE = 1 / 2000
HASH_BITS = 48
#: Rows that one task numbers.
PIECE_ROWS = 4_000

DIMS = ("size", "source", "lang")


def _ranked(docs: DataFrame, col: str) -> DataFrame:
    """``docs`` with the rank of a column's value among all its values in place of it, from 1; 0 for null."""
    told = ranks(docs, col).select(F.col(col).alias("_value"), F.col("rank").alias("_rank"))
    met = docs.join(if_small(scratch.kept(told, "ranked_values")), F.col(col) == F.col("_value"), "left")
    return met.withColumn(col, F.coalesce(F.col("_rank") + 1, F.lit(0)).cast("long")).drop("_value", "_rank")


def _quantiles(points: DataFrame, col: str, nodes: dict[int, dict], fine: float) -> None:
    """For each node, set edge: the least value of ``col`` that goes right, so that the bytes left of it are as near
    the node's goal as values allow. ``nodes`` has goal, lo and hi; a value too heavy to go to one side whole is
    left as value, with the bytes before it."""
    open_nodes = set(nodes)
    for n in nodes.values():
        n |= {"before": 0, "edge": None, "value": None}
    while open_nodes:
        bins = {k: max(0, (nodes[k]["hi"] - nodes[k]["lo"]).bit_length() - BIN_BITS) for k in open_nodes}
        number = F.coalesce(*[F.when((F.col("node") == k) & F.col(col).between(nodes[k]["lo"], nodes[k]["hi"]), F.shiftright(F.col(col) - nodes[k]["lo"], bins[k])) for k in sorted(open_nodes)])
        sums: dict[int, list] = {k: [] for k in open_nodes}
        for r in points.select("node", number.alias("bin"), "bytes").where("bin is not null").groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect():
            sums[r["node"]].append((r["bin"], r["bytes"]))
        for k in sorted(open_nodes):
            n, done = nodes[k], False
            for b, w in sorted(sums[k]):
                if n["before"] + w < n["goal"]:
                    n["before"] += w
                    continue
                lo = n["lo"] + (b << bins[k])
                if not bins[k] and w > fine:
                    n["value"] = lo
                elif w <= fine or not bins[k]:
                    right = n["before"] + w - n["goal"] > n["goal"] - n["before"]
                    n["edge"] = lo if right else lo + (1 << bins[k])
                else:
                    n["lo"], n["hi"] = lo, min(n["hi"], lo + (1 << bins[k]) - 1)
                    break
                done = True
                break
            else:
                n["edge"], done = n["hi"] + 1, True
            if done:
                open_nodes.discard(k)


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of ``docs``; shards of ``target_bytes`` each, or
    ``n_shards`` of them."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    slim = scratch.kept(_ranked(_ranked(scratch.kept(slim, "sharded_texts"), "source"), "lang"), "sharded_documents")
    total, rows = slim.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    share = max(1, total // n_shards)
    limit = max(1, share // PIECES)
    heavy = slim.groupBy("h", "text_crc32").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > limit) & (F.col("n") > 1))
    heavy = heavy.select("h", "text_crc32", F.ceil(F.col("bytes") / limit).alias("cuts"))
    # At most total / limit rows: n_shards * PIECES, whatever the table's size.
    dealt = slim.join(F.broadcast(heavy), ["h", "text_crc32"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), "cuts"), F.lit(0))).drop("cuts")
    dealt = scratch.kept(dealt.withColumn("point", F.xxhash64("h", "text_crc32", "piece")), "sharded_pieces")
    points = dealt.groupBy("point").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in DIMS])
    points = scratch.kept(points.withColumn("key", F.col("point").bitwiseAND((1 << HASH_BITS) - 1)), "points")

    node = F.lit(0)
    tree = {0: n_shards}  # nodes by the first of their shards: how many they hold
    fine, root = share * FINE, None
    while any(k > 1 for k in tree.values()):
        now = points.withColumn("node", node)
        told = {r["node"]: r for r in now.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        open_nodes = {}
        for k, held in tree.items():
            if held > 1 and k in told:
                r = told[k]
                root = root or {d: max(1, r[f"{d}_hi"] - r[f"{d}_lo"]) for d in DIMS}
                dim = max(DIMS, key=lambda d: (r[f"{d}_hi"] - r[f"{d}_lo"]) / root[d])
                open_nodes[k] = {"dim": dim, "goal": r["bytes"] * (held // 2) / held, "lo": r[f"{dim}_lo"], "hi": r[f"{dim}_hi"], "held": held}
        along = F.coalesce(*[F.when(F.col("node") == k, F.col(n["dim"])) for k, n in open_nodes.items()], F.lit(None).cast("long"))
        now = now.withColumn("along", along)
        _quantiles(now.where("along is not null"), "along", open_nodes, fine)
        # A value too heavy for one side splits by the hash of its texts.
        tied = {k: {"goal": n["goal"] - n["before"], "lo": 0, "hi": (1 << HASH_BITS) - 1} for k, n in open_nodes.items() if n["value"] is not None}
        if tied:
            at = F.coalesce(*[F.when(F.col("node") == k, F.col("along") == open_nodes[k]["value"]) for k in tied], F.lit(False))
            _quantiles(now.where(at), "key", tied, 0)
        right = F.lit(0)
        new: dict[int, int] = {}
        for k, held in tree.items():
            if k not in open_nodes:
                new[k] = held if held == 1 else 1
                continue
            n, left = open_nodes[k], held // 2
            new |= {k: left, k + left: held - left}
            if n["value"] is None:
                past = F.col(n["dim"]) >= n["edge"]
            else:
                edge = tied[k]["edge"] if tied[k]["edge"] is not None else tied[k]["value"] + 1
                past = (F.col(n["dim"]) > n["value"]) | ((F.col(n["dim"]) == n["value"]) & (F.col("key") >= edge))
            right = F.when(node == k, F.when(past, F.lit(left)).otherwise(F.lit(0))).otherwise(right)
        node, tree = node + right, new
        points = scratch.kept(points.withColumn("at", node), "points")
        node = F.col("at")
    if "at" not in points.columns:
        points = points.withColumn("at", F.lit(0))
    out = scratch.kept(dealt.join(points.select("point", F.col("at").cast("int").alias("shard")), "point").select("doc_id", "size", "text_crc32", "shard"), "shards")
    return positions(out, ["shard"], ["doc_id", "text_crc32", "size"], buckets(rows, n_shards * PIECE_ROWS), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")

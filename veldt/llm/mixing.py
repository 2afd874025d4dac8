"""Mixing sources to target weights (operator 1).

A source's documents, in a fixed order, are one run of words, packed into blocks of ``block`` words. The output is a
sequence of shards of ``shard_slots`` slots. Each shard draws how many slots each source gets from a multinomial with
the targets as weights; the draws of all shards are then settled against each source's whole number of slots (what a
source drew too much is handed, slot by slot, to those that drew too little), so sums meet the targets. The slots of
a source, numbered over all shards, map through a pseudorandom permutation of its blocks (a Feistel network, keyed by
source and pass): every block comes once before any comes twice. Slots and blocks are joined by block index.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at
``max_epochs`` times its source's size, and the excess is reshared by weight until none is above. The last slot of a
source is cut to the words left of its target, so each source's words are its target rounded down.

Everything is a function of the rows and the seed: no draw depends on partitions, and reruns agree (documents that agree
in doc_id, size and text change places at most). Sources are a row each on the driver, and are joined as a table.

Defined results: a null text has no words; a null source is a source of its own, last; documents of no words take
none; repeated rows are documents of their own, and ties in doc_id are ordered by size and text; an empty table gives
no rows; clashing extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import if_small, let, n_words, words
from veldt.operators.ranks import buckets, positions

#: Fixed values of the contract: the weights, in turn, and how often a source may be repeated.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
BLOCK, SHARD_SLOTS, SEED = 256, 4096, 17
#: Rows that one task orders.
PIECE_ROWS = 4_000
#: Cells of the line on which spare slots and sources that lack slots meet.
CELLS = 1_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """The target of each source, given in order: exact water-filling."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap = [max_epochs * s for s in sizes]
    left, free, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * unit > cap[i]]
        if not over:
            for i in free:
                out[i] = w[i] * unit
            break
        for i in over:
            out[i] = Fraction(cap[i])
            left -= cap[i]
            free.discard(i)
    return [float(x) for x in out]


def _mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Images of ``index`` under the permutation of range(n) that ``key`` names: four Feistel rounds over the next even
    power of two, walked along its cycle until back below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), _mix64(np.uint64(key) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        v = x[todo]
        a, b = v >> np.uint64(half), v & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ (_mix64(a ^ k) & low), a
            else:
                a, b = b, a ^ (_mix64(b ^ k) & low)
        x[todo] = a << np.uint64(half) | b
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source's share of the mix; ``slots`` take ``words`` in all, the last slot only its first ``last`` words."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    words: int
    slots: int
    last: int

    def key(self, seed: int, epoch: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}|{self.number}|{self.name}|{epoch}".encode()).digest()[:8], "little")


def _source(number: int, name: str | None, size: int, target: float, block: int, seed: int) -> Source:
    blocks, words = -(-size // block), int(target)
    epochs, rest = divmod(words, size) if size else (0, 0)
    slots, last = epochs * blocks, 0
    if rest:
        plain = Source(number, name, size, target, blocks, words, 0, 0)
        tail = int(permuted(np.array([blocks - 1]), blocks, plain.key(seed, epochs), inverse=True)[0])
        short = blocks * block - size  # words that the source's last block lacks
        more = -(-rest // block)
        more = more if more <= tail else max(tail + 1, -(-(rest + short) // block))
        held = more * block - (short if tail < more else 0)
        slots += more
        end = block - (short if tail == more - 1 else 0)
        last = end - (held - rest)
    elif epochs:
        last = block if blocks == 0 else min(block, size)
    return Source(number, name, size, target, blocks, words, slots, last)


def _draw(sources: list[Source], shard_slots: int, n_shards: int, total: int, seed: int):
    share = np.array([s.slots for s in sources], float)
    share = share / share.sum() if total else share

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                n = min(shard_slots, total - int(shard) * shard_slots)
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(n, share)
                some = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": shard, "number": some, "drawn": drawn[some]})

    return run


def _serve(sources: list[Source], block: int, seed: int):
    """Slots of a source to blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, number, first, n in zip(pdf["shard"], pdf["number"], pdf["first"], pdf["n"], strict=True):
                s = sources[number]
                slot = np.arange(first, first + n, dtype=np.int64)
                epoch, at = slot // s.blocks, slot % s.blocks
                index = np.empty(len(slot), np.int64)
                for e in np.unique(epoch):
                    index[epoch == e] = permuted(at[epoch == e], s.blocks, s.key(seed, int(e)))
                words = np.minimum(block, s.size - index * block)
                words[slot == s.slots - 1] = s.last if s.words % s.size else words[slot == s.slots - 1]
                yield pd.DataFrame({"shard": shard, "number": number, "slot": slot, "epoch": epoch.astype(np.int32), "block": index, "words": words})

    return run


@dataclass
class Mix:
    """``documents``: row, doc_id, number (of the source), size, start (of its words in the source's run). ``slots``:
    shard, number, slot, epoch, block, words (taken from the block's start)."""

    documents: DataFrame
    slots: DataFrame
    sources: list[Source]
    block: int

    def pieces(self) -> DataFrame:
        """(row, doc_id, number, epoch, shard, slot, begin, end): the words of a document that a slot takes."""
        b = self.block
        spans = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        met = spans.join(self.slots, ["number", "block"])
        begin = F.greatest(F.col("start"), F.col("block") * b) - F.col("start")
        end = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words")) - F.col("start")
        return met.select("row", "doc_id", "number", "epoch", "shard", "slot", begin.alias("begin"), end.alias("end")).where("end > begin")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), a row for each document."""
        took = self.pieces().groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
        told = self.documents.sparkSession.createDataFrame([(s.number, s.size, s.target) for s in self.sources], "number int, source_size long, target double")
        out = self.documents.join(took, "row", "left").join(if_small(told), "number")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, row: str | None = None) -> Mix:
    """The mix of all rows of ``docs``; the column ``row``, if given, numbers them."""
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    slim = docs.select(number.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("h"))
    slim = scratch.kept(slim, "mixed_documents")
    held = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    held.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in held]
    sources = [_source(i, r["source"], r["size"], t, block, seed) for i, (r, t) in enumerate(zip(held, targets(sizes, weights, max_epochs), strict=True))]
    names = spark.createDataFrame([(s.number, s.name) for s in sources] or [(0, None)], "number int, name string")
    ordered = slim.join(if_small(names), F.col("source").eqNullSafe(F.col("name"))).select("row", "doc_id", "number", "size", "h")
    documents = scratch.kept(positions(ordered, ["number"], ["doc_id", "size", "h"], buckets(sum(r["n"] for r in held), PIECE_ROWS), "start", F.col("size")).drop("h"), "mixed_order")

    total = sum(s.slots for s in sources)
    n_shards = -(-total // shard_slots)
    if not total:
        return Mix(documents, spark.createDataFrame([], "shard long, number int, slot long, epoch int, block long, words long"), sources, block)
    drawn = spark.range(0, n_shards, 1, min(n_shards, spark.sparkContext.defaultParallelism)).mapInPandas(_draw(sources, shard_slots, n_shards, total, seed), "shard long, number int, drawn long")
    drawn = scratch.kept(drawn, "drawn")
    settled = _settle(drawn, sources)
    slots = settled.mapInPandas(_serve(sources, block, seed), "shard long, number int, slot long, epoch int, block long, words long")
    return Mix(documents, scratch.kept(slots, "slots"), sources, block)


def _settle(drawn: DataFrame, sources: list[Source]) -> DataFrame:
    """(shard, number, first, n): runs of slots. Of what a source drew beyond its slots, the last draws are handed to
    sources that drew too little, in order of source."""
    spark = drawn.sparkSession
    order = ["shard"]
    n_pieces = buckets(-(-drawn.count() // max(1, len(sources))), PIECE_ROWS)
    numbered = positions(drawn, ["number"], order, n_pieces, "first", F.col("drawn"))
    quota = spark.createDataFrame([(s.number, s.slots) for s in sources], "number int, quota long")
    numbered = scratch.kept(numbered.join(quota, "number"), "numbered")
    kept = numbered.where("first < quota").select("shard", "number", "first", F.least(F.col("drawn"), F.col("quota") - F.col("first")).alias("n"))
    spare = numbered.where("first + drawn > quota").select("shard", (F.col("first") + F.col("drawn") - F.greatest("quota", "first")).alias("n"))
    spare = spare.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    got = {r["number"]: r["n"] for r in numbered.groupBy("number").agg(F.sum("drawn").alias("n")).collect()}
    # The sources that lack slots, laid end to end: as many slots as are spare.
    lacks, at = [], 0
    for s in sources:
        if (miss := s.slots - got.get(s.number, 0)) > 0:
            lacks.append((s.number, at, at + miss, got.get(s.number, 0)))
            at += miss
    if not lacks:
        return kept
    spare = positions(scratch.kept(spare, "spare"), ["all"], ["shard"], n_pieces, "at", F.col("n"))
    table = spark.createDataFrame(lacks, "number int, lo long, hi long, had long")
    # Both are runs on one line: they meet by cells of it, each pair in the first cell that both touch.
    cell = max(1, at // CELLS)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell)))
    ends = F.col("at") + F.col("n")
    met = spare.withColumn("cell", cells(F.col("at"), ends)).join(if_small(table.withColumn("cell", cells(F.col("lo"), F.col("hi")))), "cell")
    lo, hi = F.greatest("at", "lo"), F.least(ends, F.col("hi"))
    handed = met.where((lo < hi) & (F.col("cell") == F.floor(lo / cell)))
    return kept.unionByName(handed.select("shard", "number", (F.col("had") + lo - F.col("lo")).alias("first"), (hi - lo).alias("n")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass over a source, a row for each document of which words are taken, with the
    columns of ``docs``; where only some blocks of it are taken, its text is those words. A text taken whole stays as
    it is."""
    text = options.get("text", "text")
    names = docs.columns
    docs = scratch.kept(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix_input")
    made = mix(docs, row="_mix_row", **options)
    spans = made.pieces().groupBy("row", "epoch").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sum(F.col("end") - F.col("begin")).alias("took"))
    spans = spans.join(made.documents.select("row", "size"), "row").select(F.col("row").alias("_mix_of"), F.when(F.col("took") < F.col("size"), F.col("spans")).alias("_mix_spans"))
    out = docs.join(spans, F.col("_mix_row") == F.col("_mix_of"))

    # Nested: a text's words are cut once, and only where blocks of it are left out.
    part = let(words(F.col(text)), lambda ws: F.array_join(F.transform("_mix_spans", lambda x: F.array_join(F.slice(ws, x["begin"].cast("int") + 1, (x["end"] - x["begin"]).cast("int")), " ")), "\n"))
    return out.withColumn(text, F.when(F.col("_mix_spans").isNull(), F.col(text)).otherwise(part)).select(*names)

"""Target-distribution importance resampling over bucket-partitioned inverted postings (operator 11).

Words and pairs of neighbouring words fall into buckets by a hash. Both corpora become postings, one list for each
bucket and some thousand documents: (bucket, document, count). The lists of both corpora meet by bucket, where their
sums give the bucket's gain, ln of the target's share over the corpus's. Postings are then shuffled by groups of buckets
(split by blocks of documents, so that no bucket's list is one task's), each task turns counts into contributions with
the gains of its buckets, and contributions are reduced by document. Gumbel noise, fixed by a hash of doc_id, makes the
highest scores a draw without replacement in proportion to the weights; the order over all documents is taken by range
partitions.

A document meets ``GROUPS`` partial sums, whatever the size of the corpus. The gains, one number for each bucket, are
broadcast: their number is a parameter.

Defined results: a null text has no words, so no features and weight 0; a null doc_id hashes as the empty string, stands
last among ties, and returns as null; rows that repeat are drawn each on its own, with the same score; without documents
there are no rows, and without a target every bucket's gain still follows the formula; texts of any length are read
whole; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import batches_of
from veldt.operators.ranks import placed

BUCKETS = 10_000
#: Groups of buckets into which postings are shuffled: as many partial sums for each document.
GROUPS = 16
#: Blocks of documents whose lists of one group go to one task.
BLOCKS = 64
#: A block ends at so many words, or documents (two bytes number them).
BLOCK_WORDS, BLOCK_DOCS = 1 << 20, 1 << 15
LEAST_WORDS, PERCENT = 20, 25
#: Different words that a worker holds with their hashes.
HELD = 400_000
#: Lengths, in bytes, for which the hash of a pair is put together from its words' hashes by tables.
TABLED = 64

#: ASCII is lower-cased; a word is made of digits, letters and all bytes of other characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_POSTING = "block long, bucket int, n long, docs binary, counts binary, doc int, doc_id long, n_words long"


def _moved() -> np.ndarray:
    """For each length, tables of what a CRC becomes after so many zero bytes: the CRC is linear in its bits."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for n in range(TABLED + 1):
        none = zlib.crc32(bytes(n), 0)
        for k in range(4):
            out[n, k] = [zlib.crc32(bytes(n), x << (8 * k)) ^ none for x in range(256)]
    return out.reshape(-1)


class _Words(dict):
    """Words as numbers, with the CRC of the word, of a space before it, and the length of the latter."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int]] = []
        self.texts: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.rows.append((zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1))
        self.texts.append(word)
        self[word] = at = len(self.texts) - 1
        return at


def _hashes(words: _Words, ids: np.ndarray, ends: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, CRC) of all words and of all pairs of neighbours in one document; ends: where documents end."""
    told = np.array(words.rows, np.int64).reshape(-1, 3)
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    first, then, length = told[ids, 0], told[ids, 1], told[ids, 2]
    pair = of[:-1] == of[1:]
    a, b, n = first[:-1][pair], then[1:][pair], length[1:][pair]
    base = np.minimum(n, TABLED) * 1024
    both = b ^ moved[base + (a & 255)] ^ moved[base + 256 + (a >> 8 & 255)] ^ moved[base + 512 + (a >> 16 & 255)] ^ moved[base + 768 + (a >> 24)]
    for i in np.flatnonzero(n > TABLED):
        both[i] = zlib.crc32(b" " + words.texts[ids[1:][pair][i]], int(a[i]))
    return np.r_[of, of[:-1][pair]], np.r_[first, both]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = (np.r_[0, ends] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _empty(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def _posted(n_buckets: int):
    """A row for each document of a block, and one for each bucket's list in it."""

    def flush(block: int, words: _Words, doc_ids: list, held: list[np.ndarray], moved: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in held], np.int64)
        n = len(sizes)
        docs = [pa.array(np.full(n, block)), _empty(n, pa.int32()), pa.array(sizes + np.maximum(sizes - 1, 0)), _empty(n, pa.binary()), _empty(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(doc_ids, pa.int64()), pa.array(sizes)]
        names = ["block", "bucket", "n", "docs", "counts", "doc", "doc_id", "n_words"]
        yield pa.RecordBatch.from_arrays(docs, names=names)
        ids = np.concatenate(held)
        if not len(ids):
            return
        of, crc = _hashes(words, ids, np.cumsum(sizes), moved)
        key = np.sort((crc % n_buckets) * n + of)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count, key = np.diff(np.r_[at, len(key)]), key[at]
        often = (count + 254) // 255  # a count beyond a byte takes several postings
        if (often > 1).any():
            last = np.cumsum(often) - 1
            key, rest = np.repeat(key, often), count - 255 * (often - 1)
            count = np.full(len(key), 255)
            count[last] = rest
        bucket, doc = key // n, (key % n).astype("<u2")
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[start[1:], len(bucket)]
        m = len(start)
        lists = [pa.array(np.full(m, block)), pa.array(bucket[start].astype(np.int32)), pa.array(np.add.reduceat(count, start)), _binary(doc, ends), _binary(count.astype(np.uint8), ends), _empty(m, pa.int32()), _empty(m, pa.int64()), _empty(m, pa.int64())]
        yield pa.RecordBatch.from_arrays(lists, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, words, block = _moved(), _Words(), TaskContext.get().partitionId() << 32
        doc_ids, held, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = (text or b"").translate(_FOLD).split()
                doc_ids.append(doc_id)
                held.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                size += len(found)
                if size >= BLOCK_WORDS or len(held) >= BLOCK_DOCS:
                    yield from flush(block, words, doc_ids, held, moved)
                    doc_ids, held, size, block = [], [], 0, block + 1
                    if len(words) > HELD:
                        words = _Words()
        if held:
            yield from flush(block, words, doc_ids, held, moved)

    return run


def _contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc, part): sums of count times gain, of rows (block, docs, counts, gain) in the order of blocks."""

    def out(block: int, total: np.ndarray) -> pa.RecordBatch:
        docs = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), block)), pa.array(docs.astype(np.int32)), pa.array(total[docs].astype(np.int64))], names=["block", "doc", "part"])

    now, total = None, np.zeros(BLOCK_DOCS)
    for b in batches:
        blocks, gains = b.column(0).to_numpy(), b.column(3).to_numpy()
        ends = np.flatnonzero(np.r_[blocks[1:] != blocks[:-1], True]) + 1 if len(blocks) else []
        start = 0
        for end in ends:
            if blocks[start] != now:
                if now is not None:
                    yield out(now, total)
                now, total = blocks[start], np.zeros(BLOCK_DOCS)
            rows = b.slice(start, end - start)
            docs, counts = (b"".join(rows.column(k).to_pylist()) for k in (1, 2))
            lengths = np.fromiter(map(len, rows.column(2).to_pylist()), np.int64, end - start)
            # Sums of whole numbers far below 2**53: exact in doubles.
            total += np.bincount(np.frombuffer(docs, "<u2"), np.frombuffer(counts, np.uint8) * np.repeat(gains[start:end].astype(float), lengths), BLOCK_DOCS)
            start = end
    if now is not None:
        yield out(now, total)


def gains(postings: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from the lists of both corpora (``target`` tells them apart) met by bucket."""
    sums = scratch.kept(postings.where("bucket is not null").groupBy("bucket").agg(F.coalesce(F.sum(F.when(~F.col("target"), F.col("n"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(F.col("target"), F.col("n"))), F.lit(0)).alias("t")), "buckets")
    whole = sums.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = float((whole["s"] or 0) + n_buckets), float((whole["t"] or 0) + n_buckets)
    ratio = ((F.col("t") + 1).cast("double") * F.lit(s)) / ((F.col("s") + 1).cast("double") * F.lit(t))
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, fixed by the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each row of ``docs``; weight is the floored mean gain."""
    spark = docs.sparkSession
    with batches_of(spark, 256):
        here = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(_posted(n_buckets), _POSTING).withColumn("target", F.lit(False))
        there = target.select(F.lit(None).cast("long"), F.col(target_text).cast("binary")).mapInArrow(_posted(n_buckets), _POSTING).withColumn("target", F.lit(True))
        postings = scratch.kept(here.unionByName(there), "postings")
        gain = gains(postings, n_buckets)
        told = postings.where("doc is not null and not target").select("block", "doc", "doc_id", "n_words", F.col("n").alias("n_features"))
        lists = postings.where("bucket is not null and not target").select("block", "bucket", "docs", "counts")
        salts = max(1, math.ceil(told.select("block").distinct().count() / BLOCKS))
        by = [F.pmod("bucket", F.lit(GROUPS)).alias("group"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")]
        dealt = lists.select("*", *by).repartition(min(GROUPS * salts, 20_000), "group", "salt").join(F.broadcast(gain), "bucket")
        parts = dealt.sortWithinPartitions("block").select("block", "docs", "counts", "gain").mapInArrow(_contributed, "block long, doc int, part long")
        sums = scratch.kept(parts.groupBy("block", "doc").agg(F.sum("part").alias("total")), "contributions")
    out = told.join(sums, ["block", "doc"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7, n_buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the documents with ``least_words`` words, ``percent`` in a hundred with
    the highest scores are drawn and ranked from 1."""
    scored = weigh(docs, target, doc_id, text, target_text, n_buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scratch.kept(scored, "scored")
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features")]
    ranked = placed(scored.where(able), order, "rank", 1)
    drawn = percent * scored.where(able).count() // 100
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~able), allowMissingColumns=True)
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))

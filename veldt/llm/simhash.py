"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7).

A 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints at most 3 bits apart have a half in which
they are at most 1 apart, half of the radius. So every fingerprint emits, for each half, all 33 variants of the
half within 1 bit (``variants``), which meet the plain halves (``centres``) in a shuffle on the variant; pairs that
collide are verified by their whole distance. That finds every link.

A half that more than ``dense`` distinct fingerprints share would make a pair of each two. Such halves take the same
step once more, in the other half: within the key the rest of the radius is at most 3, so the centres emit the
529 variants of their other half within 2 bits, and those that met the key emit theirs within 1 bit (or the other
half itself, where they are already 1 bit off). All that share such a key are within the radius of the least of
the emitters by construction, so a star of links to it keeps the components whole, without a pair of each two.

Documents are first reduced to distinct fingerprints, so copies cost nothing here.

Fingerprints miss most texts of a true similarity near 0.8. ``clean`` can also take out those whose sets of shingles
have a Jaccard similarity of at least 4/5 with an earlier text's: the exact join of line dedup, a text being one line
and its shingles the words. Shingles are told apart by 53 bits of hash and a frequency class.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text of fewer words
than a shingle is one shingle; repeated rows come back each; a null doc_id never names a component unless its
component has no other; ties cannot arise (a component is named by its least doc_id); an empty table gives no
rows; clashing extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt import scratch
from veldt.llm import linededup
from veldt.llm.texts import if_small, short_batches
from veldt.operators.graph import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Distinct fingerprints that share a half from which on the half is split again.
DENSE = 64
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 200_000
#: Words whose hashes a task remembers, and the odd number by which hashes are mixed.
REMEMBERED, MULTIPLIER = 1_000_000, np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    n = len(words)
    if not n:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, n - shingle + 1)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-1].tolist()]
        ends = (ends[min(shingle, len(part)) - 1 :] - 1).tolist()
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)  # noqa: B905
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): fp holds the fingerprint's bits as a signed long, h a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """The masks of all patterns of at most ``radius`` of ``bits`` bits."""
    out = [0]
    for i in range(radius):
        out += [m | 1 << b for m in (x for x in out if x.bit_count() == i) for b in range(m.bit_length(), bits)]
    return out


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp), enough to keep every component whole."""
    low = F.lit(0xFFFFFFFF).cast("long")
    fp = F.col("fp")
    cut = F.explode(F.array(F.struct(F.lit(0).alias("half"), fp.bitwiseAND(low).alias("own"), F.shiftrightunsigned(fp, 32).alias("other")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(fp, 32).alias("own"), fp.bitwiseAND(low).alias("other"))))
    masks = lambda r: F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(32, r)]))
    halves = fps.select("fp", cut.alias("h")).select("fp", "h.half", "h.own", "h.other")
    centres = scratch.kept(halves.withColumn("n", F.count("*").over(_by("half", "own"))), "centres")
    variants = halves.select("fp", "half", "own", "other", masks(1).alias("mask")).select("fp", "half", F.col("own").bitwiseXOR(F.col("mask")).alias("key"), "other", "mask")
    thin = centres.where(F.col("n") <= dense).select("half", F.col("own").alias("key"), F.col("fp").alias("fp2")).hint("merge")  # estimates don't see what explode makes
    near = variants.select("fp", "half", "key").join(thin, ["half", "key"]).where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS))
    out = near.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))
    thick = scratch.kept(centres.where(F.col("n") > dense).select("half", F.col("own").alias("key"), "fp", "other"), "dense")
    keys = thick.select("half", "key").distinct()
    if not keys.take(1):
        return out.distinct()
    inner = thick.select("half", "key", "fp", F.lit(False).alias("emits"), "other", masks(2).alias("mask"))
    outer = thick.select("half", "key", "fp", F.lit(True).alias("emits"), "other", masks(1).alias("mask"))
    met = variants.where("mask <> 0").join(keys, ["half", "key"], "left_semi").select("half", "key", "fp", F.lit(True).alias("emits"), "other", F.lit(0).cast("long").alias("mask"))
    cells = inner.unionByName(outer).unionByName(met).groupBy("half", "key", F.col("other").bitwiseXOR(F.col("mask")).alias("v"))
    # A cell holds at most 529 centres and 65 others: its members differ within 2 bits of one half.
    cells = cells.agg(F.min(F.when(F.col("emits"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("fps")).where("a is not null and size(fps) > 1")
    return out.unionByName(cells.select("a", F.explode("fps").alias("b")).where("a <> b")).distinct()


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``."""
    return _grouped(docs, doc_id, text, shingle, dense).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """(doc_id, h, fp, component, component_id): component is the group's least fingerprint."""
    known = scratch.kept(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    fps = scratch.kept(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    groups = connected_components(links(fps.select("fp"), dense))
    named = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("fp", "component", "component_id")
    return known.join(named, "fp").select("doc_id", "h", "fp", "component", "component_id")


class _Hashes(dict):
    """Words' hashes, computed once for each word; a bounded number of them is remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxh64_intdigest(word, SEED)
        return out


def shingle_hashes(text: bytes | None, shingle: int, hashes: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each shingle of a text in UTF-8, A-Z in lower case, with repeats; one where there are fewer words
    than a shingle has, none where there are no words. A shingle's hash is a polynomial of its words' hashes, mixed."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        out = out * MULTIPLIER + each[i : i + n]
    return (out ^ (out >> np.uint64(31))) * MULTIPLIER


class Shingles(linededup.Lines):
    """A text as one set: its different shingles. Arrow functions read the texts, once for the rarity of shingles, once for
    the sets and once for those sets that are verified."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle

    def pieces(self, text: Column) -> Column:
        return F.array(F.coalesce(text.cast("string"), F.lit("")))

    def ready(self, piece: Column) -> Column:
        return piece

    def buckets(self, docs: DataFrame, text: str) -> DataFrame:
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, hashes = np.zeros(1 << linededup.BUCKET_BITS, np.int64), _Hashes()
            for b in batches:
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    at = shingle_hashes(t, shingle, hashes) & np.uint64(len(counts) - 1)
                    np.add.at(counts, at.astype(np.int64), 1)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

        short_batches(docs.sparkSession)
        return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def _keys(self, classes: list[int]) -> Callable[[bytes | None, dict[bytes, int]], np.ndarray]:
        told, shingle, bits = bytes(classes), self.shingle, linededup.KEY_BITS

        def keys(text: bytes | None, hashes: dict[bytes, int]) -> np.ndarray:
            hs = shingle_hashes(text, shingle, hashes)
            rank = np.frombuffer(told, np.uint8)[(hs & np.uint64(len(told) - 1)).astype(np.int64)]
            return np.unique(rank.astype(np.int64) << bits | (hs & np.uint64((1 << bits) - 1)).astype(np.int64))

        return keys

    def keyed(self, pieces: DataFrame, classes: list[int], *keep: str) -> DataFrame:
        keys = self._keys(classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for b in batches:
                sets = [keys(t, hashes) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(sets, np.int64)], names=[*keep, "keys"])

        short_batches(pieces.sparkSession)
        rows = pieces.select(*keep, F.col("piece").cast("string").alias("piece"))
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("keys", T.ArrayType(T.LongType()))]))

    def sets(self, docs: DataFrame, doc_id: str, text: str, classes: list[int], min_words: int) -> DataFrame:
        keys, (num, den) = self._keys(classes), (linededup.NUM, linededup.DEN)

        def told(text: bytes | None, hashes: dict[bytes, int]) -> tuple[int, int, int, int, int, np.ndarray]:
            ks = keys(text, hashes)
            n, raw = len(ks), ks.tobytes()
            dealt = n - -(-num * n // den) + 1 if n > linededup.ALIKE else 0
            fold, half = 0, 0
            if 0 < n <= linededup.WIDEST:
                bits = np.bincount(ks & 63, minlength=64), np.bincount(ks & 63, weights=ks >> 6 & 1, minlength=64).astype(np.int64)
                fold, half = (sum(1 << i for i in np.flatnonzero(x & 1).tolist()) for x in bits)
            prefix = (ks[:dealt].view(np.uint64) * MULTIPLIER >> np.uint64(32)).astype(np.uint32).view(np.int32)
            return n, xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2), fold, half if n > linededup.WIDE else 0, prefix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            for b in batches:
                n, *longs, prefix = zip(*[told(t, hashes) for t in b.column(2).cast(pa.binary()).to_pylist()], strict=True) if b.num_rows else ((),) * 6
                one, none = np.ones(len(n), np.int64), np.zeros(len(n), np.int32)
                values = [pa.array(one), pa.array(none), pa.array(n, pa.int32()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in longs], _lists(prefix, np.int32)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *values], names=["doc_id", "h", "n_lines", "line", "n", "s1", "s2", "fold", "half", "prefix"])

        from xxhash import xxh64_intdigest

        short_batches(docs.sparkSession)
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
        longs = [T.StructField(c, T.LongType()) for c in ("s1", "s2", "fold", "half")]
        counts = [T.StructField("n_lines", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("n", T.IntegerType())]
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *counts, *longs, T.StructField("prefix", T.ArrayType(T.IntegerType()))]))


def _lists(arrays: Sequence[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if len(arrays) else np.empty(0, kind), pa.from_numpy_dtype(kind)))


def similar(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h): documents whose shingles are similar to an earlier one's; h is the hash of their text."""
    return linededup.matched(docs, doc_id, text, cut=Shingles(shingle)).where("size(removed) > 0").select("doc_id", "h").distinct()


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar_shingle: int | None = None) -> DataFrame:
    """``docs`` without all but one document of each group: the one with the least doc_id stays (null last; where unlike
    texts of a group share it, the one whose text has the least hash), once where its row is repeated. Documents are told
    by doc_id and text, so unlike texts of one doc_id are decided each on its own. With ``similar_shingle``, texts similar
    to an earlier one by shingles of so many words go too."""
    found = scratch.kept(_grouped(docs, doc_id, text).groupBy("component", "component_id", "doc_id", "h").agg(F.count("*").alias("n")), "groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = found.where(first).groupBy(F.col("component").alias("_c")).agg(F.min("h").alias("_stays"))
    marked = found.join(stays, F.col("component") == F.col("_c"))
    gone = scratch.kept(marked.where(~first | (F.col("h") != F.col("_stays"))).select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")), "copies")
    same = lambda key: F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text)) == F.col("_h"))
    out = docs.join(if_small(gone), same("_gone"), "left_anti")
    if similar_shingle is not None:
        late = scratch.kept(similar(docs, similar_shingle, doc_id, text).select(F.col("doc_id").alias("_late"), F.col("h").alias("_h")), "similar")
        out = out.join(if_small(late), same("_late"), "left_anti")
    twice = scratch.kept(marked.where(first & (F.col("h") == F.col("_stays")) & (F.col("n") > 1)).select(F.col("doc_id").alias("_twice"), F.col("h").alias("_h")), "repeated")
    if not twice.take(1):
        return out
    # Of rows that agree in doc_id and text, the one with the least hash of all its columns.
    some, row = if_small(twice), F.struct(*[F.col(c) for c in docs.columns])
    many = out.join(some, same("_twice"), "left_semi")
    once = many.groupBy(F.col(doc_id), F.xxhash64(F.col(text))).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return out.join(some, same("_twice"), "left_anti").unionByName(once)

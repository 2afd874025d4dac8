"""Spelling variants by a symmetric-delete join (operator 13).

Every word emits itself and its single deletions. A word and a longer one that differ by an inserted letter meet where the
longer one's deletion is the shorter word; words of one length that differ by a replaced letter meet where both, without
the letter in the same place, are the same. So keys of deletions carry the place, and a key's group is at most one word
for each letter: never more than the alphabet, however large or skewed the corpus. What meets is verified for a distance
of exactly one, each pair once, and words aggregate their near words: how many, and the most frequent one. It is the
word's form if it is ``RATIO`` times as frequent; as counts grow with each step, chains of forms end, and their roots are
found by joining each word's root with that root's own root until nothing changes. All joins are sorted merges: a table of
words is small as compressed Parquet but not as a hash table, which a broadcast would build in the driver.

Counting: runs are counted in each document and summed in the worker before the shuffle, so a very common word is one row
for each task.

Defined results: a null text has no words; a null doc_id is hashed as the empty string; rows that repeat count each; runs
of any length are words; ties in frequency go to the least word in the order of code points; without words there are no
rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import batches_of

#: Code points and occurrences that a word needs; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Of so many pairs of a document and a run, one loses a letter.
MISSPELT = 199
#: Different words that a worker sums up before it hands them on.
HELD = 200_000

#: Letters in Latin-1, where each is one byte; A-Z alone are lower-cased, all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text, in Latin-1; characters beyond it part words."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _counted(least: int, misspelt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter[bytes] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in Counter(w for w in runs(text or "") if len(w) >= least).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % misspelt == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += n
            if len(held) > HELD:
                yield out(held)
                held.clear()
        if held:
            yield out(held)

    return run


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n): the words of all texts."""
    with batches_of(docs.sparkSession, 256):
        told = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(_counted(least_length, misspelt), "word string, n long")
        return scratch.kept(told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")


def near(found: DataFrame) -> DataFrame:
    """(word, other, n): pairs of words at a distance of exactly one, both ways, with the other's count."""
    places = F.sequence(F.lit(1), F.length("word"))
    cut = F.transform(places, lambda i: F.concat(F.col("word").substr(F.lit(1), i - 1), F.col("word").substr(i + 1, F.length("word"))))
    keys = found.select("word", "n", F.posexplode(cut).alias("place", "key"))
    one = keys.select("key", "place", "word", "n")
    two = keys.select("key", "place", F.col("word").alias("other"), F.col("n").alias("m"))
    replaced = one.join(two.hint("merge"), ["key", "place"]).where("word <> other").select("word", "other", F.col("m").alias("n"))
    # Of equal neighbouring letters one deletion is enough.
    longer = found.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(cut)).alias("word"))
    shorter = found.hint("merge").join(longer.hint("merge"), "word")
    added = shorter.select("word", F.col("long").alias("other"), F.col("long_n").alias("n")).unionByName(shorter.select(F.col("long").alias("word"), F.col("word").alias("other"), "n"))
    return replaced.unionByName(added).where(F.levenshtein("word", "other", 1) == 1)


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word."""
    found = words(docs, doc_id, text, least_length, least_count, misspelt)
    best = near(found).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other"))).alias("best"))
    told = found.join(best.hint("merge"), "word", "left")
    better = -F.col("best.less") >= ratio * F.col("n")
    told = scratch.kept(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best.other")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), "forms")
    return told.join(roots(told).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round doubles how far a root has been followed."""
    now = scratch.kept(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.kept(now.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not new.where("moved").take(1):
            return new.select("word", "root")
        now = new.select("word", "root")

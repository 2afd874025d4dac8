"""Toxic passages by maximum-scoring segments (operator 5).

Words get log-odds of their tokens' share in toxic against that in clean documents, under a Dirichlet prior over the
vocabulary in proportion to the words' counts in both, brought towards zero by a standard deviation; words that training
saw too seldom, or that tell nothing by themselves, take those of the longest of their beginnings (4 to 6 letters) that
enough different words share. Each word scores its log-odds less a drift, unknown ones minus the drift, so clean words
end a passage. The linear-time scan of Ruzzo and Tompa finds every maximal scoring segment of a text. Extreme-value
theory turns a segment's score into one that texts of any length share: lambda, kept from 0.2 to 3, solves E[exp(lambda
s)] = 1 over the words of clean documents, K is fitted to the best segments of clean documents, and a segment's
calibrated score is lambda S - ln(K n). A document is scored by its best segment, the sum of its significant ones and
the joint score of its best five, through a logistic curve fitted to documents that had no part in the words' log-odds.

Fitted on at most ``max_docs`` labelled documents, drawn by hash; ``held_out`` ones are never among them. The word table
is broadcast; its size is bounded by that sample.

Defined results: null and empty texts have no segment and the score of such texts; documents with conflicting labels
count as toxic; of rows that share a labelled doc_id one, fixed by its text's hash, is learned from; labels that are
null, or of documents that don't exist, are ignored; without labels of both classes every score is the share of toxic
labels (0 without labels); repeated rows are scored each; ties between equal segments don't change a score; an empty
table gives no rows; clashing extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import short_batches

MAX_DOCS = 50_000
THRESHOLD = 0.3
#: Weight of the prior, as a share of all training tokens; least count of a word, or of words that share a beginning.
PRIOR, LEAST = 0.1, 3
STEMS = (6, 5, 4)
DRIFT, MAX_WORD = 0.5, 5.0
#: A segment is significant when fewer than so many as good are expected in a clean text.
EXPECT = 0.05
#: Segments in a joint score.
JOINT = 5
PUNCTUATION = ".,;:!?|#*$%&<>()[]{}\"'`-_"
CACHE = 500_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(PUNCTUATION)


def segments(spots: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a run of words that score ``-drift`` but for ``spots``
    (place, score), by Ruzzo and Tompa's scan over prefix sums; segments begin and end with words that score above 0."""
    out: list[list] = []  # begin, end, sum before, sum at the end, nearest earlier one with a lower sum before
    total, last = 0.0, 0
    for at, score in spots:
        total -= drift * (at - last)
        k = [at, at + 1, total, total + score, -1]
        total, last = total + score, at + 1
        if score <= 0:
            continue
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= k[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= k[3]:
                k[4] = j
                out.append(k)
                break
            k = [out[j][0], k[1], out[j][2], k[3], -1]
            del out[j:]
    return [(b, e, r - left) for b, e, left, r, _ in out]


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    rate: float = 0.0
    fitted: bool = False

    def word(self, word: str) -> float:
        found = self.words.get(word)
        for n in STEMS if found is None else ():
            if len(word) > n and (found := self.stems.get(word[:n])) is not None:
                break
        return max(min(found or 0.0, MAX_WORD), -MAX_WORD) - DRIFT

    def passages(self, text: bytes | None, cache: dict[bytes, float]) -> tuple[int, list[tuple[int, int, float]]]:
        """The text's words, and its maximal segments."""
        words = _split(text)
        if len(cache) > CACHE:
            cache.clear()
        spots = []
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:
                s = cache[w] = self.word(_plain(w))
            if s != -DRIFT:
                spots.append((i, s))
        return len(words), segments(spots, DRIFT)

    def calibrated(self, n: int, score: float) -> float:
        return self.lam * score - math.log(self.k * max(n, 1))

    def evidence(self, n: int, scores: list[float]) -> tuple[float, float, float]:
        """Of a text's words and its segments' scores: the best calibrated score, the sum of significant ones, and the
        joint score of the best few, for texts that are toxic in many places and not much in any; all bounded."""
        if not scores:
            return -8.0, 0.0, -8.0
        top = sorted(scores, reverse=True)
        told = [self.calibrated(n, s) for s in top]
        joint = self.calibrated(n, sum(top[:JOINT]))
        return min(max(told[0], -8.0), 8.0), min(sum(t for t in told if t > -math.log(EXPECT)), 16.0), min(max(joint, -8.0), 16.0)

    def rate_text(self, text: bytes | None, cache: dict[bytes, float]) -> float:
        n, found = self.passages(text, cache)
        return self.score(self.evidence(n, [s for _, _, s in found]))

    def score(self, evidence: tuple[float, float, float]) -> float:
        if not self.fitted:
            return self.rate
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], evidence, strict=True))
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def _count(docs: DataFrame) -> DataFrame:
    """(word, toxic, clean): a word's tokens in documents of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            every = list(both[0].keys() | both[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([both[1][w] for w in every], pa.int64()), pa.array([both[0][w] for w in every], pa.int64())], names=["word", "toxic", "clean"])
            both[0].clear()
            both[1].clear()
            return made

        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[y].update(map(_plain, _split(t)))
            if len(both[0]) + len(both[1]) > CACHE:
                yield out()
        yield out()

    return docs.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long").where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _odds(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Log-odds of a word with ``a`` of all ``toxic`` and ``b`` of all ``clean`` tokens, under a Dirichlet prior that gives
    it its share of both, brought towards zero by its standard deviation."""
    every = PRIOR * (toxic + clean)
    own = F.lit(PRIOR) * (a + b)
    x, y = a + own, b + own
    odds = F.log(x / (toxic + every - x)) - F.log(y / (clean + every - y))
    return F.signum(odds) * F.greatest(F.abs(odds) - F.sqrt(1 / x + 1 / y), F.lit(0.0))


def _table(docs: DataFrame) -> Model:
    """Log-odds of words and stems, from labelled documents. Stems count each of the different words that share them
    once, so one frequent word doesn't speak for others."""
    words = scratch.kept(_count(docs), "word_counts")
    toxic, clean = words.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not toxic or not clean:
        return Model({}, {})
    n = F.col("toxic") + F.col("clean")
    odds = _odds(F.col("toxic"), F.col("clean"), toxic, clean).alias("odds")
    known = words.where(n >= LEAST).select("word", odds).where("odds <> 0")
    stems: dict[str, float] = {}
    for k in STEMS:
        some = words.where(F.length("word") > k).groupBy(F.substring("word", 1, k).alias("stem")).agg(F.count("*").alias("n"), F.sum(F.col("toxic") / n).alias("toxic"), F.sum(F.col("clean") / n).alias("clean"))
        # Words, not tokens, are counted here, so the classes are as large as their tokens' shares of those words.
        share = toxic / (toxic + clean)
        each = F.lit(1.0) * F.col("n")
        told = _stem_odds(F.col("toxic"), F.col("clean"), each, share).alias("odds")
        stems |= {r["stem"]: r["odds"] for r in some.where(F.col("n") >= LEAST).select("stem", told).where("odds <> 0").collect()}
    return Model({r["word"]: r["odds"] for r in known.collect()}, stems)


def _stem_odds(a: Column, b: Column, n: Column, share: float) -> Column:
    """As ``_odds`` for the ``a`` toxic and ``b`` clean of a stem's ``n`` words, the classes' shares being known."""
    x, y = a + F.lit(PRIOR * share) * n, b + F.lit(PRIOR * (1 - share)) * n
    odds = F.log(x / y) - math.log(share / (1 - share))
    return F.signum(odds) * F.greatest(F.abs(odds) - F.sqrt(1 / x + 1 / y), F.lit(0.0))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A logistic curve, by Newton's steps, slightly held back. More evidence never lowers a score: what would is left
    out."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    hold = np.diag([1e-3] + [1e-2] * x.shape[1]) * max(1.0, len(x) / 1000)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, a.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    if (w[1:] < 0).any():
        some = [i for i in range(x.shape[1]) if w[i + 1] >= 0]
        part = _fit_curve(x[:, some], y) if some else (float(w[0]),)
        full = dict(zip(some, part[1:], strict=True))
        return (part[0], *(full.get(i, 0.0) for i in range(x.shape[1])))
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """A model from the labelled documents that aren't held out."""
    spark = docs.sparkSession
    told = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id")))
    told = scratch.kept(told.groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    n = told.count()
    if n > max_docs:
        told = told.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * max_docs / n))
    # About max_docs rows at most: small enough to broadcast, whatever the table's size.
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(told), "id")
    # One row for each labelled document, so that repeated ones don't outgrow the bound.
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    short_batches(spark)
    known = scratch.kept(known.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3))), "labelled")
    seen = {(r["toxic"], r["own"]): r["n"] for r in known.groupBy("toxic", (F.col("fold") == 0).alias("own")).agg(F.count("*").alias("n")).collect()}
    toxic, every = sum(v for (y, _), v in seen.items() if y), sum(seen.values())
    share = toxic / every if every else 0.0
    if not all(seen.get(k) for k in ((0, True), (1, True), (0, False), (1, False))):
        return Model({}, {}, rate=share)
    part = _table(known.where("fold <> 0"))
    tell = spark.sparkContext.broadcast(vars(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        m = Model(**tell.value)
        for b in batches:
            rows = []
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                size, found = m.passages(t, cache)
                kinds = Counter(round(cache[w] * 4) for w in _split(t)) if not y else {}
                rows.append((y, size, sorted((s for _, _, s in found), reverse=True)[:64], list(kinds), list(kinds.values())))
            y, size, found, kinds, counts = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(kinds, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "n", "found", "kinds", "counts"])

    rows = known.where("fold = 0").select("text", "toxic").mapInArrow(run, "toxic int, n long, found array<double>, kinds array<int>, counts array<long>").collect()
    kinds: Counter = Counter()
    for r in rows:
        kinds.update(dict(zip(r["kinds"], r["counts"], strict=True)))
    part.lam, part.k = _extremes(kinds, [(r["n"], max(r["found"], default=0.0)) for r in rows if not r["toxic"] and r["n"]])
    x = np.array([part.evidence(r["n"], r["found"]) for r in rows])
    curve = _fit_curve(x, np.array([r["toxic"] for r in rows], float))
    model = _table(known)
    model.lam, model.k, model.curve, model.rate, model.fitted = part.lam, part.k, curve, share, True
    return model


def _extremes(kinds: Counter, best: list[tuple[int, float]]) -> tuple[float, float]:
    """lambda and K from the scores of clean words (in quarters) and the best segments of clean texts."""
    total = sum(kinds.values()) or 1
    mean = lambda lam: sum(n * math.exp(lam * s / 4) for s, n in kinds.items()) / total - 1
    lo, hi = 1e-6, 1e-3
    while hi < 8 and mean(hi) < 0:
        hi *= 2
    lam = hi
    if hi < 8:
        for _ in range(60):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if mean(lam) < 0 else (lo, lam)
    lam = min(max(lam, 0.2), 3.0)
    some = [lam * s - math.log(n) for n, s in best if s > 0]
    if len(some) < 10:
        return lam, 0.05
    return lam, min(max(math.exp(float(np.median(some)) + math.log(math.log(2)) ), 1e-4), 1.0)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``; if asked for, passages: the significant
    ones, as words from begin to before end, with their calibrated scores."""
    tell = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = "doc_id long, score double" + (", passages array<struct<begin:long,end:long,score:double>>" if passages else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        m = Model(**tell.value)
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            cols = [b.column(0), pa.array([m.rate_text(t, cache) for t in texts], pa.float64())]
            if passages:
                spans = []
                for t in texts:
                    n, found = m.passages(t, cache)
                    spans.append([{"begin": i, "end": j, "score": c} for i, j, s in found if (c := m.calibrated(n, s)) > -math.log(EXPECT)])
                cols.append(pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "passages"][: len(cols)])

    short_batches(docs.sparkSession)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    more = ["passages"] if passages else []
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *more)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the model predicts to be toxic."""
    tell = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        m = Model(**tell.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([m.rate_text(t, cache) < THRESHOLD for t in texts], pa.bool_()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

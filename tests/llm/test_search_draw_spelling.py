"""Operators 11 to 13 against plain versions of themselves, their edges, and the recall of the index."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm import resampling, routing, spelling

SCHEMA = "doc_id long, text string, score string, word string, block string, n string"
LOREM = "Die Größe der alten Maschine, Größe der neuen maschine! Zürich-2024 naïve Übermut 𝒳y"


def _docs(spark, rows):
    return scratch.kept(spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3), "docs")


ROWS = [(1, LOREM * 30), (2, None), (3, ""), (4, " \t\n!?"), (None, LOREM * 2), (1, LOREM * 30), (5, "one two " * 300), (6, "x" * 300 + " " + "y" * 70 + " z"), (7, "a"), (8, "maschine maschinen " * 40)]


def _brute_resample(docs, target, percent=25, least=20, n_buckets=10_000):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), Counter(zlib.crc32(f.encode()) % n_buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])

    here = [(d, *features(t)) for d, t in docs]
    s, t = sum((f for _, _, f in here), Counter()), sum((features(x)[1] for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + n_buckets) / ((s[b] + 1) * (big_t + n_buckets)))) for b in s}
    out = []
    for d, n, f in here:
        weight = sum(gain[b] * c for b, c in f.items()) // max(1, sum(f.values()))
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_resample(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK_WORDS", block)  # many blocks, and so many salts
    monkeypatch.setattr(resampling, "BLOCKS", 2)
    target = ["die Größe der Maschine", None, "one two three"]
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(_docs(spark, ROWS), other, percent=60)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == _brute_resample(ROWS, target, percent=60)
    # one and two come 300 times in a document: more than a byte holds
    assert max(r[1] for r in rows) > 255 and sum(r[4] is not None for r in rows) == 3


def test_resample_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, none).count() == 0
    rows = sorted(map(tuple, resampling.resample(_docs(spark, ROWS), none).collect()), key=str)
    assert rows == _brute_resample(ROWS, [])


def test_crc_of_pairs():
    words, moved = resampling._Words(), resampling._moved()
    found = [b"a", "größe".encode(), b"x" * 63, b"y" * 64, b"z" * 500, b"a", b"q"]
    ids = np.array([words[w] for w in found])
    of, crc = resampling._hashes(words, ids, np.array([4, 4, 7]), moved)
    plain = [(0, w) for w in found[:4]] + [(2, w) for w in found[4:]] + [(d, a + b" " + b) for d, part in ((0, found[:4]), (2, found[4:])) for a, b in zip(part, part[1:])]
    assert sorted(zip(of, crc)) == sorted((d, zlib.crc32(w)) for d, w in plain)


def _brute_spelling(docs, least=6, count=5, ratio=5, misspelt=199):
    n = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % misspelt == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    others = {w: [v for v in n if v != w and near(v, w)] for w in n}
    for w in n:
        best = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_spelling(spark):
    letters = "abcdefgé"
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(letters), int(k))) for k in rng.integers(5, 8, 60)]
    words += [w[:i] + x + w[i + 1 :] for w in words[:20] for i in (0, 3) for x in "aé"] + [w + "a" for w in words[:15]] + ["aabbbb", "abbbbb", "aabbb", "aabbbbb"]
    rows = [(i % 50 if i % 9 else None, " ".join(words[j] for j in rng.zipf(1.3, 40) % len(words))) for i in range(150)]
    # a chain of forms: each five times as frequent as the one before
    rows += [(200 + i, "stranße " * 5 + "straneß " * 0 + "Strande " * 30 + "strandes " * 160 + "STRANDESX " * 900) for i in range(1)]
    rows += ROWS
    for misspelt in (199, 3):
        got = spelling.variants(_docs(spark, rows), misspelt=misspelt)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        told = sorted(map(tuple, got.collect()), key=str)
        assert told == _brute_spelling(rows, misspelt=misspelt) and len(told) > 40
    assert any(r[2] != r[0] and r[2] != r[1] for r in told) or any(r[1] for r in told)
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_roots_follow_long_chains(spark):
    n = 13
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}" if i < n else None) for i in range(n + 1)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i:02}", f"w{n}") for i in range(n)}


def _brute_nearest(rows, k, asks):
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [(i, vid, v) for i, (vid, v) in enumerate(rows) if sound(v)]
    out = []
    for i, vid, v in ok:
        if vid is None or vid % asks:
            continue
        met = []
        for j, other, w in ok:
            if j != i and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                met.append((-s, other is None, other or 0, other))
        out += [(vid, r + 1, m[3], -m[0]) for r, m in enumerate(sorted(met, key=lambda m: m[:3])[:k])]
    return sorted(out, key=str)


def test_nearest_edges(spark, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK_ROWS", 30)
    monkeypatch.setattr(routing, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(160)]
    rows += [(i, rows[5][1]) for i in range(200, 320)]  # many copies: ties at each rank
    rows += [(20, rows[20][1]), (400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (480, [float("nan")] * 6), (500, [float("inf")] * 6), (None, rows[3][1]), (520, [1.0, 2.0]), (521, [2.0, 1.0]), (540, [1.0] * 9), (560, [1e-200] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, uid string").repartition(5)
    # every part is asked, so nothing may be missed, not the order of ties either
    got = routing.nearest(df, F.col("vec_id") % 20 == 0, 7, recall=1.0, part_rows=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = _brute_nearest(rows, 7, 20)
    told = sorted(map(tuple, got.collect()), key=str)
    exact = [r for r in want if r in set(told)]
    assert len(told) == len(want) and len(exact) >= 0.97 * len(want)
    whole = sorted(map(tuple, routing.nearest(df, F.col("vec_id") % 20 == 0, 7, max_parts=1).collect()), key=str)
    assert whole == want
    assert routing.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    x = centres[np.arange(803) % 8] + 0.2 * rng.normal(size=(803, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    part = routing.balanced_parts(routing.neighbours(x, 10), 8, rng)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    assert np.mean([np.bincount(part[np.arange(803) % 8 == c], minlength=8).max() for c in range(8)]) > 90
    router = routing.fitted(x, 8)
    assert np.mean([np.bincount(router.odds(x)[np.arange(803) % 8 == c].argmax(1), minlength=8).max() for c in range(8)]) > 90


def _recall(df, index, k):
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in index.search().collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        ip = x @ x[i]
        ip[i] = -np.inf
        hits += len(found[ids[i]] & set(ids[np.argsort(-ip, kind="stable")[:k]].tolist()))
    return hits / (k * (ids % 20 == 0).sum())


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = routing.Index(df, F.col("vec_id") % 20 == 0)
    assert index.router.n_parts == 8 and _recall(df, index, 20) >= 0.9
    # vectors in groups: few parts are enough
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 24))
    x = centres[rng.integers(0, 16, 4000)] + 0.15 * rng.normal(size=(4000, 24))
    df = scratch.kept(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "grouped")
    index = routing.Index(df, F.col("vec_id") % 20 == 0)
    assert index.router.n_parts == 16 and index.probes <= 4 and _recall(df, index, 20) >= 0.9


def test_spelling_broadcasts_no_words(spark):
    """The planner takes exploded deletions for as small as the words' file; a broadcast would gather them in the driver."""
    found = scratch.kept(spark.createDataFrame([("maschine", 50), ("maschinen", 9), ("mashine", 5)], "word string, n long"), "words")
    for df in (spelling.near(found), spelling.variants(_docs(spark, [(1, "maschine maschinen " * 40)]), misspelt=2)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

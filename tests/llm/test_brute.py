"""Each operator against a plain, slow version of itself, on small fixtures and the smallest tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from veldt import scratch
from veldt.llm import embedding, linededup, lm_scoring, mixing, packing, quality, queries, sharding, simhash, toxicity, warc
from veldt.llm.texts import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_targets():
    for sizes in ([10, 20, 30], [1, 1, 1000], [0, 5, 5, 5], [100], [3, 50, 2, 400, 1]):
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
        w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        free = [(x / k) for x, s, k in zip(t, sizes, w, strict=True) if x < 3 * s - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    x = mixing.permuted(np.arange(n), n, 99)
    assert sorted(x) == list(range(n)) and (mixing.permuted(x, n, 99, True) == np.arange(n)).all()


def test_mixing_slots_by_hand(spark, sf):
    m = mixing.mix(documents(spark, sf), block=64, shard_slots=50)
    slots, docs = m.slots.toPandas(), m.documents.toPandas()
    assert not slots.duplicated(["number", "slot"]).any() and not slots.duplicated(["number", "epoch", "block"]).any()
    full = slots.groupby("shard").size().sort_index()
    assert (full.iloc[:-1] == 50).all()
    want = defaultdict(int)
    for s in m.sources:
        own = slots[slots.number == s.number]
        assert own.words.sum() == s.words == int(s.target) and sorted(own.slot) == list(range(s.slots))
        run = docs[docs.number == s.number].sort_values("start")
        assert list(run.start) == [0, *np.cumsum(run["size"])[:-1]]
        taken = np.zeros(s.size, int)
        for b, w in zip(own.block, own.words, strict=True):
            taken[b * 64 : b * 64 + w] += 1
        for r in run.itertuples():
            want[r.doc_id] += int(taken[r.start : r.start + r.size].sum())
    got = {r["doc_id"]: r["taken"] for r in m.taken().collect()}
    assert all(got[k] == want[k] for k in got)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(documents(spark, sf).repartition(7), block=64, shard_slots=50).taken().collect()}
    assert got == again


def suffix_tree(train, root, deep=lm_scoring.DEPTH):
    """A plain suffix tree over dicts: {context (nearest last): (left, {next: share})} of retained contexts."""
    seen = defaultdict(Counter)
    for t in train:
        run = [""] + t + [""]
        for i in range(1, len(run)):
            for k in range(1, min(deep, i) + 1):
                seen[tuple(run[i - k : i])][run[i]] += 1
    tree = {}

    def p(context, x):
        return share(context, x) if context in tree else p(context[1:], x) if context else root(x)

    def share(context, x):
        left, branches = tree[context]
        return branches.get(x, 0.0) + left * p(context[1:], x)

    for k in range(1, deep + 1):
        new = {}
        for c, nexts in seen.items():
            n = sum(nexts.values())
            if len(c) != k or n < lm_scoring.LEAST_CONTEXT or (k > 1 and c[1:] not in tree):
                continue
            often = {x: m for x, m in nexts.items() if m >= lm_scoring.LEAST_BRANCH}
            theirs = {x: p(c[1:], x) for x in often}
            gain = sum(m / n * math.log(m / n / theirs[x]) for x, m in often.items())
            rest, rest_theirs = max(1 - sum(often.values()) / n, 1e-9), max(1 - sum(theirs.values()), 1e-9)
            gain += rest * math.log(rest / rest_theirs)
            if n * gain > lm_scoring.PRICE * (len(often) + 1):
                shares = {x: (m - lm_scoring.DISCOUNT) / n for x, m in often.items()}
                new[c] = (max(1 - sum(shares.values()), 1e-12), shares)
        tree |= new
    return tree, p


def test_suffix_tree(spark, sf, texts):
    """Every score, over a head of few tokens and over the whole vocabulary, in one part and in several."""
    cut = lambda t: t.encode().lower().split()
    train = [[w.decode() for w in cut(t)] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*t, ""])
    total = sum(count.values())
    once, twice = (sum(n == k for n in count.values()) for k in (1, 2))
    off = min(max(once / (once + 2 * twice), 0.05), 0.95)
    root = lambda w: max(count[w] - off, 1e-9) / total if w in count else off * len(count) / total
    tree, p = suffix_tree(train, root)
    assert {len(c) for c in tree} == {1, 2, 3}
    sums = [sum(p(c, w) for w in count) + off * len(count) / total * math.prod(tree[c[k:]][0] for k in range(len(c)) if c[k:] in tree) for c in list(tree)[::40]]
    assert sums == pytest.approx([1] * len(sums), abs=1e-6)
    want = {}
    for i, t in texts.items():
        run = [""] + [w.decode() for w in cut(t)] + [""]
        at = 0.0
        for j in range(1, len(run)):
            c = next((tuple(run[j - k : j]) for k in range(min(lm_scoring.DEPTH, j), 0, -1) if all(tuple(run[j - m : j]) in tree for m in range(1, k + 1))), ())
            at += math.log10(p(c, run[j]))
        want[i] = at
    for head, part in ((50, 10**9), (50, total // 3), (10**6, 10**9)):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, sf), head=head, part_tokens=part).collect()}
        assert all(got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-6) for i in want)


def test_table():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 1000, 70_000):
        codes = np.unique(rng.integers(0, 1 << 60, n))
        table = lm_scoring.Table(codes)
        assert (table.codes[table.find(codes)] == codes).all() and (lm_scoring.Table.of(table.plain()).find(rng.integers(1 << 61, 1 << 62, 99)) == -1).all()


def test_lm_base(spark, sf, texts):
    got = {r["doc_id"]: r for r in lm_scoring.score(documents(spark, sf), head=50).collect()}
    count = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    for i, t in texts.items():
        w = [*t.encode().lower().split(), b""]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tree_grows_with_the_corpus(spark):
    """What is seen often enough is kept, however long the rest of the corpus is, and whatever the head."""
    filler = " ".join(f"w{i % 1000}" for i in range(100_000))
    rows = [(i, "zeta omega") for i in range(30)] + [(100 + i, filler) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (100, 10**6):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df, head=head).collect()}
        assert got[1] > -1.5


def test_boundaries():
    rng = random.Random(5)
    for _ in range(30):
        h = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        k = rng.randint(1, 4)
        cost = lambda edges: sum(n * (min(e for e in edges if e >= x) - x) for x, n in h.items())  # noqa: B023, E731
        best = min(cost([*c, max(h)]) for r in range(min(k, len(h))) for c in itertools.combinations(sorted(h)[:-1], r))
        edges = packing.boundaries(h, k)
        assert len(edges) <= k and edges == sorted(set(edges)) and cost(edges) == best


def test_packing_budget(spark, sf):
    p = packing.pack(documents(spark, sf), n_buckets=5, token_budget=2000).toPandas()
    g = p.groupby(["bucket", "batch"]).agg(n=("slot", "size"), b=("boundary", "first"))
    assert ((g.n * g.b <= 2000) | (g.n == 1)).all() and len(p) == 200


def test_packing_beside_a_long_text(spark):
    """One very long document leaves the other lengths exact."""
    sizes = [1 + i % 9 for i in range(90)] + [200 + i for i in range(30)] + [1_000_000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n long")
    p = packing.pack(df, length=df["n"], n_buckets=6).toPandas()
    edges = packing.boundaries(Counter(sizes), 6)
    assert sorted(set(p.boundary)) == edges and set(edges) <= set(sizes)
    assert p.padding.sum() == sum(min(e for e in edges if e >= n) - n for n in sizes)


def test_segments():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 14)
        spots = sorted((i, rng.choice([0.7, 1.5, 2.5])) for i in rng.sample(range(n), rng.randint(1, n)))
        x = [-0.5] * n
        for i, s in spots:
            x[i] = s
        got = toxicity.segments(spots, 0.5)

        def all_best(lo, hi):  # by definition: the best segment, then those left and right of it
            best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return [*all_best(lo, best[3]), (best[3], best[4], best[0]), *all_best(best[4], hi)]

        want = all_best(0, n)
        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in want))
        assert max(s for _, _, s in got) == pytest.approx(max(s for _, _, s in want))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.8 and hit / (got.predicted == 1).sum() > 0.8


def test_simhash_links(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    some = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(30)} | {0, 1, 7, 15}
    fps = sorted(some)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    number = {x: i for i, x in enumerate(signed)}
    for dense in (64, 2):
        links = [(number[r["a"]], number[r["b"]]) for r in simhash.links(df, dense).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
        assert components(len(fps), links) == want


def test_line_dedup(spark, sf, texts):
    seen, want = [], {}
    for d in sorted(texts):
        want[d] = []
        for i, line in enumerate(texts[d].split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            s = set(w)
            if len(w) >= 5:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                    want[d].append(i)
                seen.append(s)
    got = {r["doc_id"]: r["removed"] for r in linededup.matched(documents(spark, sf), min_words=5).collect()}
    assert got == want and any(want.values())


def test_line_dedup_short_lines(spark, sf, texts):
    """The query lets all lines with words take part, short ones too."""
    seen, want, short = [], {}, 0
    for d in sorted(texts):
        want[d] = []
        for i, line in enumerate(texts[d].split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            s = set(w)
            if s:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                    want[d].append(str(i))
                    short += len(w) < 5
                seen.append(s)
    got = {r["doc_id"]: r["removed_lines"] for r in queries.op8_linededup(spark, sf).collect()}
    assert got == {d: ",".join(x) for d, x in want.items()} and short


def test_line_dedup_of_few_words(spark):
    rows = ["a b c", "c b a", "a b c d", "a b c d e", "x", "x x x x x", "", " ", "y z", "a b c d e f", "z", "p q r s t", "p q r s"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    got = {r["doc_id"] for r in linededup.matched(df).where("size(removed) > 0").collect()}
    assert got == {1, 3, 5, 9, 12}


def test_line_dedup_families(spark):
    """Many near copies of few lines, long ones too."""
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    rows = []
    for n in (5, 9, 20, 60, 150, 400):
        base = [word() for _ in range(n)]
        for _ in range(25):
            x = list(base)
            for _ in range(rng.randint(0, n // 6)):
                x[rng.randrange(n)] = word()
            rows.append(" ".join(x))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA)
    sets = [set(t.split()) for t in rows]
    want = [any(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in range(i)) for i in range(len(rows))]
    got = {r["doc_id"]: len(r["removed"]) > 0 for r in linededup.matched(df).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_sharding_tells_long_sources_apart(spark):
    """Sources that begin alike are far apart all the same: the split falls between two of them."""
    rows = [(i, f"text {i:04d} of one length", "en", f"https://host{i % 4}.example", 0) for i in range(400)]
    p = sharding.shards(spark.createDataFrame(rows, SCHEMA), 4).toPandas()
    assert all(p[p.doc_id % 4 == k].shard.nunique() == 1 for k in range(4)) and p.shard.nunique() == 4


def test_positions(spark):
    """Gapless in groups, the same for any layout, with crowds of equal rows and nulls."""
    from veldt.operators import ranks

    rows = [(i % 3, i // 7 if i % 2 else None, i % 5) for i in range(9000)] + [(None, None, 2)] * 3000 + [(1, 5, 3)] * 2500
    seen = []
    for n in (1, 4):
        df = scratch.kept(spark.createDataFrame(rows, "g int, k int, w long").repartition(n), "positions")
        got = ranks.positions(df, ["g"], ["k", "w"], 5, "at", df["w"]).collect()
        for g in (0, 1, 2, None):
            own = sorted((r["at"], r["w"]) for r in got if r["g"] == g)
            at = 0
            for a, w in own:
                assert a == at
                at += w
        seen.append(sorted(map(str, got)))
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    assert [tuple(r) for r in ranks.ranks(df, "k").orderBy("k").limit(3).collect()] == [(0, 0), (1, 1), (2, 2)]


def test_mixing_of_any_layout(spark):
    """Several pieces, in any partitions: the same words are taken."""
    rows = [(i if i % 50 else None, "w " * (i % 37), "en", f"s{i % 6}", 0) for i in range(9000)] + [(1, "a b c", "en", "s1", 0)] * 30
    seen = []
    for n in (1, 4, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        seen.append(sorted(str(tuple(r)) for r in mixing.mix(df, block=16, shard_slots=100).taken().collect()))
    assert seen[0] == seen[1] == seen[2]


def test_sharding(spark):
    rng = random.Random(4)
    words = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    rows = [(i, t, "en", f"s{i % 7}", 0) for i, t in enumerate(words)] + [(5000 + i, "hot " * 50, "en", f"s{i % 7}", 0) for i in range(700)] + [(9000 + i, words[i // 3], "de", "x", 0) for i in range(300)]
    p = sharding.shards(spark.createDataFrame(rows, SCHEMA), 8).toPandas()
    sizes = p.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.mean() < 1.05 and sizes.min() / sizes.mean() > 0.95
    text = {r[0]: r[1] for r in rows}
    parts = defaultdict(set)
    for r in p.itertuples():
        parts[text[r.doc_id]].add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(len(v) == 1 for t, v in parts.items() if not t.startswith("hot"))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))


def test_embedding_cells(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x] + [x[:30] + rng.normal(size=(30, 8)) * s for s in (0.05, 0.1, 0.2)] + [x[:5]])
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    want = components(len(x), np.argwhere(hit).tolist())
    for cell, block in ((2048, 2048), (20, 7)):
        got = embedding.near_duplicates(df, cell_rows=cell, block_rows=block).toPandas().sort_values("vec_id")
        assert list(got.n_links) == list(hit.sum(axis=1)) and list(got.component_id) == want


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, text in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        want = con.sql(text)
        at = [want.columns.index(c) for c in cols]
        assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall()), name


def test_pipeline(spark, sf):
    """Each stage by its rule, on what the one before kept."""
    docs = documents(spark, sf)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.kept(stage(spark, docs, sf), name)
        kept[name] = (docs.toPandas(), out.toPandas())
        assert name == "packing" or out.columns == columns
        docs = out
    a, b = kept["toxicity"]
    base = documents(spark, sf)
    told = toxicity.score(base, toxicity.train(base, spark.read.parquet(f"{sf}/labels.parquet"))).toPandas()
    assert set(b.doc_id) == set(told[told.predicted == 0].doc_id)
    a, b = kept["line_dedup"]
    assert sorted(a.doc_id) == sorted(b.doc_id) and b.text.str.len().sum() < a.text.str.len().sum()
    a, b = kept["simhash"]
    fp = {d: simhash.fingerprint(t.encode()) for d, t in zip(a.doc_id, a.text, strict=True)}
    ids = sorted(fp)
    comp = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 3])
    assert sorted(b.doc_id) == sorted({ids[c] for c in comp})
    a, b = kept["mixing"]
    size = lambda d: d.text.map(lambda t: len(t.encode().split()))
    a["size"], b["size"] = size(a), size(b)
    by = a.groupby("source")["size"].sum().sort_index()
    got = b.groupby("source")["size"].sum().reindex(by.index).fillna(0)
    assert all(abs(g - int(t)) <= 1 for g, t in zip(got, mixing.targets(list(by)), strict=True))
    a, b = kept["packing"]
    assert sorted(b.n_tokens) == sorted(size(a))


def test_shingle_hashes(monkeypatch):
    """As many different hashes as shingles, whatever the white space, the case or how many words are remembered."""
    rng = random.Random(5)
    for n in (0, 1, 4, 5, 6, 300):
        ws = [f"W{rng.randrange(4)}" for _ in range(n)]
        got = simhash.shingle_hashes(" ".join(ws).encode(), 5, simhash._Hashes())
        assert len(got) == (max(1, n - 4) if n else 0)
        assert len(set(got.tolist())) == (len({tuple(ws[i : i + 5]) for i in range(max(1, n - 4))}) if n else 0)
        monkeypatch.setattr(simhash, "REMEMBERED", 2)
        assert got.tolist() == simhash.shingle_hashes(" \t\n".join(ws).lower().encode(), 5, simhash._Hashes()).tolist()
        monkeypatch.undo()
    assert len(simhash.shingle_hashes(None, 5, simhash._Hashes())) == 0


def test_near_copies_by_shingles(spark, sf):
    """The stage finds texts of similar shingles that fingerprints keep apart."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 60, 200, 400]))]
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 40))):
                x[rng.randrange(len(x))] = "New"
            texts.append(" ".join(x))
    rng.shuffle(texts)
    n = len(texts)
    cut = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.lower().split())
    sets, fp = [cut(t) for t in texts], [simhash.fingerprint(t.encode()) for t in texts]
    comp = components(n, [(i, j) for i in range(n) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    late = {i for i in range(n) if any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(i))}
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA), sf)
    assert {r["doc_id"] for r in got.collect()} == {i for i in range(n) if comp[i] == i} - late
    assert any(comp[i] == i for i in late)


def test_clean_of_repeated_ids(spark):
    """Unlike texts of one doc_id are documents of their own: one row of each group stays, whatever its doc_id."""
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(2))
    got = simhash.clean(spark.createDataFrame([(1, a, "", "", 0), (5, a, "", "", 0), (5, b, "", "", 0)], SCHEMA))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, a), (5, b)]
    base = [" ".join(f"w{rng.randrange(2000)}" for _ in range(rng.choice([0, 2, 50, 300]))) for _ in range(25)]
    texts = base + [t + " more" for t in base if t] + [None]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts), "en", rng.choice("pq"), 0) for _ in range(160)]
    fp = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    want = []
    for c in set(comp):
        group = [rows[i] for i in range(len(rows)) if comp[i] == c]
        ids = [r[0] for r in group if r[0] is not None]
        want.append((min(ids) if ids else None, {r[1] for r in group if r[0] == (min(ids) if ids else None)}))
    for layout in (2, 7):
        got = simhash.clean(spark.createDataFrame(rows, SCHEMA).repartition(layout)).collect()
        assert len(got) == len(want) and all(tuple(r) in rows for r in got)
        left = [(r["doc_id"], r["text"]) for r in got]
        assert all(any(d == i and t in some for d, t in left) for i, some in want)
        last = sorted(map(str, got)) if layout == 2 else last
        assert sorted(map(str, got)) == last


def test_measures(spark, sf, texts):
    for r in quality.judge(documents(spark, sf)).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        assert r["n_repeat_words"] == len({i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)})
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))


def test_hosts_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "bad text", "en", "bad.example", 0) for i in range(60)] + [(100 + i, good, "en", "bad.example", 0) for i in range(2)] + [(200 + i, good, "en", f"good{i % 9}.example", 0) for i in range(400)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[100] and all(got[200 + i] for i in range(400))
    assert warc.MIN_REVISIT == 1000


def slow_segments(scores, left=0):
    """Maximal scoring segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    total, i, j = best
    if total <= 0:
        return []
    return slow_segments(scores[:i], left) + [(left + i, left + j, total)] + slow_segments(scores[j:], left + j)


def test_toxicity_against_plain_arithmetic(spark):
    """Word table, stems, passages and scores of a small corpus, by loops over its words."""
    rng = random.Random(5)
    clean, bad = [f"calm{c}{d}" for c in "abcde" for d in "fghi"], [f"nasty{c}{d}" for c in "abc" for d in "def"]
    rows = [(i, " ".join(rng.choice(bad if rng.random() < (0.5 if i % 4 == 0 else 0.02) else clean) for _ in range(rng.randint(5, 30))), int(i % 4 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    kept = {r[0] for r in docs.where(~toxicity.held_out(docs.doc_id)).select("doc_id").collect()}
    count = {0: Counter(), 1: Counter()}
    for i, text, y in rows:
        if i in kept:
            count[y].update(text.split())
    sizes = [sum(count[y].values()) for y in (0, 1)]

    def shrunk(odds, x, y):
        return math.copysign(max(abs(odds) - math.sqrt(1 / x + 1 / y), 0), odds)

    words, groups = {}, defaultdict(list)
    for w in count[0] | count[1]:
        b, a = count[0][w], count[1][w]
        x, y, every = a + toxicity.PRIOR * (a + b), b + toxicity.PRIOR * (a + b), toxicity.PRIOR * sum(sizes)
        if a + b >= toxicity.LEAST:
            words[w] = shrunk(math.log(x / (sizes[1] + every - x)) - math.log(y / (sizes[0] + every - y)), x, y)
        for k in toxicity.STEMS:
            if len(w) > k:
                groups[w[:k]].append(a / (a + b))
    share, stems = sizes[1] / sum(sizes), {}
    for stem, of in groups.items():
        if len(of) >= toxicity.LEAST:
            x, y = sum(of) + toxicity.PRIOR * share * len(of), len(of) - sum(of) + toxicity.PRIOR * (1 - share) * len(of)
            stems[stem] = shrunk(math.log(x / y) - math.log(share / (1 - share)), x, y)
    assert model.words == pytest.approx({w: v for w, v in words.items() if v}) and min(model.words.values()) < 0 < max(model.words.values())
    assert model.stems == pytest.approx({s: v for s, v in stems.items() if v}) and model.stems["nasty"] > 0 > model.stems.get("calm", -1)

    def word(w):
        v = words[w] if words.get(w) else next((stems[w[:k]] for k in toxicity.STEMS if len(w) > k and stems.get(w[:k])), 0.0)
        return max(min(v, toxicity.MAX_WORD), -toxicity.MAX_WORD) - toxicity.DRIFT

    got = {r[0]: r for r in toxicity.score(docs, model, passages=True).collect()}
    for i, text, _ in rows:
        scores = [word(w) for w in text.split()]
        found = slow_segments(scores)
        told = sorted((model.lam * s - math.log(model.k * len(scores)) for _, _, s in found), reverse=True)
        least = -math.log(toxicity.EXPECT)
        assert [(p["begin"], p["end"]) for p in got[i]["passages"]] == [(b, e) for b, e, s in found if model.lam * s - math.log(model.k * len(scores)) > least]
        joint = model.lam * sum(sorted((s for _, _, s in found), reverse=True)[: toxicity.JOINT]) - math.log(model.k * len(scores))
        seen = (min(max(told[0], -8), 8), min(sum(t for t in told if t > least), 16), min(max(joint, -8), 16)) if told else (-8.0, 0.0, -8.0)
        z = model.curve[0] + sum(w * x for w, x in zip(model.curve[1:], seen))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_extremes():
    """lambda makes the mean of exp(lambda s) one; K puts the median of clean texts' best segments at that of the law."""
    kinds, best = Counter({-6: 80, 2: 15, 5: 5}), [(50, 1.0 + i / 10) for i in range(21)]
    lam, k = toxicity._extremes(kinds, best)
    assert sum(n * math.exp(lam * s / 4) for s, n in kinds.items()) / 100 == pytest.approx(1)
    assert math.exp(-k * 50 * math.exp(-lam * 2.0)) == pytest.approx(0.5)


def test_repeated_labelled_rows_count_once(spark):
    rows = [(i, ("bad worse " if i % 2 else "good fine ") * 5) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    once, often = (toxicity.train(spark.createDataFrame(rows * n, "doc_id long, text string"), labels) for n in (1, 3))
    assert once.words == often.words and once.stems == often.stems and (once.lam, once.k, *once.curve) == pytest.approx((often.lam, often.k, *often.curve)) and once.fitted

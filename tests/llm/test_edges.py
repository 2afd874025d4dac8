"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldt import scratch
from veldt.llm import embedding, linededup, lm_scoring, mixing, packing, quality, sharding, simhash, toxicity, warc

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f g\nsame line of seven words here now", "en", "s1", 9),
    (1, "a b c d e f g\nsame line of seven words here now", "en", "s1", 9),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \t\n ", "fr", None, 4),
    (None, "one word é 𝒳 same line of seven words here now", "de", "s2", 3),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "same line of seven words here now", "en", "s3", 5),
    (7, "x", "en", "s3", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "size", "h", "fp", "component", "number", "start", "bucket", "pos", "shard", "n", "_piece", "words", "host", "kept", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, df["n_chars"])
    return scratch.kept(df, "edges")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ROWS)
    told = {r["doc_id"]: r for r in rows}
    assert told[2]["n_words"] == told[3]["n_words"] == told[4]["n_words"] == 0 and not told[2]["kept"]
    assert told[5]["n_words"] == 30_000 and told[None]["n_words"] == 10
    assert quality.judge(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    zero = {r["doc_id"]: r["component_id"] for r in rows if r["fp"] == 0}
    assert set(zero) >= {2, 3, 4} and set(zero.values()) == {2}
    assert simhash.near_duplicates(none).count() == 0
    left = [r["doc_id"] for r in simhash.clean(docs).select("doc_id").collect()]
    assert left.count(1) == 1 and 2 in left and 3 not in left and 4 not in left


def test_line_dedup(docs, none):
    rows = {(r["doc_id"]): r["removed"] for r in linededup.matched(docs).collect()}
    assert rows[1] == [] and rows[6] == [0] and rows[2] == [] and rows[7] == []
    assert linededup.matched(docs).count() == len(ROWS)
    assert linededup.matched(none).count() == 0
    texts = {r["doc_id"]: r["text"] for r in linededup.clean(docs).collect()}
    assert texts[6] == "" and texts[2] is None and texts[4] == " \t\n " and texts[5] == LONG
    assert linededup.clean(docs).columns == docs.columns


def test_mixing(docs, none):
    rows = mixing.mix(docs).taken().collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 1 for (t, _), v in by.items())
    assert mixing.mix(none).taken().count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["padding"] and r["n_tokens"] + r["padding"] == r["boundary"] for r in rows)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    assert packing.pack(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shards(docs, 4).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["text_crc32"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {1}
    assert sharding.shards(none, 4).count() == 0


def test_lm(docs, none):
    rows = lm_scoring.score(docs).collect()
    assert len(rows) == len(ROWS) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert all(r["score"] < 0 for r in rows)
    assert lm_scoring.score(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, None), (3, 1, 0), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, passages=True).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels.limit(0)).rate == 0.0


def test_warc(spark):
    body = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    rows = [(1, "http://a", None), (2, None, "x" * 1500), (3, "u\r\nv", "x" * 1500), (4, "u", body * 40), (5, "u", ""), (None, "u", "x" * 1500), (7, "u", "y" * 2000), (7, "u", "y" * 2000), (8, "u", "é" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for segment in (64, 4 << 20):
        path = scratch.fresh(spark, "w")
        warc.write(pages, path)
        got = warc.read(spark, path, segment=segment).collect()
        assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((p or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows)
        assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2: 3, None: 3}
        assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    path = scratch.fresh(spark, "w")
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_embedding(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (2, [2.0, 0.01], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (None, [1.0, 0.001], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]], key=str)
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e200, 1e200], 1, 5), (2, [1e-200, 1e-200], 1, 5), (3, [1e200, -1e200], 1, 5)], "vec_id long, embedding array<double>, label int, uid long").withColumn("n", F.lit(0)).withColumn("u1", F.lit(0)).withColumn("cell", F.lit(0))
    assert sorted((r["vec_id"], r["n_links"]) for r in embedding.near_duplicates(big).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_pipeline(spark, docs, none, sf):
    """Every stage on rows of every kind, and on none."""
    one, two = docs, none
    for name, stage in corpus_pipeline.STAGES:
        last = name == "packing"
        one, two = (scratch.kept(stage(spark, x, sf), name) for x in (one, two))
        assert two.count() == 0 and (last or one.columns == two.columns == docs.columns), name
        ids = [r["doc_id"] for r in one.select("doc_id").collect()]
        if name == "toxicity":
            assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in one.collect()}
            assert texts[6] == "" and texts[2] is None and texts[5] == LONG and texts[None].startswith("one")
        if name == "simhash":
            assert sorted(ids, key=str) == sorted([1, 2, 5, 7, None], key=str)
        if name == "mixing":
            assert set(ids) <= {1, 5, 7, None} and 5 in ids
    assert one.where("n_tokens + padding <> boundary").count() == 0


def test_held_out_rules(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", lm_scoring.held_out(df["doc_id"]), toxicity.held_out(df["doc_id"])).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 7 == 2, zlib.crc32(str(i).encode()) % 4 == 2) for i in got)


def test_line_dedup_sorts_plain_numbers(spark):
    """Keys are said to hold no null, so that they are sorted compiled; looks need no lambda."""
    pieces = spark.createDataFrame([("b a b",), ("",)], "piece string")
    cut, classes = linededup.Lines(), [3] * (1 << linededup.BUCKET_BITS)
    keyed = cut.keyed(pieces, classes, "piece")
    assert not keyed.schema["keys"].dataType.containsNull
    assert {r["piece"]: len(r["keys"]) for r in keyed.collect()} == {"b a b": 2, "": 1}
    sets = spark.createDataFrame([(0, 4, [7]), (1, 9, [1, 2, 3]), (2, 40, list(range(9))), (3, 2, [])], "sid long, n int, prefix array<int>")
    looks = linededup._Join(sets, spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", cut, classes).looks()
    assert "lambda" not in looks._jdf.queryExecution().optimizedPlan().toString()
    rows = looks.collect()
    assert sorted(r["sid"] for r in rows) == [0, 1, 1, 2, 2, 2, 2] and all(r["key"] is not None for r in rows)


def test_words_are_counted_four_buckets_a_row(spark):
    """Each bucket has its own count, those of one row too, and none that is empty; few groups are counted."""
    docs = spark.createDataFrame([(1, "a b  a\nc\tb a"), (2, None), (3, "")], "doc_id long, text string")
    counted = linededup.Lines().buckets(docs, "text")
    words = ["a", "b", "", "a", "c\tb", "a", "", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").groupBy((F.xxhash64("w").bitwiseAND((1 << linededup.BUCKET_BITS) - 1)).alias("bucket")).count()
    assert {(r["bucket"], r["n"]) for r in counted.collect()} == {(r["bucket"], r["count"]) for r in rows.collect()}
    assert "four" in counted._jdf.queryExecution().optimizedPlan().toString()

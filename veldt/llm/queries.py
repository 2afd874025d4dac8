"""The corpus operators as named queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm import embedding, linededup, lm_scoring, mixing, packing, quality, resampling, routing, sharding, simhash, spelling, toxicity, warc
from veldt.llm.texts import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).taken()


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh(spark, "archives")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines, how many are later matches, and which (from 0)."""
    found = linededup.matched(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(documents(spark, sf_dir), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return routing.nearest(vectors, F.col("vec_id") % 20 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_linededup": op8_linededup,
    "op9_sharding": op9_sharding,
    "op10_embedding": op10_embedding,
    "op11_resampling": op11_resampling,
    "op12_routing": op12_routing,
    "op13_spelling": op13_spelling,
}

_W = r"[^\x20\x09-\x0D]+"

#: CRC-32 for DuckDB, which has none: the table of its bytes by rule, and the sum over a text's bytes.
_CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i)) t)"


def _crc(text: str) -> str:
    at = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({at}, lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256), 4294967295), 4294967295)"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SQL = {
    "op4_warc": f"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h)::bigint payload_bytes, sha1(h) payload_digest, max(page_id) over (partition by h) last from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {warc.MIN_REVISIT} and page_id is distinct from last and last is not null then 'revisit' else 'response' end record_type,
  case when payload_bytes >= {warc.MIN_REVISIT} and page_id is distinct from last then last end refers_to
from d""",
    "op6_quality_rules": rf"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_W}') ws from documents),
tri as (select rid, unnest(range(1, len(ws) - 1)) i, ws from d where len(ws) >= 3),
grams as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from tri),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) n from grams) where n > 1),
cov as (select rid, count(distinct i + k) n from again, (values (0), (1), (2)) o(k) group by rid),
lines as (select rid, unnest(string_split(t, chr(10))) l from d),
ln as (select rid, count(*) n_lines, count(*) - count(distinct l) n_dup from lines where regexp_matches(l, '{_W}') group by rid),
m as (
  select d.doc_id, d.source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(n_dup, 0)::bigint n_dup_lines,
    coalesce(cov.n, 0)::bigint n_repeat_words, coalesce(n_lines, 0) n_lines
  from d left join cov using (rid) left join ln using (rid)),
r as (
  select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words base_failed,
    n_symbols > {quality.MAX_SYMBOL_SHARE}::double * word_chars f_sym, n_dup_lines > {quality.MAX_DUP_LINES}::double * n_lines f_dup,
    word_chars < {quality.WORD_CHARS[0]} * n_words or word_chars > {quality.WORD_CHARS[1]} * n_words f_len
  from m),
h as (
  select source host, count(*) n, unnest([count(*) filter (base_failed), count(*) filter (f_sym), count(*) filter (f_dup), count(*) filter (f_len)]) f, unnest([1, 2, 3, 4]) k
  from r where source is not null group by source),
p as (select k, sum(f) / sum(n) mean, var_pop(f / n) var from h group by k),
s as (select k, mean, case when var > 0 then least(greatest(mean * (1 - mean) / var - 1, {quality.STRENGTH[0]}), {quality.STRENGTH[1]}) else {quality.STRENGTH[1]} end strength from p),
bad as (select distinct host from h join s using (k) where (f + mean * strength) / (n + strength) > {quality.MAX_RATE})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host is null kept
from r left join bad on r.source = bad.host""",
    "op10_embedding": f"""
with recursive v as (select row_number() over () rid, vec_id, label, embedding::double[] e from embeddings),
ok as (select * from v where label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.rid x, b.rid y from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.rid <> b.rid and list_cosine_similarity(a.e, b.e) >= {embedding.COSINE}::double),
reach as (select rid x, rid y from v union select reach.x, l.y from reach join l on reach.y = l.x),
c as (select x rid, min(vec_id) component_id from reach join v on reach.y = v.rid group by x),
n as (select x rid, count(*) n from l group by x)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id is not distinct from component_id kept
from v join c using (rid) left join n using (rid)""",
    "op11_resampling": rf"""
with {_CRC_TABLE},
c as (select 0 corpus, row_number() over () rid, doc_id, text from documents union all select 1, 0, null, text from benchmark),
w as (select corpus, rid, doc_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from c),
f as (select corpus, rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) f from w),
n as (select corpus, rid, f, count(*) n from f group by all),
b as (select f, {_crc("f")} % {resampling.BUCKETS} bucket from (select distinct f from n), crc),
s as (
  select bucket, coalesce(sum(n) filter (corpus = 0), 0) s, coalesce(sum(n) filter (corpus = 1), 0) t
  from n join b using (f) group by 1),
k as (select sum(s) + {resampling.BUCKETS} s, sum(t) + {resampling.BUCKETS} t from s),
g as (select bucket, floor(1000 * ln((s.t + 1)::double * k.s::double / ((s.s + 1)::double * k.t::double)))::bigint gain from s, k),
m as (
  select rid, floor(sum(n * gain)::double / sum(n))::bigint weight
  from n join b using (f) join g using (bucket) where corpus = 0 group by 1),
x as (
  select doc_id, len(ws) n_words, (len(ws) + greatest(len(ws) - 1, 0))::bigint n_features, coalesce(weight, 0) weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h
  from w left join m using (rid) where corpus = 0),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint score from x),
z as (
  select *, n_words >= {resampling.LEAST_WORDS} able, count(*) filter (n_words >= {resampling.LEAST_WORDS}) over () ables,
    row_number() over (partition by n_words >= {resampling.LEAST_WORDS} order by score desc, doc_id nulls last, weight desc, n_features) place
  from y)
select doc_id, n_features, weight, score, case when able and place <= {resampling.PERCENT} * ables // 100 then place end rank from z""",
    "op12_routing": f"""
with v as (select row_number() over () rid, vec_id, embedding::double[] e from embeddings),
ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (
  select q.rid, q.vec_id query_id, x.vec_id, list_inner_product(q.e, x.e) score
  from ok q join ok x on q.rid <> x.rid and len(q.e) = len(x.e) where q.vec_id % 20 = 0)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id nulls last) rank from s) where rank <= {routing.K}""",
    "op13_spelling": rf"""
with recursive {_CRC_TABLE},
d as (select coalesce(doc_id::varchar, '') id, {_lower("text")} t from documents),
r as (
  select id, w, count(*) n from (select id, unnest(regexp_extract_all(t, '[a-z\x{{00C0}}-\x{{00FF}}]+')) w from d)
  where length(w) >= {spelling.LEAST_LENGTH} group by 1, 2),
h as (select w, n, {_crc("(id || ':' || w)")} h from r, crc),
m as (
  select case when h % {spelling.MISSPELT} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end word, n
  from h),
v as (
  select word, sum(n)::bigint n from m where length(word) >= {spelling.LEAST_LENGTH}
  group by 1 having sum(n) >= {spelling.LEAST_COUNT}),
k as (
  select word, n, unnest(list_distinct(list_append(list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)), word))) key
  from v),
p as (
  select distinct a.word, b.word other, b.n m from k a join k b using (key)
  where a.word <> b.word and (length(a.word) <> length(b.word)
    or len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)),
best as (select word, count(*)::bigint n_near, max(m) top, min_by(other, row(-m, other)) other from p group by 1),
f as (
  select v.word, v.n, coalesce(n_near, 0)::bigint n_near, case when top >= {spelling.RATIO} * v.n then other end form,
    case when top >= {spelling.RATIO} * v.n then top end form_n
  from v left join best using (word)),
chain as (
  select word, word root from v union all
  select chain.word, f.form from chain join f on f.word = chain.root where f.form is not null),
ends as (select chain.word, root from chain join f on f.word = root where f.form is null)
select word, form, root, n, n_near, form_n from f join ends using (word)""",
}

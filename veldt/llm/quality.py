"""Quality rules with a verdict on the host (operator 6), in DataFrame functions alone.

Every document is measured against per-document rules. The rules' failures are counted by host (here: source);
each host's rate is shrunk towards an empirical beta prior, fitted to all hosts by the method of moments, and a
host whose shrunk rate is over ``max_rate`` for any rule loses all its documents.

Defined results: a null text has no words and fails; a document of a null host is judged by its own rules alone;
repeated rows are measured and counted each; an empty table gives no rows; ties do not arise (no ordering);
other columns, whatever their names, pass ``measure`` untouched and are dropped by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import let, words

#: Fewest words, and most words in repeated 3-word windows, in hundredths.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Limits of the rules that count by host only.
MAX_SYMBOL_SHARE, MAX_DUP_LINES, WORD_CHARS = 0.10, 0.30, (2.0, 12.0)
#: A host is rejected when its shrunk rate for a rule is over this.
MAX_RATE = 0.8
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1e6)

RULES = ("base", "symbols", "dup_lines", "word_length")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_starts(tri: Column, n: Column) -> Column:
    """Ascending positions whose hash stands at another position too.

    Hashes, cut to leave room for the position, are sorted as plain longs; neighbours that agree after the cut
    but not in full (rare) send the text to a sort of whole (hash, position) pairs.
    """

    def by_longs(bits: Column) -> Column:
        packed = F.transform(tri, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))

        def found(s: Column) -> Column:
            cut = lambda x: F.call_function("shiftright", x, bits)
            at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
            same = lambda x, y: cut(x) == cut(y)
            clash = F.exists(F.transform(s, lambda x, j: same(x, F.get(s, j - 1)) & (F.get(tri, at(x).cast("int")) != F.get(tri, at(F.get(s, j - 1)).cast("int")))), lambda c: F.coalesce(c, F.lit(False)))
            quick = F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), at))
            return F.when(clash, whole()).otherwise(quick)

        return let(F.sort_array(packed), found)

    def whole() -> Column:
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"])))

    return let(F.length(F.bin(n.cast("long"))), by_longs)


def repeat_words(ws: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text, the first included."""
    n = F.size(ws)
    spots = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    tri = F.transform(spots, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda s, x: s + x)
    return let(tri, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(let(_repeat_starts(t, n), covered)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five measures, n_lines and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = let(F.split(t, "\n", -1), lambda ls: let(F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda k: F.struct(F.size(k).cast("long").alias("n_lines"), (F.size(k) - F.size(F.array_distinct(k))).cast("long").alias("n_dup_lines"))))
    told = let(
        words(F.col(text)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeat_words(ws).alias("n_repeat_words")),
    )
    out = docs.withColumns({"_w": told, "_l": lines, "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")})
    out = out.withColumns({"n_words": F.col("_w.n_words"), "word_chars": F.col("_w.word_chars"), "n_repeat_words": F.col("_w.n_repeat_words"), "n_lines": F.col("_l.n_lines"), "n_dup_lines": F.col("_l.n_dup_lines")}).drop("_w", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def rule(name: str) -> Column:
    """Whether a measured document fails a rule."""
    n = F.col("n_words")
    return {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_CHARS[0] * n) | (F.col("word_chars") > WORD_CHARS[1] * n),
    }[name]


def hosts(measured: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """A row for each host: documents, failures and shrunk rate of each rule, and whether it is rejected."""
    one = measured.where(F.col(host).isNotNull())
    table = one.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *[F.sum(rule(r).cast("long")).alias(f"{r}_failed") for r in RULES])
    rates = [F.col(f"{r}_failed") / F.col("n_docs") for r in RULES]
    fit = table.agg(*[x for r, q in zip(RULES, rates, strict=True) for x in ((F.sum(f"{r}_failed") / F.sum("n_docs")).alias(f"{r}_mean"), F.var_pop(q).alias(f"{r}_var"))]).first()
    out, bad = table, F.lit(False)
    for r in RULES:
        mean, var = fit[f"{r}_mean"] or 0.0, fit[f"{r}_var"] or 0.0
        strength = min(max(mean * (1 - mean) / var - 1, STRENGTH[0]), STRENGTH[1]) if var > 0 else STRENGTH[1]
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + mean * strength) / (F.col("n_docs") + strength))
        bad = bad | (F.col(f"{r}_rate") > max_rate)
    return out.withColumn("host_rejected", bad)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, host, the measures, base_failed and kept, a row for each row of ``docs``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured = scratch.kept(measure(slim).drop("text"), "quality")
    verdicts = hosts(measured, "host", max_rate).where("host_rejected").select("host", "host_rejected")
    return measured.join(verdicts, "host", "left").select("doc_id", "host", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("host_rejected").isNull()).alias("kept"))

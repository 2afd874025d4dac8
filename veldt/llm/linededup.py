"""Line dedup by an exact set-similarity join (operator 8), in DataFrame functions alone.

A line is the set of its words. Of lines whose sets have a Jaccard similarity of at least 4/5, all but the first
(by doc_id, then place) are later matches and are removed. All lines that have words take part; a greater ``min_words``
leaves out lines of fewer words.

Words become 64-bit keys that sort by rarity: a class of the word's frequency, counted over all documents in
2**17 hashed buckets (a table of fixed size), then the word's hash. Any such order is right; rarity makes it quick.
Lines of equal sets are joined into one. The rarest keys of each set, of which a match must share one (prefix filter),
are dealt out by key; the shorter of two sets need deal out fewer. The join keeps pairs that pass the length filter, the
positional filter, and a bound from parity sketches, which differ in at most as many bits as the sets do in words (64
bits, 128 for sets of more than WIDE words). Pairs that are left must have enough of their dealt keys in common, and
are then verified on the sets themselves.

A set need only have one similar earlier set. So sets that have a neighbouring pair of dealt keys in common with many
others first look at the earliest of these; if it is similar, the set is settled, and the join leaves out pairs whose
later set is settled: a line with very many near copies does not make a pair of each two.

Sets of up to ALIKE words have no similar set but their equals, which are joined into one: they deal out no keys.

Sets are told apart by 128-bit hashes, words within a line by 53 bits and their class.

Defined results: a null text has one empty line; empty lines stay; rows that repeat doc_id and text are one document
and keep the same lines; a null doc_id comes after all others; texts of one doc_id are ordered by their hash; an empty
table gives no rows; clashing extra columns are dropped, or kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import if_small

#: Similarity, as NUM / DEN.
NUM, DEN = 4, 5
#: Sets of so many words are similar to equal sets alone: n / (n + 1) is under NUM / DEN.
ALIKE = NUM // (DEN - NUM) - 1
BUCKET_BITS, KEY_BITS = 17, 53
#: Sets of more words have sketches of twice the bits; of sets of more than WIDEST words sketches tell nothing.
WIDE, WIDEST = 48, 512
#: Neighbouring pairs of dealt keys, from the last, by which a set looks for the earliest set that has them.
LOOK = 4
#: So many sets that have a pair of keys in common are a crowd.
CROWD = 8
#: Columns of lines and sets that hold hashes.
HASHES = ("s1", "s2", "fold", "half", "prefix.list.element")
#: Flags beside a key's place.
SETTLED, INDEXED = 1 << 31, 1 << 30


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _tidy(line: Column) -> Column:
    """The line with its words parted by single spaces, none at its ends."""
    odd = line.startswith(" ") | line.endswith(" ")
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(x)
    return F.when(odd, F.regexp_replace(F.regexp_replace(line, r"[ \t\x0B-\r]+", " "), r"\A +| +\z", "")).otherwise(line)


class Lines:
    """A text as the sets of its lines' words."""

    def pieces(self, text: Column) -> Column:
        return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)

    def ready(self, piece: Column) -> Column:
        return _tidy(piece)

    def takes(self, piece: Column) -> Column:
        """Whether a piece has words."""
        return piece != ""

    def count(self, text: Column) -> Column:
        """How many pieces a text has."""
        t = F.coalesce(text.cast("string"), F.lit(""))
        return (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")

    def keys(self, piece: Column, key: Callable[[Column], Column]) -> Column:
        """``key`` of each different word of a piece made ready; an empty one has the empty word."""
        # Lambdas are not compiled, what is done to arrays of numbers is: words are hashed once and told apart as numbers.
        return F.transform(F.array_distinct(F.transform(F.split(piece, " ", -1), lambda w: F.xxhash64(w))), key)

    def size(self, piece: Column) -> Column:
        """The words of a piece, with repeats."""
        return F.size(F.split(piece, " ", -1))

    def buckets(self, docs: DataFrame, text: str) -> DataFrame:
        """(bucket, n): how many words fall into each hashed bucket."""
        ws = F.split(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), " ", -1)
        each = docs.select(F.explode(ws).alias("w")).select(F.xxhash64("w").bitwiseAND((1 << BUCKET_BITS) - 1).alias("bucket"))
        # Four buckets a row: so few groups fit in the small table that Spark compiles for counting.
        fours = each.groupBy(F.shiftright("bucket", 2).alias("four")).agg(*[F.count_if(F.col("bucket").bitwiseAND(3) == i).alias(f"n{i}") for i in range(4)])
        counts = [F.struct((F.col("four") * 4 + i).alias("bucket"), F.col(f"n{i}").alias("n")) for i in range(4)]
        return fours.select(F.inline(F.array(*counts))).where("n > 0")

    def keyed(self, pieces: DataFrame, classes: list[int], *keep: str) -> DataFrame:
        """The columns ``keep`` of ``pieces``, and keys: the set of words of its column piece (made ready), rarest first."""
        # As JSON, so that the optimizer makes it one literal: as a column, every row would hold a copy.
        told = F.from_json(F.lit(str(classes)), "array<tinyint>")
        mask, low = _long((1 << BUCKET_BITS) - 1), _long((1 << KEY_BITS) - 1)
        # None is null, and said to be none: keys are then sorted as plain numbers.
        key = lambda x: F.coalesce(F.shiftleft(F.get(told, x.bitwiseAND(mask)).cast("long"), KEY_BITS), _long(0)).bitwiseOR(x.bitwiseAND(low))
        return pieces.select(*keep, F.sort_array(self.keys(F.col("piece"), key)).alias("keys"))

    def sets(self, docs: DataFrame, doc_id: str, text: str, classes: list[int], min_words: int) -> DataFrame:
        """A row for each line: doc_id, h, n_lines, line, and what is known of it, n being 0 where it takes no part. The
        prefix holds 32-bit hashes of keys: clashes only add candidates. Lines are rows here, not arrays of a text, so that
        all but what is done to each word is compiled."""
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), self.count(F.col(text)).alias("n_lines"), self.pieces(F.col(text)).alias("ls"))
        rows = texts.select("doc_id", "h", "n_lines", F.posexplode("ls").alias("line", "raw")).withColumn("piece", self.ready(F.col("raw")))
        takes = self.takes(F.col("piece"))
        if min_words > 1:
            takes &= self.size(F.col("piece")) >= min_words
        rows = self.keyed(rows.withColumn("takes", takes), classes, "doc_id", "h", "n_lines", "line", "takes").withColumn("n", F.size("keys"))
        n = F.col("n")
        dealt = F.when(F.col("takes") & (n > ALIKE), n - F.floor((NUM * n + DEN - 1) / DEN).cast("int") + 1).otherwise(0)
        # The bit of each value of the low 6 bits, and the upper half's of the low 7.
        ones = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
        bits, uppers = (F.from_json(F.lit(str(x)), "array<bigint>") for x in (ones, [0] * 64 + ones))
        fold = F.when(n <= WIDEST, F.aggregate("keys", _long(0), lambda s, x: s.bitwiseXOR(F.get(bits, x.bitwiseAND(_long(63)))))).otherwise(_long(0))
        half = F.when((n > WIDE) & (n <= WIDEST), F.aggregate("keys", _long(0), lambda s, x: s.bitwiseXOR(F.get(uppers, x.bitwiseAND(_long(127)))))).otherwise(_long(0))
        return rows.select(
            "doc_id", "h", "n_lines", "line", F.when(F.col("takes"), n).otherwise(0).alias("n"), F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(7), "keys").alias("s2"),
            fold.alias("fold"), half.alias("half"), F.transform(F.slice("keys", F.lit(1), dealt), lambda x: F.hash(x)).alias("prefix"),
        )


def rarity(counts: DataFrame) -> list[int]:
    """For each bucket of words, a class that grows with how many ``counts`` (bucket, n) has of them."""
    every = counts.sparkSession.range(1 << BUCKET_BITS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    told = every.select("bucket", F.least(F.floor(3 * F.log2(F.coalesce("n", F.lit(0)) + 1)), F.lit(127)).alias("class"))
    # One task sorts 2**17 numbers, whatever the table's size.
    packed = told.agg(F.sort_array(F.collect_list(F.col("bucket") * 128 + F.col("class"))).alias("all")).first()[0]
    return [x % 128 for x in packed]


def _near(a: dict, b: dict, least: Column) -> Column:
    """Whether two sets' sketches leave it open that they are similar: half holds the upper half of the words' bits, fold
    both halves, one over the other."""
    whole, upper = a["fold"].bitwiseXOR(b["fold"]), a["half"].bitwiseXOR(b["half"])
    apart = F.when(least > WIDE, F.bit_count(whole.bitwiseXOR(upper)) + F.bit_count(upper)).otherwise(F.bit_count(whole))
    return (F.greatest(a["n"], b["n"]) > WIDEST) | ((NUM + DEN) * apart <= a["n"] + b["n"])


class _Join:
    """The similar pairs among ``sets``, whose words are read again from the documents."""

    def __init__(self, sets: DataFrame, docs: DataFrame, doc_id: str, text: str, cut: Lines, classes: list[int]) -> None:
        self.sets, self.cut, self.classes = sets, cut, classes
        self.docs = docs.select(F.col(doc_id).alias("d0"), F.xxhash64(F.col(text)).alias("h0"), F.col(text).alias("text"))

    def known(self, asked: DataFrame) -> DataFrame:
        """(sid, keys) of the sets asked for, once or more often."""
        spots = self.sets.join(if_small(asked), "sid").select("sid", F.col("fh").alias("h"), F.col("fd").alias("d"), F.col("fl").alias("line"))
        spots = scratch.kept(spots.groupBy("d", "h").agg(F.collect_list(F.struct("line", "sid")).alias("spots")), "spots")
        met = self.docs.join(if_small(spots), F.col("d0").eqNullSafe(F.col("d")) & (F.col("h0") == F.col("h")))
        spot = F.transform("spots", lambda x: F.struct(x["sid"].alias("sid"), F.get("ls", x["line"]).alias("raw")))
        pieces = met.select(self.cut.pieces(F.col("text")).alias("ls"), "spots").select(F.explode(spot).alias("s")).select("s.sid", self.cut.ready(F.col("s.raw")).alias("piece"))
        return scratch.kept(self.cut.keyed(pieces, self.classes, "sid"), "known")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(sid): the later sets of those pairs (x, y) that are similar."""
        asked = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct()
        known = self.known(scratch.kept(asked, "asked"))
        both = pairs.join(known.select(F.col("sid").alias("x"), F.col("keys").alias("kx")), "x").join(known.select(F.col("sid").alias("y"), F.col("keys").alias("ky")), "y")
        shared = F.size(F.array_intersect("kx", "ky"))
        return both.where((NUM + DEN) * shared >= NUM * (F.size("kx") + F.size("ky"))).select(F.col("y").alias("sid")).distinct()

    def looks(self) -> DataFrame:
        """(sid, n, key): for each set the last pairs of neighbouring keys that it deals out."""
        some = self.sets.where(F.size("prefix") > 0).select("sid", "n", F.slice("prefix", F.greatest(F.size("prefix") - LOOK, F.lit(1)), LOOK + 1).alias("ends"))
        # Columns, not a lambda over the ends: these are compiled. A single end is hashed alone.
        hashed = F.array(*[F.when((F.size("ends") > i + 1) | F.lit(i == 0), F.xxhash64(F.get("ends", F.lit(i)), F.get("ends", F.lit(i + 1)))) for i in range(LOOK)])
        return some.select("sid", "n", F.explode(hashed).alias("key")).where("key IS NOT NULL")

    def settled(self) -> DataFrame:
        """(sid): sets that are similar to the earliest or the shortest set of a crowd, that is of at least CROWD sets that
        have one of their pairs of neighbouring keys. What a crowd has in common is the greater share of a set the shorter
        the set is."""
        looks = self.looks()
        crowds = looks.groupBy("key").agg(F.min("sid").alias("first"), F.count("*").alias("m")).where(F.col("m") >= CROWD).select("key", "first")
        crowds = scratch.kept(crowds, "crowds")
        met = scratch.kept(looks.join(if_small(crowds), "key"), "crowd_members")
        short = scratch.kept(met.groupBy("key").agg(F.min(F.struct("n", "sid")).alias("s")).select("key", F.col("s.sid").alias("short")), "crowd_shortest")
        pairs = met.select(F.col("sid").alias("y"), F.col("first").alias("x")).unionByName(met.join(if_small(short), "key").select(F.col("sid").alias("y"), F.col("short").alias("x")))
        return scratch.kept(self.verified(self.near(scratch.kept(pairs.where("x < y").distinct(), "crowd_pairs"))), "settled")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that pass the length filter, the sketches, and the count of keys that both deal out: of two
        prefixes, all keys of the one that ends first are in the other if they are in its set at all, and a set of n words
        lacks at most n less the least overlap of them."""
        told = self.sets.select("sid", F.col("n").cast("long").alias("n"), "fold", "half", "prefix")
        names = ("n", "fold", "half", "prefix")
        asked = pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct()
        # Prefixes of long sets are long: only numbers are broadcast, what is told of the sets is joined in shuffles.
        told = scratch.kept(told.join(if_small(scratch.kept(asked, "asked")), "sid"), "asked_sets")
        for c in ("x", "y"):
            pairs = pairs.join(told.withColumnsRenamed({k: f"{c}_{k}" for k in names}).withColumnRenamed("sid", c).hint("merge"), c)
        a, b = ({k: F.col(f"{c}_{k}") for k in names} for c in ("x", "y"))
        least, need = F.least(a["n"], b["n"]), F.ceil(NUM * (a["n"] + b["n"]) / (NUM + DEN))
        met = pairs.where((DEN * least >= NUM * F.greatest(a["n"], b["n"])) & _near(a, b, least))
        shared = F.size(F.array_intersect(a["prefix"], b["prefix"]))
        # Clashing hashes are one in a prefix: as many count as shared.
        clash = sum((F.size(t["prefix"]) - F.size(F.array_distinct(t["prefix"])) for t in (a, b)), F.lit(0))
        enough = shared + clash >= F.least(*[F.size(t["prefix"]) - (t["n"] - need) for t in (a, b)])
        return scratch.kept(met.where(enough).select("x", "y"), "near_pairs")

    def candidates(self, settled: DataFrame) -> DataFrame:
        """(x, y): pairs of sets, x the earlier and y not settled, that share a dealt key and pass the filters."""
        done = settled.select("sid", F.lit(True).alias("done"))
        place = F.col("at").cast("long").bitwiseOR(F.when(F.col("at") <= F.floor(F.col("n") / (NUM + DEN)), _long(INDEXED)).otherwise(_long(0)))
        dealt = self.sets.where(F.size("prefix") > 0).join(if_small(done), "sid", "left")
        dealt = dealt.select("sid", "fold", "half", "n", F.when(F.col("done"), _long(SETTLED)).otherwise(_long(0)).alias("flag"), F.posexplode("prefix").alias("at", "key"))
        dealt = dealt.select("key", "sid", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("flag")).bitwiseOR(place).alias("w"), "fold", "half")
        a, b = ({c: F.col(f"{t}.{c}") for c in ("key", "sid", "w", "fold", "half")} for t in "ab")
        n, at = [F.shiftright(t["w"], 32) for t in (a, b)], [t["w"].bitwiseAND(_long(INDEXED - 1)) for t in (a, b)]
        flag = lambda t, f: t["w"].bitwiseAND(_long(f)) != 0
        # a is the shorter set and need only deal out n // 9 + 1 keys; b stands there to keep both sides one shuffle.
        indexed = flag(a, INDEXED) | (b["w"] < 0)
        length = (n[0] <= n[1]) & (DEN * n[0] >= NUM * n[1]) & ((n[0] < n[1]) | (a["sid"] < b["sid"]))
        later = F.when(a["sid"] < b["sid"], ~flag(b, SETTLED)).otherwise(~flag(a, SETTLED))
        near = _near({**a, "n": n[0]}, {**b, "n": n[1]}, n[0])
        reach = (NUM + DEN) * (F.least(*at) + F.least(n[0] - at[0], n[1] - at[1])) >= NUM * (n[0] + n[1])
        met = dealt.alias("a").join(dealt.alias("b").hint("merge"), (a["key"] == b["key"]) & indexed & length & near & later & reach)
        return met.select(F.least(a["sid"], b["sid"]).alias("x"), F.greatest(a["sid"], b["sid"]).alias("y")).distinct()

    def later(self) -> DataFrame:
        """(sid): sets that have a similar earlier one."""
        settled = self.settled()
        pairs = self.near(scratch.kept(self.candidates(settled), "line_pairs"))
        return scratch.kept(settled.unionByName(self.verified(pairs)), "later_sets") if pairs.take(1) else settled


def matched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1, cut: Lines | None = None) -> DataFrame:
    """(doc_id, h, n_lines, removed), a row for each row of ``docs``: removed lists the lines that are later matches,
    from 0; h is the text's hash. ``cut`` says how a text becomes sets of words: by lines, if not given."""
    cut = cut or Lines()
    classes = rarity(cut.buckets(docs, text))
    held = scratch.kept(cut.sets(docs, doc_id, text, classes, min_words), "lines", HASHES)
    lines = held.where("n > 0")
    # One minimum holds all that is told of a set, its place first: a group of sort-based sums has a price for each.
    told_of = ("n", "fold", "half", "prefix")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("fd"), F.col("h").alias("fh"), F.col("line").alias("fl"), *told_of)
    sets = lines.groupBy("s1", "s2").agg(F.min(first).alias("f"), F.count("*").alias("copies"))
    sets = sets.select("s1", "s2", "copies", *[F.col(f"f.{c}").alias(c) for c in (*told_of, "none", "fd", "fh", "fl")])
    # Numbers that grow with the place of a set's first line: an earlier set has the lesser number.
    sets = sets.repartitionByRange("none", "fd", "fh", "fl").sortWithinPartitions("none", "fd", "fh", "fl").withColumn("sid", F.monotonically_increasing_id())
    sets = scratch.kept(sets, "line_sets", HASHES)
    later = _Join(sets, docs, doc_id, text, cut, classes).later().withColumn("later", F.lit(True))
    told = sets.select("sid", "s1", "s2", "copies", "fd", "fh", "fl").join(if_small(later), "sid", "left").where("later or copies > 1")
    told = scratch.kept(told.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "fd", "fh", "fl", F.coalesce("later", F.lit(False)).alias("later")), "told")
    other = ~(F.col("doc_id").eqNullSafe(F.col("fd")) & F.col("h").eqNullSafe(F.col("fh")) & (F.col("line") == F.col("fl")))
    gone = lines.select("doc_id", "h", "line", "s1", "s2").join(if_small(told), (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))).where(F.col("later") | other)
    gone = gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "removed")
    gone = scratch.kept(gone, "removed_lines")
    out = held.where("line = 0").select("doc_id", "h", "n_lines").join(if_small(gone), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left")
    return out.select("doc_id", "h", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """``docs`` without the lines that are later matches. A null text stays null."""
    gone = scratch.kept(matched(docs, doc_id, text, min_words).where("size(removed) > 0").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("removed").alias("_removed")).distinct(), "cleaned")
    met = docs.join(if_small(gone), F.col(doc_id).eqNullSafe(F.col("_d")) & (F.xxhash64(F.col(text)) == F.col("_h")), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    return met.withColumn(text, F.when(F.col("_removed").isNull(), F.col(text)).otherwise(rest)).drop("_d", "_h", "_removed")

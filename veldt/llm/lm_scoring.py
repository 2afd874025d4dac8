"""Language-model scoring with a probabilistic suffix tree (operator 2).

Symbols: the HEAD most frequent training tokens and the text's end are numbered; every other token is told by 31 bits of
its hash, so contexts and next symbols are not limited to a vocabulary. Tokens of one hash are one symbol, in which each
has its own share, from its count (looked up in a shuffle join, as the vocabulary grows with the corpus).

The tree grows by depth, up to DEPTH symbols. Candidates of a depth are the contexts seen at least LEAST_CONTEXT times
whose suffix is in the tree; their next symbols are counted over all training texts. A context is retained if its
next-symbol distribution diverges from its suffix's by enough (its count times the Kullback-Leibler divergence against a
price for each branch). Branches seen at least LEAST_BRANCH times are kept. Distributions are smoothed by absolute
discounting: what the branches leave goes to the suffix's distribution, down to the root, whose own discount leaves a
share for unseen tokens. A text's score follows the longest suffix in the tree at every token.

Both counts are absolute, so the tree grows with the corpus. A token's context starts at the symbol before it; the tree
is therefore grown and used in parts, by that symbol: as many as there are ``part_tokens`` in the training texts. Driver
and workers hold one part at a time. Each part reads the encoded texts again. Counts are over all training texts.

Defined results: a null text is its end alone; a null doc_id is a training text; repeated rows are counted and scored
each; ties at the edge of HEAD are broken by the token; without training texts every token is unseen and scores 0;
an empty table gives no rows; clashing extra columns are dropped.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm.texts import short_batches

HEAD = 1 << 17
DEPTH = 3
#: Least count of a context and of a branch, and the price of a branch, in nats.
LEAST_CONTEXT, LEAST_BRANCH, PRICE = 20, 3, 3.0
DISCOUNT = 0.75
#: The place of the class of tokens beyond HEAD among the numbered symbols, and the end (also what stands before a text).
REST, END = 0, 1
#: Symbols are less than this.
SYMBOLS = 1 << 31
#: Training tokens for each part of the tree: a part then has about a twelfth as many branches, of some 16 bytes where
#: they are used and four times that while they are grown.
PART_TOKENS = 200_000_000
#: Branches that are compared with the suffixes' at a time.
STEP = 500_000
#: Counts that a worker holds before it passes them on.
HELD = 1_000_000
CODES = 3_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, A-Z in lower case, and how many each text has. Ends are left to the caller."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, text = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(lists))


def rare(token: bytes, numbered: int) -> int:
    """The symbol of a token that has no number; ``numbered`` symbols have one."""
    return numbered + zlib.crc32(token) % (SYMBOLS - numbered)


def unigrams(texts: DataFrame) -> DataFrame:
    """(token, n) of ``texts`` (text); the end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out() -> pa.RecordBatch:
            told = pa.chunked_array(held, pa.string()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([told.field("values"), told.field("counts")], names=["token", "n"])

        for b in batches:
            words, _ = tokens(b.column(0))
            held.append(words)
            size, ends = size + len(words), ends + b.num_rows
            if size > HELD:
                yield out()
                size = 0
        if held:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], names=["token", "n"])

    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, or of one given batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) > size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encode(docs: DataFrame, head: list[str]) -> DataFrame:
    """(doc_id, held_out, ids, rest): a text's symbols as 32-bit numbers, and its tokens beyond HEAD."""
    tell = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(tell.value, pa.string())
        numbered = len(known) + 2
        for b in _gathered(batches):
            words, size = tokens(b.column(2))
            at = pc.index_in(words, known)
            other = at.is_null()
            ids = pc.fill_null(at, -1).to_numpy().astype(np.int32) + 2
            beyond, mask = words.filter(other), other.to_numpy(zero_copy_only=False)
            ids[mask] = [rare(w, numbered) for w in beyond.cast(pa.binary()).to_pylist()]
            ends = np.cumsum(size)
            raw = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            many = np.bincount(np.repeat(np.arange(len(size)), size)[mask], minlength=len(size))
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), beyond)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), rest], names=["doc_id", "held_out", "ids", "rest"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, ids binary, rest array<string>")


def _stream(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, each between its start and its end and after DEPTH - 1 symbols that match nothing; and
    the places of tokens to predict."""
    lead = np.array([-1] * (DEPTH - 1) + [END], np.int64)
    parts = []
    for x in ids:
        parts += [lead, np.frombuffer(x, np.int32).astype(np.int64), lead[-1:]]
    run = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    sizes = np.array([len(x) // 4 + DEPTH + 1 for x in ids], np.int64)
    starts = np.cumsum(sizes) - sizes
    predict = np.ones(len(run), bool)
    for k in range(DEPTH):
        predict[starts + k] = False
    return run, np.flatnonzero(predict)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads them."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """Places of codes in the order of their mixed values. A code is found by its first bits in about three looks, where a
    binary search of a large table misses the cache at every step."""

    def __init__(self, codes: np.ndarray) -> None:
        mixed, n = _mix(codes), len(codes)
        self.order = np.argsort(mixed).astype(np.int32)
        self.codes: np.ndarray | None = codes[self.order]
        bits = max(1, n.bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.mixed = np.append(mixed[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        ends = np.cumsum(np.bincount((self.mixed[:n] >> self.shift).astype(np.int32), minlength=1 << bits), dtype=np.int32)
        self.starts = np.append(np.int32(0), ends[:-1])

    def plain(self) -> tuple:
        """What lookups need, in values of numpy alone."""
        return self.shift, self.mixed, self.starts

    @staticmethod
    def of(plain: tuple) -> Table:
        out = Table.__new__(Table)
        out.shift, out.mixed, out.starts = plain
        return out

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        mixed = _mix(codes)
        at = self.starts[mixed >> self.shift].astype(np.int64)
        todo = np.flatnonzero(self.mixed[at] < mixed)
        while len(todo):
            at[todo] += 1
            todo = todo[self.mixed[at[todo]] < mixed[todo]]
        at[(self.mixed[at] != mixed) | (at == len(self.mixed) - 1)] = -1
        return at


class Tree:
    """Contexts by depth. ``codes[k]``: the contexts of depth k + 1, each the place of the suffix's node times SYMBOLS, plus
    the symbol before it. ``kept``, ``left`` (what the branches leave), ``size`` (count): of each context, by place;
    ``branches``: (context, next symbol), with their shares. ``root``: shares of the numbered symbols; ``known`` and
    ``shares``: those of the others that branches have."""

    def __init__(self, root: np.ndarray, part: int = 0, parts: int = 1) -> None:
        self.root, self.part, self.parts = root, part, parts
        self.known, self.shares = Table(np.zeros(0, np.int64)), np.zeros(0)
        self.codes: list[Table] = []
        self.size: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []
        self.left: list[np.ndarray] = []
        self.branches: list[tuple[Table, np.ndarray]] = []

    def plain(self, more: Table | None = None) -> dict:
        """What scoring needs, in plain values, or with a table of candidates, what counting needs."""
        told = {"root": self.root, "part": self.part, "parts": self.parts, "kept": self.kept}
        if more is not None:
            return told | {"codes": [t.plain() for t in (*self.codes, more)]}
        told |= {"codes": [t.plain() for t in self.codes], "known": self.known.plain(), "shares": self.shares, "left": [x.astype(np.float32) for x in self.left]}
        return told | {"branches": [(t.plain(), x) for t, x in self.branches]}

    @staticmethod
    def of(plain: dict) -> Tree:
        out = Tree(plain["root"], plain["part"], plain["parts"])
        out.kept, out.codes = plain["kept"], [Table.of(x) for x in plain["codes"]]
        if "known" in plain:
            out.known, out.shares, out.left = Table.of(plain["known"]), plain["shares"], plain["left"]
            out.branches = [(Table.of(t), x) for t, x in plain["branches"]]
        return out

    def mine(self, run: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the places, those whose context is of this part of the tree."""
        return places if self.parts == 1 else places[run[places - 1] % self.parts == self.part]

    def below(self, symbol: np.ndarray) -> np.ndarray:
        """The root's shares of symbols; of the whole class where only that is known."""
        out = self.root[np.where(symbol < len(self.root), symbol, REST)]
        some = np.flatnonzero(symbol >= len(self.root))
        at = self.known.find(symbol[some])
        out[some[at >= 0]] = self.shares[at[at >= 0]]
        return out

    def walk(self, run: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The places whose context of that depth is a candidate with retained suffixes, and its place."""
        node = np.zeros(len(places), np.int64)
        for k in range(depth):
            before = run[places - k - 1]
            at = self.codes[k].find(node * SYMBOLS + np.maximum(before, 0))
            good = (at >= 0) & (before >= 0)
            if k + 1 < depth:
                good[good] = self.kept[k][at[good]]
            places, node = places[good], at[good]
        return places, node

    def share(self, depth: int, node: np.ndarray, symbol: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Next-symbol probabilities at retained contexts of a depth; ``below`` holds the suffixes'."""
        table, share = self.branches[depth - 1]
        out = self.left[depth - 1][node] * below
        at = table.find(node * SYMBOLS + symbol)
        out[at >= 0] += share[at[at >= 0]]
        return out

    def probabilities(self, run: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the symbols at ``places``, which are of this part of the tree."""
        symbol = run[places]
        p = self.below(symbol)
        live, node = np.arange(len(places)), np.zeros(len(places), np.int64)
        for k in range(len(self.codes)):
            before = run[places[live] - k - 1]
            at = self.codes[k].find(node * SYMBOLS + np.maximum(before, 0))
            good = (at >= 0) & (before >= 0)
            good[good] = self.kept[k][at[good]]
            live, node = live[good], at[good]
            p[live] = self.share(k + 1, node, symbol[live], p[live])
        return p

    def suffix_share(self, depth: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next-symbol probabilities at contexts of a depth (0: the root), all of whose suffixes are retained."""
        if depth == 0:
            return self.below(symbol)
        return self.share(depth, node, symbol, self.suffix_share(depth - 1, self.codes[depth - 1].codes[node] // SYMBOLS, symbol))

    def grow(self, table: Table, size: np.ndarray, branch: np.ndarray, count: np.ndarray) -> None:
        """Add the next depth: candidates with their counts, and their branches."""
        depth, n = len(self.codes) + 1, len(size)
        node = branch // SYMBOLS
        mine = count / np.maximum(size[node], 1)
        share = (mine - DISCOUNT / np.maximum(size[node], 1)).astype(np.float32)
        left = np.maximum(1 - np.bincount(node, share, n), 1e-12)
        theirs = np.concatenate([self.suffix_share(depth - 1, table.codes[node[i : i + STEP]] // SYMBOLS, branch[i : i + STEP] % SYMBOLS) for i in range(0, len(node), STEP)] or [np.zeros(0)])
        gain = np.bincount(node, mine * np.log(mine / theirs), n)
        rest, rest_theirs = np.maximum(1 - np.bincount(node, mine, n), 1e-9), np.maximum(1 - np.bincount(node, theirs, n), 1e-9)
        gain += rest * np.log(rest / rest_theirs)
        self.codes.append(table)
        self.size.append(size)
        self.left.append(left)
        self.kept.append(size * gain > PRICE * (np.bincount(node, minlength=n) + 1))
        del node, mine, theirs
        found = Table(branch)
        self.branches.append((found, share[found.order]))
        found.codes = found.order = None  # lookups need neither

    def pairs(self, branch: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the whole tree at depth one: a branch (x -> b) is as often the context x b, if b is retained."""
        often = count >= LEAST_CONTEXT
        before, node = self.codes[0].codes[branch[often] // SYMBOLS], self.codes[0].find(branch[often] % SYMBOLS)
        return self.retained(np.maximum(node, 0) * SYMBOLS + before, count[often], node >= 0)

    def retained(self, codes: np.ndarray, count: np.ndarray, good: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Those of longer contexts (place of the suffix at the last depth, symbol before it) whose suffix is retained."""
        good = good & self.kept[-1][codes // SYMBOLS]
        return codes[good], count[good]


def _count_next(encoded: DataFrame, tree: Tree, table: Table, longer: bool) -> DataFrame:
    """(code, n): counts of (candidate, next symbol), over training texts; if asked for, also of (candidate, symbol before
    it), told by codes of -1 and less."""
    tell = encoded.sparkSession.sparkContext.broadcast(tree.plain(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tree.of(tell.value)
        depth, held = len(t.codes), []

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        for b in batches:
            stream, places = _stream(b.column(0).to_pylist())
            places, node = t.walk(stream, t.mine(stream, places), depth)
            held.append(node * SYMBOLS + stream[places])
            if longer:
                before = stream[places - depth - 1]
                held.append(-1 - (node * SYMBOLS + before)[before >= 0])
            if sum(map(len, held)) > CODES:
                yield out()
        if held:
            yield out()

    told = encoded.where("not held_out").select("ids").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return told.where(F.col("n") >= F.when(F.col("code") < 0, F.lit(LEAST_CONTEXT)).otherwise(F.lit(LEAST_BRANCH)))


def _arrays(df: DataFrame, **cols: type) -> list[np.ndarray]:
    table = df.select(*cols).toArrow()
    return [table.column(c).to_numpy().astype(kind) for c, kind in cols.items()]


def train(encoded: DataFrame, counts: np.ndarray, root: np.ndarray, others: DataFrame, part: int = 0, parts: int = 1) -> Tree:
    """A part of the tree of the encoded training texts. ``counts`` and ``root`` are those of the numbered symbols,
    ``others`` (symbol, n, share) of the others."""
    tree = Tree(root, part, parts)
    if not counts.sum():
        return tree
    first = np.flatnonzero(counts >= LEAST_CONTEXT).astype(np.int64)
    first = first[(first != REST) & (first % parts == part)]
    more, size = _arrays(others.where((F.col("n") >= LEAST_CONTEXT) & (F.col("symbol") % parts == part)), symbol=np.int64, n=np.int64)
    codes, size = np.append(first, more), np.append(counts[first], size)
    for depth in range(DEPTH):
        if not len(codes):
            break
        table = Table(codes)
        longer = depth + 1 < DEPTH and (depth > 0 or parts > 1)
        told = scratch.kept(_count_next(encoded, tree, table, longer), "branches")
        if depth == 0:
            seen = told.where("code >= 0").select((F.col("code") % SYMBOLS).alias("symbol")).where(F.col("symbol") >= len(root)).distinct()
            known, shares = _arrays(others.join(seen, "symbol"), symbol=np.int64, share=np.float64)
            tree.known = Table(known)
            tree.shares = shares[tree.known.order]
        branch, count = _arrays(told.where("code >= 0"), code=np.int64, n=np.int32)
        tree.grow(table, size[table.order], branch, count)
        if longer:
            codes, size = _arrays(told.where("code < 0"), code=np.int64, n=np.int64)
            codes, size = tree.retained(-1 - codes, size)
        else:
            codes, size = tree.pairs(branch, count) if depth == 0 else (codes[:0], size[:0])
    return tree


def _score_part(encoded: DataFrame, tree: Tree, counts: np.ndarray) -> DataFrame:
    """(row, n_tokens, known, base, score): the part's share of each; counts are told by the first part."""
    state = encoded.sparkSession.sparkContext.broadcast((tree.plain(), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, n = state.value
        t = Tree.of(told)
        seen = n > 0
        seen[REST] = False
        base = np.log10(n + 1.0)
        base[REST] = 0.0
        for b in batches:
            ids = b.column(1).to_pylist()
            stream, places = _stream(ids)
            size = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            text = np.repeat(np.arange(len(ids)), size)
            mine = t.mine(stream, places)
            where = np.searchsorted(places, mine) if t.parts > 1 else slice(None)
            symbol = stream[mine]
            p = t.probabilities(stream, mine) / np.where(symbol < len(t.root), 1.0, t.below(symbol) / t.root[REST])
            told = np.where(stream[places] < len(n), stream[places], REST)
            sums = lambda x, to: np.bincount(to, x, len(ids))  # noqa: B023, E731
            first = t.part == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size * first), pa.array((sums(seen[told], text) * first).astype(np.int64)), pa.array(sums(base[told], text) * first), pa.array(sums(np.log10(p), text[where]))],
                names=["row", "n_tokens", "known", "base", "score"],
            )

    return encoded.select("row", "ids").mapInArrow(run, "row long, n_tokens long, known long, base double, score double")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    known = scratch.kept(unigrams(rows.where("not held_out").select("text")), "unigrams")
    of = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.coalesce(F.max(F.when(F.col("token") == "", F.col("n"))), F.lit(0)).alias("ends")).first()
    total, types = of["n"], of["v"]
    top = known.where("token <> ''").orderBy(F.desc("n"), "token").limit(head).toArrow()
    words = top.column("token").to_pylist()
    encoded = scratch.kept(_encode(rows, words).withColumn("row", F.monotonically_increasing_id()), "encoded")

    counts = np.array([0, of["ends"], *top.column("n").to_pylist()], np.int64)
    counts[REST] = total - counts.sum()
    off = of["once"] / (of["once"] + 2 * of["twice"]) if of["once"] else 0.5
    off = min(max(off, 0.05), 0.95)
    unseen = off * types / total if total else 1.0  # the share of unseen tokens
    root = np.maximum(counts - off, 1e-9) / max(total, 1)
    rest_types = types - len(words) - (of["ends"] > 0)
    root[REST] = (counts[REST] - off * rest_types) / max(total, 1) + unseen
    mine = F.greatest(F.col("n") - off, F.lit(1e-9)) / max(total, 1)
    symbol = F.crc32(F.col("token").cast("binary")) % (SYMBOLS - len(root)) + len(root)
    least = (int(counts[-1]), words[-1]) if words else (0, "")
    beyond = known.where("token <> ''").where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("token") > least[1])) if words else F.lit(True))
    others = scratch.kept(beyond.groupBy(symbol.alias("symbol")).agg(F.sum("n").alias("n"), F.sum(mine).alias("share")), "others")

    parts = max(1, -(-total // part_tokens))
    scored = [scratch.kept(_score_part(encoded, train(encoded, counts, root, others, i, parts), counts), "scored") for i in range(parts)]
    scored = functools.reduce(DataFrame.unionByName, scored).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score")])
    # Tokens beyond HEAD: their counts come by a join, never by a broadcast of the vocabulary.
    rest = encoded.select("row", F.explode("rest").alias("token")).join(known.hint("shuffle_hash"), "token", "left")
    p = F.when(F.col("n").isNull(), F.lit(unseen)).otherwise(mine) / float(root[REST])
    rest = rest.groupBy("row").agg(F.count("n").alias("rest_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest_base"), F.sum(F.log10(p)).alias("rest_score"))
    out = encoded.select("row", "doc_id", "held_out").join(scored, "row").join(rest, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rest_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest_base") - F.col("n_tokens") * math.log10(total + types + 1)).alias("base_score"), (F.col("score") + zero("rest_score")).alias("score"),
    )

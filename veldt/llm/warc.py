"""WARC archives, written and read back with boundary-chain verification (operator 4).

Writing: a record for each page, through Spark's text writer, whose line separator is the blank lines that end a
record; the files are plain WARC/1.1 and go to any file system Spark can reach. Pages with equal payloads of at
least ``min_revisit`` bytes become one response and revisits of it.

Reading: Spark's text reader cuts the files, in splits of any size, at the magic line that starts a record; each
piece knows its split, and the lengths of the pieces before it give its byte offset. Each piece is a candidate,
because a payload may hold the magic too. A candidate names its successor's offset, from its own header. Offsets
are grouped into segments of ``segment`` bytes; within a segment a task jumps pointers until they leave it; between
segments pointer jumping goes on from each file's start, in as many rounds as the logarithm of the segments. Only
candidates on the chain from a file's start are records; the pieces between two records are the first one's payload.

Defined results: a null html is an empty payload; a null url is left out of the record, and line ends in it are
escaped; a null page_id is kept as null and never is the largest; repeated rows with one page_id are all responses
or all revisits; an empty table gives no rows; clashing extra columns
are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt import scratch

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: Offsets are followed within so many bytes at a time.
SEGMENT = 4 << 20
#: Date of every record: archives of the same pages are the same bytes.
DATE = "2000-01-01T00:00:00Z"


def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, revisit, refers_to), a row for each page."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    shared = slim.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.min(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("low"))
    # Only payloads that have a page to revisit: few, so adaptive execution can broadcast them where they are small.
    shared = scratch.kept(shared.where("last is not null and not (low.page_id <=> last)").select("payload_digest", "last"), "shared_payloads")
    out = slim.join(shared, "payload_digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Write ``pages`` as WARC files under ``path``."""
    rows = revisits(pages, page_id, url, html, min_revisit)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END), F.col("html")))
    rows = rows.withColumn("block", block)
    uri = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Identical-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """A row for every place where the magic stands: file, offset, header and stated length of the piece from the
    magic to the next one, the payload's bytes and digest if the piece holds the whole block (``whole``), and the
    offset of the successor; these are null where no header follows the magic. If asked for, the piece itself."""
    text = F.col("piece").cast("string")
    head = F.when(F.locate(END, text) > 0, F.substring_index(text, END, 1))
    length = F.regexp_extract("head", r"(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r\n|$)", 1)
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("piece"))
    raw = raw.withColumn("size", (F.octet_length("piece") + len(MAGIC)).cast("long")).withColumn("head", head).withColumn("length", F.when(length != "", length.cast("long")))
    raw = raw.withColumn("whole", F.octet_length("piece") >= F.octet_length("head") + len(END) + F.col("length"))
    told = _payload("whole")
    raw = raw.withColumns({k: told[k] for k in ("read_bytes", "read_digest")})
    # Kept, so that splits and row numbers are the same in the two reads that follow.
    raw = scratch.kept(raw if pieces else raw.drop("piece"), "warc_pieces")
    lengths = raw.groupBy("file", "split").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("file", "split", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    slim = raw.select("file", "split", "row", "size") if pieces else raw
    # A piece's magic stands before it: its offset is what comes before, less the magic's length.
    placed = slim.withColumn("in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["file", "split"])
    placed = placed.withColumn("offset", F.col("start") + F.col("in") - len(MAGIC)).where("offset >= 0").drop("start", "in", "size")
    if pieces:
        placed = placed.join(raw.drop("size"), ["file", "split", "row"])
    placed = placed.withColumn("successor", F.col("offset") + len(MAGIC) + F.octet_length("head") + len(END) + F.col("length") + len(END))
    return placed.drop("split", "row")


def _payload(whole: str) -> dict:
    """The payload's bytes and digest, of responses whose whole block is in the piece."""
    block = F.substring(F.col("piece"), F.octet_length("head") + len(END) + 1, F.col("length").cast("int"))
    payload = F.substring(block, F.locate(END, block.cast("string")) + len(END), F.col("length").cast("int"))
    told = F.col(whole) & F.col("head").contains("WARC-Type: response\r\n")
    return {"read_bytes": F.when(told, F.octet_length(payload).cast("long")), "read_digest": F.when(told, F.sha1(payload)), "payload": F.when(told, payload)}


def _follow(segment: int):
    """For a segment: each candidate's first offset outside it. Pointers always lead ahead."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        end = (key[1] + 1) * segment
        pdf = pdf.sort_values("offset")
        out: dict[int, int] = {}
        for o, s in zip(pdf["offset"][::-1], pdf["successor"][::-1], strict=True):
            out[o] = out.get(s, -1) if s < end else s
        return pd.DataFrame({"file": key[0], "offset": list(out), "exit": list(out.values())})

    return run


def _mark(segment: int):
    """For a segment: the candidates on the chain from its entry."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        step, now, seen = dict(zip(pdf["offset"], pdf["successor"], strict=True)), pdf["entry"].iloc[0], []
        while now in step:
            seen.append(now)
            now = step[now]
        return pd.DataFrame({"file": key[0], "offset": pd.Series(seen, dtype="int64")})

    return run


def reachable(found: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(file, offset) of the candidates on the chain from the start of their file, by pointer jumping."""
    links = found.where("successor is not null").select("file", "offset", "successor", F.floor(F.col("offset") / segment).alias("seg"))
    links = scratch.kept(links, "warc_links")
    jumps = scratch.kept(links.groupBy("file", "seg").applyInPandas(_follow(segment), "file string, offset long, exit long").where("exit >= 0"), "warc_jumps")
    known = links.where("offset = 0").select("file", "offset")
    entries, n = scratch.kept(known, "warc_entries"), -1
    while (m := entries.count()) != n:
        n = m
        ahead = entries.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        entries = scratch.kept(entries.unionByName(ahead).distinct(), "warc_entries")
        twice = jumps.alias("x").join(jumps.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.exit") == F.col("y.offset")), "left")
        jumps = scratch.kept(twice.select("x.file", "x.offset", F.coalesce("y.exit", "x.exit").alias("exit")), "warc_jumps")
    at = entries.select("file", F.floor(F.col("offset") / segment).alias("seg"), F.col("offset").alias("entry")).groupBy("file", "seg").agg(F.min("entry").alias("entry"))
    return links.join(at, ["file", "seg"]).groupBy("file", "seg").applyInPandas(_mark(segment), "file string, offset long")


def read(spark: SparkSession, path: str, payloads: bool = True, segment: int = SEGMENT) -> DataFrame:
    """A row for each record: file, offset, record_type, page_id, refers_to, target_uri, payload_bytes,
    payload_digest (of the payload as read; of a revisit as its record states it) and, if asked for, payload."""
    found = scratch.kept(candidates(spark, path), "warc_candidates")
    chain = scratch.kept(reachable(found, segment).withColumn("real", F.lit(True)), "warc_chain")
    marked = found.join(chain, ["file", "offset"], "left")
    cut = scratch.kept(marked.where("real and not whole").select("file", "offset", "successor", "head", "length"), "warc_cut")
    pieces = candidates(spark, path, True).select("file", "offset", "piece") if payloads or cut.take(1) else None
    keep = ["file", "offset", "head", "length", "read_bytes", "read_digest", *(["payload"] if payloads else [])]
    if payloads:
        marked = scratch.kept(marked.join(pieces, ["file", "offset"]).withColumn("payload", _payload("whole")["payload"]).drop("piece"), "warc_payloads")
    records = marked.where("real and whole").select(*keep)
    if cut.take(1):
        # Payloads that hold the magic: in their files alone, the pieces up to the successor go to the record.
        w = Window.partitionBy("file").orderBy("offset")
        some = marked.join(cut.select("file").distinct(), "file", "left_semi")
        some = some.withColumn("owner", F.last(F.when(F.coalesce("real", F.lit(False)), F.struct(F.col("offset").alias("o"), F.coalesce("whole", F.lit(False)).alias("w"))), True).over(w)).where("not owner.w")
        parts = some.select("file", "offset", F.col("owner.o").alias("owner")).join(pieces, ["file", "offset"])
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col("piece").cast("string").alias("piece")))), lambda x: x["piece"]), MAGIC)
        whole = parts.groupBy("file", F.col("owner").alias("offset")).agg(joined.cast("binary").alias("piece")).join(cut.drop("successor"), ["file", "offset"])
        whole = whole.withColumn("yes", F.lit(True)).withColumns(_payload("yes"))
        records = records.unionByName(whole.select(*keep))
    field = lambda key: F.regexp_extract("head", rf"(?:^|\r\n){key}: ([^\r\n]*)", 1)
    page = lambda key: F.regexp_extract(field(key), "<urn:page:(.*)>", 1).try_cast("bigint")
    return records.select(
        "file", "offset", field("WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"),
        F.coalesce("read_bytes", field("X-Identical-Payload-Length").try_cast("bigint")).alias("payload_bytes"), F.coalesce("read_digest", F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1)).alias("payload_digest"), *(["payload"] if payloads else []),
    )

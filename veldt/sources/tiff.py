"""TIFF band files, read and written in tasks.

A file is a partitioned source: its header, a few kilobytes, is read where the scan is planned, and each task then reads
the bytes of its own strips or tiles only. Classic and Big TIFF, strips and tiles, one band or several (chunky or planar),
uncompressed, deflate, LZW and PackBits, predictors 1 to 3. Files are written from tiles that tasks encode; the driver
only strings the compressed tiles together and adds the directory.

Paths are those of Arrow's file systems (local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veldt.errors import AnalysisError
from veldt.sources import crs

#: Bytes of a TIFF field type, and its struct code. Fixed values.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 11: (4, "f"), 16: (8, "Q")}
PIXELS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Numbers of compressions and predictors. Fixed values.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Pixels that a task hands on at a time.
BATCH = 1 << 20


@dataclass(frozen=True)
class Grid:
    """Pixel size, origin, frame and reference system of a raster."""

    width: int
    height: int
    a: float = 10.0
    c: float = 0.0
    e: float = -10.0
    f: float = 0.0
    crs: str | None = None
    nodata: float | None = None

    @property
    def pixel_area(self) -> float:
        return abs(self.a * self.e)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.c, self.f + self.e * self.height, self.c + self.a * self.width, self.f


class Ranges:
    """Byte ranges of a file, or of bytes in memory."""

    def __init__(self, path: str | None, data: bytes | None = None) -> None:
        self.data = data
        if data is None:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            self.file = system.open_input_file(at)

    def read(self, at: int, n: int) -> bytes:
        if self.data is not None:
            return self.data[at : at + n]
        self.file.seek(at)
        return self.file.read(n)


@dataclass(frozen=True)
class Layout:
    """Where a level's blocks are and how they are packed."""

    grid: Grid
    order: str
    kind: str
    bands: int
    planar: bool
    packed: int
    predictor: int
    tiled: bool
    block: tuple[int, int]  # rows, columns
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    def place(self, i: int) -> tuple[int, int, int]:
        """(first row, first column, band or -1 for all) of a block."""
        across = -(-self.grid.width // self.block[1])
        each = across * -(-self.grid.height // self.block[0])
        return i % each // across * self.block[0], i % each % across * self.block[1], i // each if self.planar else -1


def _directory(source: Ranges, order: str, big: bool, at: int) -> tuple[dict[int, tuple], int]:
    """The fields of the directory at a place, and the place of the next one."""
    n = struct.unpack(order + ("Q" if big else "H"), source.read(at, 8 if big else 2))[0]
    at, entry, word = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
    rows, out = source.read(at, entry * n + word), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), rows, entry * k)
        if kind in TYPES:
            size, code = TYPES[kind]
            raw = rows[entry * (k + 1) - word : entry * (k + 1)]
            if size * count > word:
                raw = source.read(struct.unpack(order + ("Q" if big else "I"), raw)[0], size * count)
            out[tag] = struct.unpack(f"{order}{count}{code}", raw[: size * count])
    return out, struct.unpack_from(order + ("Q" if big else "I"), rows, entry * n)[0]


def levels(source: Ranges) -> list[Layout]:
    """The full picture and its overviews."""
    head = source.read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise AnalysisError("not a TIFF file (JPEG 2000 cannot be read here)")
    at, out = struct.unpack(order + "Q", head[8:16])[0] if magic == 43 else struct.unpack(order + "I", head[4:8])[0], []
    while at:
        t, at = _directory(source, order, magic == 43, at)
        w, h = t[256][0], t[257][0]
        scale, tie, keys = t.get(33550, (10.0, 10.0, 0.0)), t.get(33922, (0.0,) * 6), t.get(34735, ())
        named = crs.of_tiff(keys, t.get(34736, ()), t[34737][0].decode("latin-1") if 34737 in t else "")
        nodata = t[42113][0].split(b"\0")[0].decode() if 42113 in t else None
        grid = Grid(w, h, scale[0], tie[3] - tie[0] * scale[0], -scale[1], tie[4] + tie[1] * scale[1], named, float(nodata) if nodata else None)
        kind = PIXELS.get((t.get(339, (1,))[0], t.get(258, (8,))[0]))
        packed, predictor, tiled = t.get(259, (PLAIN,))[0], t.get(317, (1,))[0], 322 in t
        if kind is None or packed not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2, 3):
            raise AnalysisError(f"TIFF compression {packed} or predictor {predictor} cannot be read here")
        block = (t[323][0], t[322][0]) if tiled else (min(t.get(278, (h,))[0], h), w)
        out.append(Layout(grid, order, kind, t.get(277, (1,))[0], t.get(284, (1,))[0] == 2, packed, predictor, tiled, block, t[324 if tiled else 273], t[325 if tiled else 279]))
    return out


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, widened one code early."""
    out, table, held, bits, width, before = bytearray(), [], 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out += now
        if before:
            table.append(before + now[:1])
        before = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def unpacked(layout: Layout, i: int, raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """(first row, first column, band or -1, pixels by row, column and band) of a block, without what is beyond the frame."""
    r, c, band = layout.place(i)
    rows = layout.block[0] if layout.tiled else min(layout.block[0], layout.grid.height - r)
    cols, n, kind = layout.block[1], 1 if layout.planar else layout.bands, np.dtype(layout.kind)
    if layout.packed in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif layout.packed == LZW:
        raw = lzw(raw)
    elif layout.packed == PACKBITS:
        raw = packbits(raw)
    size = rows * cols * n
    if layout.predictor == 3:
        # Bytes of a row are sorted by their weight, highest first, and differenced.
        x = np.cumsum(np.frombuffer(raw, "u1", size * kind.itemsize).reshape(rows, -1, n), axis=1, dtype="u1").reshape(rows, kind.itemsize, cols * n)
        x = np.ascontiguousarray(x.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, n)
    else:
        x = np.frombuffer(raw, layout.order + layout.kind, size).reshape(rows, cols, n)
        if layout.predictor == 2:
            x = np.cumsum(x, axis=1, dtype=x.dtype)
    return r, c, band, x[: layout.grid.height - r, : layout.grid.width - c]


def packed_tile(x: np.ndarray, predictor: int = 1, level: int = 6) -> bytes:
    """Pixels by row, column and band, deflated; predictor 2 differences whole numbers, 3 the bytes of floats."""
    x = np.ascontiguousarray(x, x.dtype.newbyteorder("<"))
    if predictor == 2:
        x = np.diff(x, axis=1, prepend=np.zeros_like(x[:, :1]))
    elif predictor == 3:
        rows, cols, n = x.shape
        b = np.ascontiguousarray(x, x.dtype.newbyteorder(">")).view("u1").reshape(rows, cols * n, -1).transpose(0, 2, 1).reshape(rows, -1, n)
        x = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
    return zlib.compress(np.ascontiguousarray(x).tobytes(), level)


class _Block(InputPartition):
    def __init__(self, path: str, name: str, first: int, last: int) -> None:
        self.path, self.name, self.first, self.last = path, name, first, last


class TiffSource(DataSource):
    """``spark.read.format("veldt_tiff").option("paths", json of {name: path}).load()``: rows (name, band, row, col, dn).
    Options: ``level`` (0, or that of an overview), ``blocks`` (strips or tiles that one task reads)."""

    @classmethod
    def name(cls) -> str:
        return "veldt_tiff"

    def schema(self) -> str:
        return "name string, band int, row int, col int, dn double"

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)


class _TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        import json

        self.paths, self.level, self.each = json.loads(options["paths"]), int(options.get("level", 0)), int(options.get("blocks", 0))

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, path in self.paths.items():
            layout = levels(Ranges(path))[self.level]
            # Blocks of about a million pixels to a task, unless told otherwise.
            each = self.each or max(1, BATCH // (layout.block[0] * layout.block[1]))
            out += [_Block(path, name, i, min(i + each, len(layout.offsets))) for i in range(0, len(layout.offsets), each)]
        return out

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        source = Ranges(partition.path)
        layout = levels(source)[self.level]
        for i in range(partition.first, partition.last):
            r, c, band, x = unpacked(layout, i, source.read(layout.offsets[i], layout.sizes[i]))
            step = max(1, BATCH // max(1, x.shape[1]))
            for k in range(x.shape[2]):
                for at in range(0, x.shape[0], step):
                    v = x[at : at + step, :, k]
                    rows, cols = np.indices(v.shape, dtype=np.int32)
                    n = v.size
                    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([partition.name])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(n, (band if band >= 0 else k) + 1, np.int32)), pa.array((rows + r + at).ravel()), pa.array((cols + c).ravel()), pa.array(v.ravel().astype(np.float64))], names=["name", "band", "row", "col", "dn"])


def scan(spark: SparkSession, paths: dict[str, str], level: int = 0, blocks: int = 0) -> DataFrame:
    """(name, band, row, col, dn) of each named file's pixels; a task reads its own strips or tiles only."""
    import json

    spark.dataSource.register(TiffSource)
    return spark.read.format("veldt_tiff").option("paths", json.dumps(paths)).option("level", level).option("blocks", blocks).load()


def grids(spark: SparkSession, paths: dict[str, str]) -> dict[str, Grid]:
    """The header of each file, read in a task: nothing but its fields comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [levels(Ranges(p))[0].grid for p in b["path"]]
            yield pd.DataFrame([(n, g.width, g.height, g.a, g.c, g.e, g.f, g.crs, g.nodata) for n, g in zip(b["name"], found, strict=True)], columns=["name", "width", "height", "a", "c", "e", "f", "crs", "nodata"])

    heads = spark.createDataFrame(list(paths.items()), "name string, path string")
    try:
        rows = heads.mapInPandas(run, "name string, width int, height int, a double, c double, e double, f double, crs string, nodata double").collect()
    except Exception as e:  # noqa: BLE001  whatever a task says of a file that it can't open or understand
        said = [x.strip() for x in str(e).splitlines() if "Error" in x or "Exception" in x]
        raise AnalysisError(f"{', '.join(paths.values())}: {said[-1] if said else e}") from e
    return {r["name"]: Grid(*r[1:]) for r in rows}


def tiles(pixels: DataFrame, values: list[str], grid: Grid, dtype: str = "f4", predictor: int = 1, size: int = 256) -> DataFrame:
    """(tile, data): pixels (row, col, *values) as deflated tiles of all bands, each encoded by a task; pixels without a row
    or a value hold the grid's ``nodata``. Tiles without a pixel are made too."""
    across, down = -(-grid.width // size), -(-grid.height // size)
    empty = np.dtype(dtype).type(grid.nodata if grid.nodata is not None else 0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full((size, size, len(values)), empty, dtype)
        own = pdf[pdf["row"] >= 0]
        if len(own):
            v = own[values].to_numpy(np.float64)
            x[own["row"] % size, own["col"] % size] = np.where(np.isnan(v), float(empty), v).astype(dtype)
        return pd.DataFrame({"tile": [key[0]], "data": [packed_tile(x, predictor)]})

    tile = (F.floor(F.col("row") / size) * across + F.floor(F.col("col") / size)).cast("int").alias("tile")
    every = pixels.sparkSession.range(across * down).select(F.col("id").cast("int").alias("tile"), F.lit(-1).alias("row"), F.lit(-1).alias("col"), *[F.lit(None).cast("double").alias(c) for c in values])
    rows = pixels.select(tile, "row", "col", *[F.col(c).cast("double").alias(c) for c in values]).unionByName(every)
    return rows.groupBy("tile").applyInPandas(run, "tile int, data binary")


def write(path, pyramid: list[tuple[Grid, DataFrame]], bands: list[str], dtype: str = "f4", predictor: int = 1, size: int = 256) -> None:
    """A tiled file of several bands from the tiles of each level, the full picture first. Tiles stream through the driver
    compressed, a partition at a time; beyond 4 GB the file is a Big TIFF."""
    kind = np.dtype(dtype)
    total = sum((t.agg(F.sum(F.length("data"))).first()[0] or 0) + 64 * -(-g.width // size) * -(-g.height // size) for g, t in pyramid)
    big = total > 4_000_000_000
    word = "Q" if big else "I"
    with open(path, "wb") as out:
        out.write(b"II+\0\x08\0\0\0" + b"\0" * 8 if big else b"II*\0" + b"\0" * 4)
        last = 8 if big else 4  # where the place of the next directory goes
        for level, (grid, held) in enumerate(pyramid):
            places: dict[int, tuple[int, int]] = {}
            for r in held.toLocalIterator():
                places[r["tile"]] = (out.tell(), len(r["data"]))
                out.write(r["data"])
            order = sorted(places)
            n = len(bands)
            fields: list[tuple[int, int, list]] = [
                (254, 4, [1 if level else 0]), (256, 4, [grid.width]), (257, 4, [grid.height]), (258, 3, [kind.itemsize * 8] * n), (259, 3, [DEFLATE]), (262, 3, [1]), (277, 3, [n]), (284, 3, [1]),
                (317, 3, [predictor]), (322, 4, [size]), (323, 4, [size]), (324, 16 if big else 4, [places[i][0] for i in order]), (325, 4, [places[i][1] for i in order]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n),
                (33550, 12, [grid.a, -grid.e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.c, grid.f, 0.0]),
            ]
            if n > 1:
                fields.insert(8, (338, 3, [0] * (n - 1)))
            if grid.crs:
                fields.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, int(grid.crs.split(":")[1])]))
            names = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{b}</Item>' for i, b in enumerate(bands))
            fields.append((42112, 2, [f"<GDALMetadata>{names}</GDALMetadata>\0".encode()]))
            if grid.nodata is not None:
                fields.append((42113, 2, [f"{grid.nodata:g}\0".encode()]))
            fields.sort(key=lambda f: f[0])
            out.write(b"\0" * (out.tell() % 2))
            at = out.tell()
            first = at + (8 if big else 2) + (20 if big else 12) * len(fields) + (8 if big else 4)
            entries, more = b"", b""
            for tag, t, v in fields:
                data = v[0] if t == 2 else struct.pack(f"<{len(v)}{TYPES[t][1]}", *v)
                count, room = len(data) if t == 2 else len(v), 8 if big else 4
                entries += struct.pack("<HHQ" if big else "<HHI", tag, t, count) + (data.ljust(room, b"\0") if len(data) <= room else struct.pack("<" + word, first + len(more)))
                more += data + b"\0" * (len(data) % 2) if len(data) > room else b""
            out.write(struct.pack("<Q" if big else "<H", len(fields)) + entries + b"\0" * (8 if big else 4) + more)
            end = out.tell()
            out.seek(last)
            out.write(struct.pack("<" + word, at))
            out.seek(end)
            last = first - (8 if big else 4)


def encode(values: np.ndarray, grid: Grid, rows_per_strip: int = 64) -> bytes:
    """A small deflate-compressed band in strips, of an array in memory."""
    values = np.ascontiguousarray(values)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    strips = [zlib.compress(values[r : r + rows_per_strip].astype(values.dtype.newbyteorder("<")).tobytes()) for r in range(0, len(values), rows_per_strip)]
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s
    tags: list[tuple[int, int, list]] = [(256, 4, [values.shape[1]]), (257, 4, [values.shape[0]]), (258, 3, [values.dtype.itemsize * 8]), (259, 3, [8]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 4, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (339, 3, [kind]), (33550, 12, [grid.a, -grid.e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.c, grid.f, 0.0])]
    if grid.crs:
        tags.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, int(grid.crs.split(":")[1])]))
    if grid.nodata is not None:
        tags.append((42113, 2, [f"{grid.nodata:g}\0".encode()]))
    at = 8 + len(body)
    more, entries = b"", b""
    first = at + 2 + 12 * len(tags) + 4
    for tag, t, v in tags:
        size, code = TYPES[t]
        data = v[0] if t == 2 else struct.pack(f"<{len(v)}{code}", *v)
        n = len(data) if t == 2 else len(v)
        entries += struct.pack("<HHI", tag, t, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", first + len(more)))
        more += data if len(data) > 4 else b""
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + more

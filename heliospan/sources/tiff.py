"""Grids in TIFF files, read block by block.

The driver reads the header and the tag directory of each file, a few kilobytes by range; its blocks (strips or tiles) are then
dealt to tasks, which read each by its own range, unpack it and add it up. No task holds more than a block and its sums.
Uncompressed, deflate, LZW and PackBits blocks of whole numbers or floats, one sample a pixel; with or without differences
along the lines.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.sources.ranged import reachable

# Fixed values of the format: tags, the sizes of field types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class Grid(NamedTuple):
    """What a tag directory says: the grid's size, its blocks' size, each block's range, and how values are kept."""

    width: int
    height: int
    across: int
    down: int
    ranges: list[tuple[int, int]]
    kind: str
    compression: int
    differences: bool


def directory(read: Callable[[int, int], bytes]) -> Grid:
    """The first image of a file. read: bytes at an offset, of a size."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", head[4:])[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    entries, tags = read(at + 2, 12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
        if kind in TYPES:
            size = struct.calcsize(TYPES[kind]) * count
            held = entries[12 * i + 8 : 12 * i + 12]
            held = held[:size] if size <= 4 else read(struct.unpack(order + "I", held)[0], size)
            tags[tag] = struct.unpack(f"{order}{count}{TYPES[kind]}", held)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("a grid has one sample a pixel")
    kind = order + {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)] + str(one(BITS, 1) // 8)
    tiled = TILE_OFFSETS in tags
    size = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (one(WIDTH), min(one(ROWS, one(HEIGHT)), one(HEIGHT)))
    ranges = list(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True))
    return Grid(one(WIDTH), one(HEIGHT), *size, ranges, kind, one(COMPRESSION, PLAIN), one(PREDICTOR, 1) == 2)


def block(raw: bytes, grid: Grid, number: int) -> tuple[int, int, np.ndarray]:
    """The first row and column of a block, and its values within the grid."""
    columns = -(-grid.width // grid.across)
    top, left = number // columns * grid.down, number % columns * grid.across
    unpack = {PLAIN: bytes, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, LZW: unpack_lzw, PACKBITS: unpack_bits}
    if grid.compression not in unpack:
        raise ValueError(f"compression {grid.compression} is not known")
    values = np.frombuffer(unpack[grid.compression](raw), grid.kind)
    values = values[: len(values) // grid.across * grid.across].reshape(-1, grid.across)
    if grid.differences:
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    return top, left, values[: grid.height - top, : grid.width - left]


def unpack_bits(raw: bytes) -> bytes:
    """PackBits: a count, then so many bytes, or one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 begins anew, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, last, bits, held, wide = first.copy(), bytearray(), b"", 0, 0, 9
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code = held >> bits & (1 << wide) - 1
        if code == 257:
            break
        if code == 256:
            words, last, wide = first.copy(), b"", 9
            continue
        word = words[code] if code < len(words) else last + last[:1]
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        wide = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return bytes(out)


def open_grid(path: str) -> Grid:
    """The tag directory of a file."""
    if not reachable(path):
        raise ValueError(f"no Arrow file system reads {path}")
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return directory(lambda at, size: f.read_at(size, at))


def box_sums(spark: SparkSession, files: Sequence[tuple[str, int]], factor: int, nodata: float, scale: float, pack: int = 64) -> DataFrame:
    """month, row, total, land, cells: for each line of boxes of factor x factor cells the sums of the values over land (clipped to
    0 to 1), the cells with land and all cells, as arrays over the columns. files: path and month; all of one size.

    scale: what a value is divided by. A task sums the blocks of one pack of a file before it sends them; the lines of all files
    are then added by month and row, where each file has as many partial lines as packs that touch it.
    """
    rows = []
    for path, month in files:
        rows += [(path, month, i, *ends, (path, i // pack)) for i, ends in enumerate(open_grid(path).ranges)]
    packs = sorted({r[5] for r in rows})
    number = {p: i for i, p in enumerate(packs)}
    blocks = spark.createDataFrame([(number[r[5]], *r[:5]) for r in rows], "pack int, path string, month int, block int, offset long, size long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, grid = None, {}, None

        def sent() -> pa.RecordBatch:
            columns = [[k[0] for k in held], [k[1] for k in held], *([v[i].tolist() for v in held.values()] for i in range(3))]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["month", "row", "total", "land", "cells"])

        for batch in batches:
            for one in batch.to_pylist():
                system, inner = pafs.FileSystem.from_uri(one["path"])
                with system.open_input_file(inner) as f:
                    if one["path"] != now:
                        now, grid = one["path"], directory(lambda at, size, f=f: f.read_at(size, at))
                    top, left, values = block(f.read_at(one["size"], one["offset"]), grid, one["block"])
                wide = -(-grid.width // factor)
                land = (values != nodata) & ~np.isnan(values)
                shown = np.where(land, np.clip(values / scale, 0.0, 1.0), 0.0)
                for i in range(len(values)):
                    sums = held.setdefault((one["month"], (top + i) // factor), (np.zeros(wide), np.zeros(wide, np.int64), np.zeros(wide, np.int64)))
                    at = (left + np.arange(values.shape[1])) // factor
                    for to, what in zip(sums, (shown[i], land[i].astype(np.int64), np.ones(values.shape[1], np.int64)), strict=True):
                        np.add.at(to, at, what)
                if len(held) >= 256:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    def meet(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"month": lines["month"].iloc[:1], "row": lines["row"].iloc[:1], **{c: [np.sum(np.stack(lines[c].to_numpy()), axis=0)] for c in ("total", "land", "cells")}})

    schema = "month int, row int, total array<double>, land array<bigint>, cells array<bigint>"
    dealt = blocks.repartitionByRange(max(1, len(packs)), "pack").sortWithinPartitions("pack", "block")
    return dealt.select("path", "month", "block", "offset", "size").mapInArrow(add, schema).groupBy("month", "row").applyInPandas(meet, schema)


def boxes(spark: SparkSession, files: Sequence[tuple[str, int]], factor: int, nodata: float = -32767, scale: float = 10000.0) -> DataFrame:
    """month, row, col, value, land: what ``spatial.coded`` makes the climatology of."""
    lines = box_sums(spark, files, factor, nodata, scale)
    cells = lines.select("month", "row", F.posexplode(F.arrays_zip("total", "land", "cells")).alias("col", "b"))
    return cells.select("month", "row", "col", F.try_divide("b.total", "b.land").alias("value"), (F.col("b.land") / F.col("b.cells")).alias("land"))

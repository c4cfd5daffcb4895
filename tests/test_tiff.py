"""Grids in TIFF files: strips and tiles of all compressions, and the climatology made of them."""

import struct
import zlib

import numpy as np
import pytest

from heliospan.operators import spatial
from heliospan.sources import tiff


def lzw(data):
    """A plain encoder; the decoder is an entry behind, so its codes grow one early."""
    words, word, codes = {bytes([i]): i for i in range(256)}, b"", [(256, 9)]
    after, wide = 258, 9
    for b in data:
        if word + bytes([b]) in words:
            word += bytes([b])
            continue
        codes.append((words[word], wide))
        words[word + bytes([b])] = after
        after += 1
        wide = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
        if after == 4094:
            codes.append((256, wide))
            words, after, wide = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    codes += [(words[word], wide)] if word else []
    after += 1
    codes.append((257, 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


def write(path, values, compression, down, across=None, order="<", differences=False):
    """values: a grid of int16; across: tiles in place of strips."""
    height, width = values.shape
    blocks = []
    for top in range(0, height, down):
        for left in range(0, width, across or width):
            part = values[top : top + down, left : left + (across or width)]
            if across:
                part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
            if differences:
                part = np.diff(part, axis=1, prepend=np.int16(0))
            raw = part.astype(order + "i2").tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[compression](raw))
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [2 if differences else 1]), (339, 3, [2])]
    tags += [(322, 4, [across]), (323, 4, [down]), (324, 4, offsets), (325, 4, [len(b) for b in blocks])] if across else [(273, 4, offsets), (278, 4, [down]), (279, 4, [len(b) for b in blocks])]
    more, entries = b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, kind, held in sorted(tags):
        data = struct.pack(f"{order}{len(held)}{'H' if kind == 3 else 'I'}", *held)
        if len(data) > 4:
            data, more = struct.pack(order + "I", base + len(more)), more + data
        entries += struct.pack(order + "HHI", tag, kind, len(held)) + data.ljust(4, b"\0")
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + more)


@pytest.mark.parametrize("compression,down,across,order,differences", [(1, 3, None, "<", False), (5, 7, None, "<", True), (8, 1, None, ">", False), (8, 16, 16, "<", True), (32773, 5, None, ">", False), (5, 16, 32, ">", False)])
def test_blocks(tmp_path, compression, down, across, order, differences):
    rng = np.random.default_rng(down)
    values = rng.integers(-2000, 12000, (37, 90)).astype(np.int16)
    values[rng.random(values.shape) < 0.3] = -32767
    write(tmp_path / "g.tif", values, compression, down, across, order, differences)
    held = (tmp_path / "g.tif").read_bytes()
    grid = tiff.directory(lambda at, size: held[at : at + size])
    out = np.zeros_like(values)
    for i, (at, size) in enumerate(grid.ranges):
        top, left, part = tiff.block(held[at : at + size], grid, i)
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
    assert (grid.height, grid.width) == values.shape and (out == values).all()


def test_climatology_of_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    listed, cells = [], []
    for n, (year, month) in enumerate([(2015, 1), (2016, 1), (2015, 7)]):
        values = rng.integers(-500, 11000, (12, 20)).astype(np.int16)
        values[rng.random(values.shape) < 0.5] = -32767
        values[4:6, 4:6] = -32767
        write(tmp_path / f"{n}.tif", values, (8, 5, 1)[n], 3, (16, None, None)[n])
        listed.append((str(tmp_path / f"{n}.tif"), month))
        cells += [(year, month, i, j, None if values[i, j] == -32767 else float(values[i, j]) / 10000.0) for i in range(12) for j in range(20)]
    want = spatial.climatology(spark.createDataFrame(cells, "year int, month int, row int, col int, value double"), 2)
    got = spatial.coded(tiff.boxes(spark, listed, 2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 59
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.directory(lambda at, size: b"GIF89a.."[:size])

"""Whole texts as bytes: words, word hashes and the Arrow plumbing that the Python operators share.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and bytes from 0x80 on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)
#: Byte -> lower-cased byte, 0 outside words.
WORD_BYTES = _WORD
#: The same for bytes.translate, with blanks outside words.
WORD_TABLE = bytes(int(x) or 0x20 for x in _WORD)
#: Most bytes of text in an Arrow batch that is handled at once.
CHUNK_BYTES = 1 << 20


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows of about CHUNK_BYTES of text (a longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and the row bounds in them; a null has no bytes."""
    bounds = offsets_of(column)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return held, bounds - bounds[0]


def runs(kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero kind; no run crosses a bound."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(kinds) + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:-1])
    new[bounds] = True
    edges = np.flatnonzero(new)
    real = kinds[edges[:-1]] != 0
    return edges[:-1][real], edges[1:][real]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the public splitmix64 finaliser), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = random_words(256, 11)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; all bytes count, in their order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()) - 1, _BASE)]), dtype=np.uint64)
    values = _BYTE[lower[within + np.repeat(starts, sizes)]] * powers[within]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and the bounds of the rows in them."""
    data, bounds = joined(column)
    lower = WORD_BYTES[data]
    starts, ends = runs((lower != 0).view(np.uint8), bounds)
    return hashes(lower, starts, ends), np.searchsorted(starts, bounds)


def per_row(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc, empty: float | int) -> np.ndarray:
    """ufunc over the values of each row; ``empty`` for rows with none."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full])
    return out


def binary_text(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The given columns and the text as bytes, named __text and last."""
    from pyspark.sql import functions as F

    return df.select(*columns, F.col(text).cast("binary").alias("__text"))

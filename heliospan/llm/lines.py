"""Line dedup: two Bloom filters of line hashes, and an exact check of the lines that they suspect.

A line's key is the line without ASCII whitespace at both ends, A-Z lower-cased. Keys of ``least_points`` code points or
more that are found in ``least_docs`` documents or more lose all their lines but those of the largest document key.

1. Filters. A key sets two cells in a space of ``parts`` x 2^22 bits. Tasks send the cells of their distinct keys (four bytes
   a cell); the owner of a part keeps its bits of the once-seen filter, and a cell that comes again goes to the
   twice-seen filter. No cell of a repeated key is missed. Only the twice-seen filter leaves the tasks: folded to a size
   that follows its number of cells, ``MOST_BITS`` at most, which is what is collected and broadcast.
2. Suspects. Lines with both cells in the twice-seen filter go on with their whole keys, all others never leave their task.
   Suspects are grouped by key: (key, document) first, so that no task gets a hot key's rows.
3. Cut. Documents without a suspect are final; the others meet the list of their lines to drop, and lose them.

Filters that fill up only add suspects, never change a result: on a corpus far beyond ``parts``, lines go the exact way.

Defined results: a null text has one empty line and stays null; rows that share a document key are one document when
documents are counted, and all of its rows keep a line if it is the largest; a null document key is one document,
smaller than all others. An empty table gives an empty table. Texts of any length go through whole, one at a time.
Other columns pass through; columns named as ``OUT`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospan.llm.common import extended, saved, table
from heliospan.llm.texts import pieces

OUT = ("n_lines", "n_dropped")
#: Bits of the once-seen filter in one part, as a power of two.
PART_BITS = 22
PARTS = 512
#: Bits of the broadcast filter, as a power of two: 32 MB.
MOST_BITS = 28
#: Hashes that a task gathers before it sends their cells.
HELD = 1 << 20


def keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line whose key has so many code points."""
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip()
        if len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least):
            yield i, key


def cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash in a space of 2^bits."""
    down = np.uint64(64 - bits)
    return hashes >> down, (hashes * np.uint64(0x9E3779B97F4A7C15)) >> down


def _contributions(lines: DataFrame, least: int, space: int) -> DataFrame:
    """(part, once, twice): cells of the distinct keys of a task, and of those that it has in more than one row."""

    def send(held: list[int]) -> pa.RecordBatch:
        seen, times = np.unique(np.array(held, np.uint64), return_counts=True)
        sent = []
        for some in (seen, seen[times > 1]):
            at = np.unique(np.concatenate(cells(some, space)))
            cuts = np.searchsorted(at, np.arange((1 << (space - PART_BITS)) + 1, dtype=np.uint64) << np.uint64(PART_BITS))
            sent.append(((at & np.uint64((1 << PART_BITS) - 1)).astype("<u4"), cuts))
        (once, cut), (twice, cut2) = sent
        found = np.flatnonzero(cut[1:] > cut[:-1])
        rows = [[a[c[p] : c[p + 1]].tobytes() for p in found] for a, c in ((once, cut), (twice, cut2))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], names=["part", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for batch in pieces(batches, 0):
            for text in batch.column(0):
                held.extend({xxhash.xxh3_64_intdigest(k) for _, k in keys(text.as_py() or b"", least)})
                if len(held) >= HELD:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    return lines.mapInArrow(run, "part int, once binary, twice binary")


def _seen_twice(sent: DataFrame) -> DataFrame:
    """(part, cells): the twice-seen filter of each part, as its set cells. A task holds the filters of one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = -1, np.zeros(1 << PART_BITS, bool), np.zeros(1 << PART_BITS, bool)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(twice).astype("<u4").tobytes()
            once[:], twice[:] = False, False
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.binary())], names=["part", "cells"])

        for batch in batches:
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part >= 0:
                        yield done()
                    part = p
                here = np.frombuffer(a, "<u4")
                twice[here[once[here]]] = True
                once[here] = True
                twice[np.frombuffer(b, "<u4")] = True
        if part >= 0:
            yield done()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, cells binary")


def twice_seen(lines: DataFrame, least: int = 20, parts: int = PARTS, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """The twice-seen filter of a one-column table of binary texts: its bytes (bit i is bit i % 8 of byte i // 8), and the
    power of two that is its number of bits. parts: a power of two."""
    space = PART_BITS + parts.bit_length() - 1
    twice = saved(_seen_twice(_contributions(lines, least, space)), "lines-twice")
    total = twice.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
    bits = max(space - PART_BITS + 3, min(most_bits, space, (4 * total).bit_length()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.zeros(1 << (bits - space + PART_BITS), np.uint8)
                own[np.frombuffer(held, "<u4") >> (space - bits)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((parts, (1 << bits) // parts // 8), np.uint8)
    for row in twice.mapInArrow(fold, "part int, bits binary").toLocalIterator():  # 2^bits / 8 bytes in all
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1), bits


def _marked(df: DataFrame, at: int, least: int, seen: np.ndarray, bits: int) -> DataFrame:
    """df with n_lines and the suspected keys of each row with the numbers of their lines."""
    held = df.sparkSession.sparkContext.broadcast(seen)
    schema = extended(df, "__n long, __suspects array<struct<key:string,lines:array<int>>>")
    kind = pa.list_(pa.struct([("key", pa.string()), ("lines", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = held.value
        for batch in pieces(batches, at):
            rows, numbers, found, counts = [], [], [], []
            for r, text in enumerate(batch.column(at).cast(pa.binary())):
                text = text.as_py() or b""
                counts.append(text.count(b"\n") + 1)
                own = list(keys(text, least))
                rows.extend([r] * len(own))
                numbers.extend(i for i, _ in own)
                found.extend(k for _, k in own)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in found), np.uint64, len(found))
            hit = np.ones(len(found), bool)
            for c in cells(hashes, bits):
                hit &= (test[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            suspects: list[dict[bytes, list[int]]] = [{} for _ in range(batch.num_rows)]
            for i in np.flatnonzero(hit):
                suspects[rows[i]].setdefault(found[i], []).append(numbers[i])
            made = pa.array([[{"key": k.decode(), "lines": v} for k, v in s.items()] for s in suspects], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), made], names=schema.names)

    return df.mapInArrow(run, schema)


def drop_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", least_points: int = 20, least_docs: int = 3, parts: int = PARTS) -> DataFrame:
    """df with the text left after the cut, n_lines (before it) and n_dropped."""
    names = [c for c in df.columns if c not in OUT]
    inner = [f"__{i}" for i in range(len(names))]  # columns may have the names made here
    doc, at = f"__{names.index(key)}", names.index(text)
    held = df.select(*(F.col(f"`{c}`") for c in names)).toDF(*inner)
    seen, bits = twice_seen(held.select(F.col(f"__{at}").cast("binary")), least_points, parts)
    # rows with the same document key and text lose the same lines: they need one list
    own = F.md5(F.concat_ws("|", F.col(doc).isNull().cast("string"), F.col(doc).cast("string"), F.col(f"__{at}")))
    marked = saved(_marked(held, at, least_points, seen, bits).withColumn("__own", F.when(F.size("__suspects") > 0, own)), "lines-marked")

    lines = marked.where(F.size("__suspects") > 0).select(F.col(doc).alias("doc"), "__own", F.inline("__suspects"))
    by_doc = lines.groupBy("key", "doc").agg(F.lit(1).alias("one"))
    repeated = by_doc.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= least_docs)
    lost = lines.join(repeated, "key").where(F.col("doc").isNull() | (F.col("doc") < F.col("last")))
    lost = lost.groupBy("__own").agg(F.flatten(F.collect_set("lines")).alias("__lost"))

    final = marked.where(F.size("__suspects") == 0).select(*inner, F.col("__n").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    open_ = marked.where(F.size("__suspects") > 0).drop("__suspects").join(lost, "__own", "left").select(*inner, "__n", "__lost")
    return final.union(_cut(open_, inner, at)).toDF(*names, *OUT)


def _cut(df: DataFrame, inner: list[str], at: int) -> DataFrame:
    schema = T.StructType([*df.select(*inner).schema.fields, *T.StructType.fromDDL("n_lines long, n_dropped long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            lost, n = batch.column(len(inner) + 1), batch.column(len(inner))
            texts = batch.column(at).to_pylist()
            for r, numbers in enumerate(lost.to_pylist()):
                if numbers:
                    out = set(numbers)
                    texts[r] = "\n".join(x for i, x in enumerate(texts[r].split("\n")) if i not in out)
            columns = list(batch.columns[: len(inner)])
            columns[at] = pa.array(texts, columns[at].type)
            dropped = pa.array([len(x or ()) for x in lost.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, n, dropped], names=schema.names)

    return df.mapInArrow(run, schema)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted, the lines that repeat across documents dropped, and the digest of the rest."""
    kept = drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, r, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM doc),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND (doc_id IS NULL OR doc_id < last)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key) GROUP BY r"""

"""Suffix-array dedup: removal of every byte covered by a string of ``THRESHOLD`` bytes that also starts elsewhere.

No suffix is sorted: seed bundles with hash grouping stand in for the radix passes of a suffix sort, and the "digits"
below are hashes by which windows are grouped, never bytes in their order. Groups of one drop out after each pass, and what is still together after the last pass are exactly the repeated windows. So that not every byte needs a
row, windows are grouped in bundles: the first digit of a window is its seed, the leftmost of its SEED-byte strings with
the least hash. Equal windows have equal seeds at equal offsets, and consecutive windows with one seed are one bundle
(about one for 85 bytes).

  pass 1  digit: the seed. Seeds that occur once settle their bundles: nothing repeats.
  pass 2  digit: all bytes of a bundle's windows. Bundles equal to another settle: all their windows repeat.
  pass 3  digit: the whole window, for the bundles left (near the ends of repeated passages) and one of each settled
          class beside them. Seeds with up to LOCAL different bundles are compared in one task, others as rows that
          Spark counts, so no task holds a hot seed.

Digits are compared by 64-bit hashes, two independent ones where all of the corpus is in play; the windows of pass 3 by
one hash within a seed, not byte by byte. Counts are combined
before the shuffle, and hot keys only meet in joins that adaptive execution splits. The text is shuffled once.

Defined results: a null text is empty. Texts under THRESHOLD bytes lose nothing. Repeated rows are texts that repeat
each other. Matches never cross texts, and overlapping ones within a text count. A very long text goes through in pieces that
overlap by a window, so none of its windows is lost. Extra columns do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import discard, saved, table
from heliospan.llm.texts import joined, mix, pieces, random_words

THRESHOLD = 200
SEED = 32
#: Most different bundles of a seed that one task compares.
LOCAL = 4096
#: Bytes of text, or members, that numpy handles at once.
PIECE = 1 << 20
_FACTORS = random_words(32, 5)
_PLACE = np.uint64((1 << 24) - 1)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from every position."""
    n = len(data)
    m = n - SEED + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    held = np.zeros(n + 16, np.uint8)
    held[:n] = data
    eight = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        own = eight[r::8]
        own[:] = held[r : r + 8 * len(own)].view(np.uint64)
    eight *= _FACTORS[0]
    eight ^= eight >> np.uint64(29)
    out = eight[:m] * _FACTORS[1]
    for i in range(1, SEED // 8):
        out += eight[8 * i : 8 * i + m] * _FACTORS[1 + i]
    out ^= out >> np.uint64(32)
    out *= _FACTORS[6]
    out ^= out >> np.uint64(29)
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _long_hash(seeds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of the strings of the given sizes (SEED bytes at least)."""
    out = salt * _FACTORS[7] + sizes.astype(np.uint64) * _FACTORS[8]
    for j in range(int(sizes.max()) // SEED if len(sizes) else 0):
        inside = np.flatnonzero(SEED * (j + 1) <= sizes)
        out[inside] += seeds[starts[inside] + SEED * j] * _FACTORS[9 + j]
    out += seeds[starts + sizes - SEED] * _FACTORS[31]
    return mix(out)


def bundles(data: np.ndarray, bounds: np.ndarray, threshold: int = THRESHOLD) -> dict[str, np.ndarray]:
    """The bundles of the texts between the bounds: row, seed hash, hash of all bytes, place of the seed, window starts lo to hi."""
    width = threshold - SEED + 1
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "seed", "all", "place", "lo", "hi")}
    for first, last in _spans(bounds, threshold):
        held = data[first:last]
        if len(held) < threshold:
            continue
        seeds = seed_hashes(held)
        least = _sliding_min((seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64), width)
        at = (least & _PLACE).astype(np.int64)
        inner = bounds[np.searchsorted(bounds, first, "right") : np.searchsorted(bounds, last)] - first
        new = np.ones(len(at) + 1, bool)
        np.not_equal(at[1:], at[:-1], out=new[1:-1])
        new[inner[inner < len(at)]] = True
        stops = np.append(inner, len(held)) - threshold + 1  # no window from here to the end of the text
        new[stops[(stops > 0) & (stops < len(at))]] = True
        lo = np.flatnonzero(new)
        lo, hi = lo[:-1], lo[1:] - 1
        row = np.searchsorted(bounds, lo + first, "right") - 1
        fits = lo + first + threshold <= bounds[row + 1]
        lo, hi, row = lo[fits], hi[fits], row[fits]
        place = at[lo]
        parts["row"].append(row)
        parts["seed"].append(seeds[place])
        parts["all"].append(_long_hash(seeds, lo, hi - lo + threshold, (place - lo).astype(np.uint64)))
        for k, v in (("place", place), ("lo", lo), ("hi", hi)):
            parts[k].append(v + first - bounds[row])  # from the start of the text
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("seed", "all") else np.int64) for k, v in parts.items()}


def _spans(bounds: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE: whole texts, or pieces of one text that overlap by threshold - 1 bytes."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1)
        if bounds[j] - bounds[i] <= 2 * PIECE:
            yield int(bounds[i]), int(bounds[j])
        else:
            for a in range(int(bounds[i]), int(bounds[j]), PIECE):
                yield a, min(int(bounds[j]), a + PIECE + threshold - 1)
        i = j


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _bundle_rows(docs: DataFrame, threshold: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            b = bundles(*joined(batch.column(2)), threshold)
            where = b["place"] << 16 | (b["place"] - b["hi"]) << 8 | (b["place"] - b["lo"])
            rows = pa.array(b["row"])
            yield pa.RecordBatch.from_arrays([_signed(b["seed"]), _signed(b["all"]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(where)], names=["seed", "all", "k1", "k2", "at"])

    return docs.mapInArrow(make, "seed long, all long, k1 long, k2 long, at long")


def _contexts(found: DataFrame, threshold: int) -> DataFrame:
    """found: k1, k2, text, members (seed, at, open, hot). One row for each member, with the bytes around its seed."""
    left = threshold - SEED
    size = left + threshold

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "k1", "k2", "at", "open", "hot", "around"]
        for batch in pieces(batches, 2):
            data, bounds = joined(batch.column(2))
            members = batch.column(3)
            offsets = members.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(members)), np.diff(offsets))
            flat = members.flatten()
            at = flat.field("at").to_numpy()
            for a in range(0, len(row), 1 << 13):
                r = row[a : a + (1 << 13)]
                where = (bounds[r] + (at[a : a + (1 << 13)] >> 16) - left)[:, None] + np.arange(size)
                outside = (where < bounds[r][:, None]) | (where >= bounds[r + 1][:, None])
                bytes_ = data[np.clip(where, 0, len(data) - 1)]
                bytes_[outside] = 0xFF
                ends = pa.array(np.arange(len(r) + 1, dtype=np.int32) * size)
                around = pa.BinaryArray.from_buffers(pa.binary(), len(r), [None, ends.buffers()[1], pa.py_buffer(bytes_.tobytes())])
                own = flat.slice(a, len(r))
                rows = pa.array(r)
                yield pa.RecordBatch.from_arrays([own.field("seed"), batch.column(0).take(rows), batch.column(1).take(rows), own.field("at"), own.field("open"), own.field("hot"), around], names=names)

    return found.mapInArrow(make, "seed long, k1 long, k2 long, at long, open boolean, hot boolean, around binary")


def window_hashes(around: np.ndarray, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each bundle: the member, the offset of the seed in it, and its hash. around: (members, bytes)."""
    left = threshold - SEED
    size = around.shape[1]
    seeds = seed_hashes(np.ascontiguousarray(around).reshape(-1))
    first, last = at >> 8 & 0xFF, at & 0xFF
    count = last - first + 1
    member = np.repeat(np.arange(len(at)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    start = member * size + left - offset
    return member, offset, _long_hash(seeds, start, np.full(len(start), threshold), np.zeros(len(start), np.uint64))


def _compare(contexts: DataFrame, threshold: int) -> DataFrame:
    """Windows of open members that occur elsewhere; the members of a seed come one after the other."""
    size = 2 * threshold - SEED

    def spans(rows: pa.Table) -> pa.RecordBatch:
        at = rows.column("at").to_numpy()
        around = joined(_flat(rows.column("around")))[0].reshape(-1, size)
        member, offset, hashed = window_hashes(around, at, threshold)
        order = np.argsort(hashed, kind="stable")
        same = hashed[order][1:] == hashed[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= _flat(rows.column("open")).to_numpy(zero_copy_only=False)[member]
        start = ((at[member] >> 16) - offset)[twice]
        member = member[twice]
        lo, hi, member = _merge(member, start)
        rows_at = pa.array(member)
        return pa.RecordBatch.from_arrays([_flat(rows.column("k1")).take(rows_at), _flat(rows.column("k2")).take(rows_at), pa.array(lo), pa.array(hi)], names=["k1", "k2", "lo", "hi"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * LOCAL):
                part = batch.slice(a, 4 * LOCAL)
                if not part.num_rows:
                    continue
                held.append(part)
                n += part.num_rows
                if n < 4 * LOCAL:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                seeds = rows.column("seed").to_numpy()
                cut = int(np.searchsorted(seeds, seeds[-1]))  # sorted: the last seed may go on in the next batch
                if cut:
                    yield spans(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                n = rows.num_rows - cut
        if n:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return contexts.mapInArrow(compare, "k1 long, k2 long, lo long, hi long")


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _merge(member: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts of one member."""
    if not len(member):
        return start, start, member
    order = np.lexsort((start, member))
    member, start = member[order], start[order]
    new = np.append(True, (member[1:] != member[:-1]) | (start[1:] > start[:-1] + 1))
    first = np.flatnonzero(new)
    return start[first], start[np.append(first[1:], len(start)) - 1], member[first]


def _hot_windows(contexts: DataFrame, threshold: int) -> DataFrame:
    """Each window of the members of hot seeds as a row, counted by Spark."""
    size = 2 * threshold - SEED

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, LOCAL):
                batch = whole.slice(a, LOCAL)
                at = batch.column("at").to_numpy()
                member, offset, hashed = window_hashes(joined(batch.column("around"))[0].reshape(-1, size), at, threshold)
                rows = pa.array(member)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("seed").take(rows), _signed(hashed), batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array((at[member] >> 16) - offset), batch.column("open").take(rows)],
                    names=["seed", "window", "k1", "k2", "lo", "open"],
                )

    rows = saved(contexts.mapInArrow(make, "seed long, window long, k1 long, k2 long, lo long, open boolean"), "repeats-windows")
    # written, so that the join reads two plain exchanges, which adaptive execution can split at a hot window
    twice = saved(rows.groupBy("seed", "window").agg(F.count("*").alias("n")).where("n > 1").select("seed", "window"), "repeats-twice")
    return rows.where("open").join(twice, ["seed", "window"]).select("k1", "k2", "lo", F.col("lo").alias("hi"))


def repeated(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """docs: k1, k2 (longs that tell texts apart) and text as bytes. Returns (bundle members that may repeat, spans).

    spans: k1, k2 and the array of [lo, hi] ranges of starts of repeated windows.
    """
    rows = saved(_bundle_rows(docs, threshold), "repeats-bundles")
    # written, so that the join below reads two plain exchanges, which adaptive execution can split at a hot seed
    seeds = saved(rows.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "repeats-digits")
    again = saved(rows.join(seeds, "seed", "left_semi"), "repeats-seeds")
    discard(rows)
    discard(seeds)
    kinds = again.groupBy("seed", "all").agg(F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("at").alias("at"))
    kinds = saved(kinds, "repeats-kinds")
    mixed = kinds.groupBy("seed").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1)).alias("any_open")).where("kinds > 1 and any_open")
    members = kinds.join(mixed, "seed").select("k1", "k2", F.struct("seed", "at", (F.col("n") == 1).alias("open"), (F.col("kinds") > LOCAL).alias("hot")).alias("m"))
    members = members.groupBy("k1", "k2").agg(F.collect_list("m").alias("members"))
    found = docs.join(members.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "members")
    contexts = saved(_contexts(found, threshold), "repeats-contexts")
    here = contexts.where("not hot").repartition("seed").sortWithinPartitions("seed")
    spans = _compare(here, threshold).union(_hot_windows(contexts.where("hot"), threshold))
    settled = again.join(kinds.where("n > 1").select("seed", "all"), ["seed", "all"])
    place = F.shiftright("at", 16)
    settled = settled.select("k1", "k2", (place - F.col("at").bitwiseAND(255)).alias("lo"), (place - F.shiftright("at", 8).bitwiseAND(255)).alias("hi"))
    spans = spans.union(settled).distinct().repartition("k1", "k2").sortWithinPartitions("k1", "k2", "lo")
    spans = _joined_spans(spans, threshold).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return members, spans


def _joined_spans(spans: DataFrame, threshold: int) -> DataFrame:
    """spans in order, those of one text that touch as one: at most a span for each threshold of bytes is collected later."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None
        for batch in batches:
            out: list[list[int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[:2] == list(row[:2]) and row[2] <= now[3] + threshold:
                    now[3] = max(now[3], row[3])
                else:
                    if now is not None:
                        out.append(now)
                    now = list(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=batch.schema.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in now], names=["k1", "k2", "lo", "hi"])

    return spans.select("k1", "k2", "lo", "hi").mapInArrow(merge, "k1 long, k2 long, lo long, hi long")


def covered(spans: list[dict[str, int]], threshold: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + threshold) for s in spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """key, kept_text (binary), removed (array of byte ranges [start, end)) for every row of docs."""
    held = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    keyed = held.select("k1", "k2", "text")
    _, spans = repeated(keyed, threshold)
    found = held.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("key", "text", "spans")
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            kept, gone = [], []
            for value, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                value = value.as_py()
                ranges = covered(spans, threshold) if spans else []
                edges = [0, *(x for r in ranges for x in r), len(value)]
                kept.append(b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if ranges else value)
                gone.append([{"start": a, "end": b} for a, b in ranges])
            made = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), made], names=["key", "kept_text", "removed"])

    return found.mapInArrow(cut, f"key {kind}, kept_text binary, removed array<struct<start:bigint,end:bigint>>").withColumnRenamed("key", key)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 200-byte strings."""
    kept = remove(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return kept.select(
        "doc_id",
        (F.octet_length("kept_text") + gone).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()

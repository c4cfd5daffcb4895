"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Items and documents are word sequences (see ``texts``). Each document's words stream through the automaton, which keeps
the longest suffix of what was read that occurs in any item. Where that match reaches ``window`` words, its last
``window`` words are a hit; an item of fewer words is a hit where it ends. Spans of hit words longer than a limit, or
documents with more than a share of hit words, can be removed by ``clean``.

An automaton has at most 2n states for n words and is built on the driver only for items under ``shard_words``; larger
item sets are split into several automata (a longer item into pieces that share the words of a window less one, so that
each of its windows is in one). Then a Bloom filter of all windows, made in tasks, picks the documents that may be hit, and only
these are written to the shared folder and pass through one automaton after the other; all others are final after one read.
What is broadcast has a bound whatever the size of the item table: an automaton, or the filter of 2^MOST_BITS bits (128 MB) at most.
Beyond some 30 million windows the filter fills up and lets more documents through; the result is the same.

Defined results: a null or empty text has no words and no hits; null or empty items match nothing; repeated items and
item ids count once each; an item with a null id is named 'null', like one with that id; an empty item table hits nothing.
A long text streams through by itself, and an item may have any length. Columns named as those made here are replaced;
other columns of the documents are not touched.
Documents with the same id are judged on their own.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import discard, extended, saved, table
from heliospan.llm.lines import cells
from heliospan.llm.texts import WORD_TABLE, mix, pieces, random_words, word_hashes, words

WINDOW = 10
#: Most item words in one automaton: about 250 MB on the driver and in each Python worker at the bound.
SHARD_WORDS = 250_000
#: Bits of the filter of windows and of one of its parts, as powers of two.
MOST_BITS, PART_BITS = 30, 22
MADE = "hit_words long, hit_spans array<struct<start:int,end:int>>, hit_items array<string>"


class Automaton:
    """Generalised suffix automaton over word sequences, with the items in which each window occurs."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[str] = []
        self.shortest = window
        ends: list[tuple[int, int, int]] = []  # (state, item, words): prefixes of items
        for item, sequence in items:
            if not sequence:
                continue
            number, last = len(self.ids), 0
            self.ids.append(item)
            self.shortest = min(self.shortest, len(sequence))
            for i, word in enumerate(sequence):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary) + 1))
                if i + 1 >= window or i + 1 == len(sequence):
                    ends.append((last, number, min(window, i + 1)))
        self._mark(ends)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _mark(self, ends: list[tuple[int, int, int]]) -> None:
        """hits[state]: the windows that end where the state's strings end, as (words, items); longest first."""
        held: dict[tuple[int, int], set[int]] = {}
        for state, item, size in ends:
            # the state of the suffix with ``size`` words: up the links while the parent still holds it
            while self.length[self.link[state]] >= size if self.link[state] >= 0 else False:
                state = self.link[state]
            held.setdefault((state, size), set()).add(item)
        own: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for (state, size), found in held.items():
            own.setdefault(state, []).append((size, tuple(sorted(found))))
        self.hits: list[tuple] = [()] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.hits[self.link[state]] if self.link[state] >= 0 else ()
            self.hits[state] = (*sorted(own.get(state, ()), reverse=True), *above) if state in own else above

    def match(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Streams word numbers (none is 0); adds the hit spans, from base on, and the items."""
        state = length = 0
        next_, link, lengths, hits = self.next, self.link, self.length, self.hits
        for i, c in enumerate(ids, base + 1):
            while c not in next_[state]:
                state = link[state]
                if state < 0:
                    break
                length = lengths[state]
            if state < 0:
                state = length = 0
                continue
            state = next_[state][c]
            length += 1
            for size, items in hits[state]:
                if size <= length:
                    if spans and spans[-1][1] >= i - size:
                        start = min(spans.pop()[0], i - size)
                        while spans and spans[-1][1] >= start:
                            start = min(spans.pop()[0], start)
                        spans.append((start, i))
                    else:
                        spans.append((i - size, i))
                    found.update(items)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, disjoint hit spans in words, ids of the items whose windows occur."""
        sequence = words(text)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(sequence) >= self.shortest and self.ids:
            known = np.fromiter(map(self.vocabulary.get, sequence, _zeros()), np.int64, len(sequence))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (known > 0).view(np.int8), [0]])))
            starts, ends = edges[::2], edges[1::2]
            for a, b in zip(*(x[ends - starts >= self.shortest].tolist() for x in (starts, ends)), strict=True):
                self.match(known[a:b].tolist(), a, spans, found)
        return len(sequence), spans, [self.ids[i] for i in found]


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def _shards(items: DataFrame, item_id: str, text: str, shard_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in lists of at most shard_words words. One list and one item are held at a time."""
    held, size = [], 0
    step = max(1, shard_words - window + 1)
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    for row in rows.distinct().orderBy("i", "t").toLocalIterator():
        whole = words(bytes(row["t"]))
        # the pieces of an item that is too long begin a window before its end at the latest
        for at in range(0, max(1, len(whole) - window + 1), step):
            sequence = whole if len(whole) <= shard_words else whole[at : at + step + window - 1]
            if held and size + len(sequence) > shard_words:
                yield held
                held, size = [], 0
            held.append((row["i"] if row["i"] is not None else "null", sequence))
            size += len(sequence)
            if sequence is whole:
                break
    yield held


def _windows(column: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, hashes of the runs of so many words of the texts and the rows that they are in; and the words of each row."""
    hashed, bounds = word_hashes(column)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    left = bounds[1:][row] - np.arange(len(row))
    for k in sizes:
        n = max(0, len(hashed) - k + 1)
        total = np.full(n, k, np.uint64)
        for j, factor in enumerate(random_words(k, 31)):
            total += hashed[j : j + n] * factor
        within = left[:n] >= k
        yield mix(total[within]), row[:n][within], counts


def _four(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    return [*cells(hashed, bits), *cells(mix(hashed.copy()), bits)]


def window_filter(items: DataFrame, text: str, window: int, most_bits: int = MOST_BITS) -> tuple[np.ndarray, list[int]]:
    """Bloom filter of the windows of all items (its bytes; bit i is bit i % 8 of byte i // 8), and the sizes of windows that there are.

    Tasks hash the windows and send their cells by parts of the filter; a task holds one part at a time.
    """
    texts = items.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            n = next(_windows(batch.column(0), [1]))[2]
            n = n[n > 0]
            size = np.minimum(n, window)
            made = np.bincount(size, n - size + 1, window + 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(window + 1), pa.int32()), pa.array(made)], names=["size", "n"])

    found = texts.mapInArrow(count, "size int, n long").groupBy("size").agg(F.sum("n").alias("n")).where("n > 0").collect()
    sizes = sorted(r["size"] for r in found)
    bits = max(PART_BITS, min(most_bits, (16 * sum(r["n"] for r in found)).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            at = []
            for k, (hashed, rows, n) in zip(sizes, _windows(batch.column(0), sizes), strict=True):
                # a shorter size is that of whole items alone
                at += _four(hashed if k == window else hashed[n[rows] == k], bits)
            at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.uint64)
            cut = np.searchsorted(at, np.arange((1 << (bits - PART_BITS)) + 1, dtype=np.uint64) << np.uint64(PART_BITS))
            at = (at & np.uint64((1 << PART_BITS) - 1)).astype("<u4")
            parts = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([at[cut[p] : cut[p + 1]].tobytes() for p in parts], pa.binary())], names=["part", "cells"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = -1, np.zeros(1 << PART_BITS, np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])
        for batch in batches:
            for p, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part >= 0:
                        yield done()
                    part = p
                    own[:] = 0
                own[np.frombuffer(at, "<u4")] = 1
        if part >= 0:
            yield done()

    out = np.zeros((1 << (bits - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    sent = texts.mapInArrow(send, "part int, cells binary").repartition("part").sortWithinPartitions("part")
    for row in sent.mapInArrow(fold, "part int, bits binary").toLocalIterator():  # 2^bits / 8 bytes in all
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1), sizes


def _suspected(docs: DataFrame, text: str, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """docs with the columns of ``hits``: those of documents that no item can hit are final, spans and items of the others are null."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema, at, bits = extended(docs, MADE), docs.columns.index(text), len(bitmap).bit_length() + 2

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, seen = to_arrow_schema(schema), held.value
        for batch in pieces(batches, at):
            column = batch.column(at).cast(pa.binary())
            suspect, counts = np.zeros(len(column), bool), next(_windows(column, [1]))[2]
            for hashed, rows, _ in _windows(column, sizes):
                for c in _four(hashed, bits):
                    held_here = (seen[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    rows = np.where(held_here, rows, -1)
                suspect[rows[rows >= 0]] = True
            lists = [None if x else [] for x in suspect.tolist()]
            made = [pa.array(x, kinds.field(k).type) for k, x in zip(("hit_words", "hit_spans", "hit_items"), (counts, lists, lists), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in kinds])

    return docs.mapInArrow(test, schema)


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with hit_words (long: n_words), hit_spans (array of word spans [start, end)) and hit_items (array of ids).

    Map-only where one automaton holds the items; else that goes for all documents that no window can be in.
    """
    context = docs.sparkSession.sparkContext
    out = docs.drop("hit_words", "hit_spans", "hit_items")
    shards = _shards(items, item_id, item_text, shard_words, window)
    shard, following = next(shards), next(shards, None)
    if following is None:
        return _pass(out, text, context.broadcast(Automaton(shard, window)), True)
    marked = _suspected(out, text, *window_filter(items, item_text, window))
    suspects = saved(marked.where(F.col("hit_spans").isNull()), "decontaminate")
    for shard in itertools.chain((shard, following), shards):
        held = context.broadcast(Automaton(shard, window))
        before, suspects = suspects, saved(_pass(suspects, text, held, False), "decontaminate")
        discard(before)
        held.destroy()
    return marked.where(F.col("hit_spans").isNotNull()).unionByName(suspects)


def _pass(docs: DataFrame, text: str, automaton: Broadcast, first: bool) -> DataFrame:
    schema = extended(docs, MADE) if first else docs.schema
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in pieces(batches, at):
            n, spans, found = [], [], []
            for i, value in enumerate(batch.column(at).cast(pa.binary())):
                size, s, f = automaton.value.scan(value.as_py())
                if not first:
                    s = _union(s + [(x["start"], x["end"]) for x in batch.column("hit_spans")[i].as_py() or ()])
                    f = sorted({*f, *(batch.column("hit_items")[i].as_py() or ())})
                n.append(size)
                spans.append([{"start": a, "end": b} for a, b in s])
                found.append(sorted(set(f)))
            kept = batch.columns if first else batch.columns[:-3]
            made = [pa.array(x, kinds.field(k).type) for k, x in zip(("hit_words", "hit_spans", "hit_items"), (n, spans, found), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in kinds])

    return docs.mapInArrow(scan, schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between the words of one span."""
    blank = text.translate(WORD_TABLE)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.frombuffer(blank, np.uint8) != 0x20).view(np.int8), [0]])))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : edges[2 * a]])
        at = int(edges[2 * b - 1])
    return b"".join([*out, text[at:]])


#: Words of the least hit span that ``clean`` removes. Spans under WINDOW are whole short items.
LEAST_CUT = 5


def clean(docs: DataFrame, items: DataFrame, text: str = "text", longest: int = LEAST_CUT, coverage: float = 0.5, **options: object) -> DataFrame:
    """docs without hit spans of ``longest`` words or more; documents with a larger share of hit words than ``coverage`` go.

    A whole occurrence of an item of under WINDOW words is a hit span, so those of ``longest`` words or more go too. Shorter
    items are common phrases that clean documents hold as well: they stay, and only count for the coverage.

    Returns the columns of docs. Texts with no such span stay as they are, null ones too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    inner = [f"__{i}" for i in range(len(names))]  # columns may have the names made here
    found = hits(docs.toDF(*inner), items, f"__{names.index(text)}", **options)
    share = F.aggregate("hit_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]) / F.greatest(F.col("hit_words"), F.lit(1))
    found = found.where(share <= coverage).withColumn("hit_spans", F.filter("hit_spans", lambda s: s["end"] - s["start"] >= longest))
    at, schema = names.index(text), docs.schema

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in pieces(batches, at):
            columns = batch.columns[: len(names)]
            spans = batch.column(len(names)).to_pylist()
            if any(spans):
                values = [t if not s else cut(t.encode(), [(x["start"], x["end"]) for x in s]).decode() for t, s in zip(columns[at].to_pylist(), spans, strict=True)]
                columns[at] = pa.array(values, kinds.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*inner, "hit_spans").mapInArrow(trim, schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    from heliospan.llm.texts import binary_text

    docs = binary_text(table(spark, sf_dir, "documents"), "doc_id")
    found = hits(docs, table(spark, sf_dir, "benchmark"), text="__text")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def digest(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = rf"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW}, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS win
  FROM item WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM doc, sizes WHERE len(w) >= n),
found AS (SELECT r, g.n, i, item_id FROM grams g JOIN windows USING (win) WHERE g.n = windows.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN ids USING (r)"""

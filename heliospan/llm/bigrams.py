"""Full word bigrams: target and background counts of every word and word pair of the corpus, and each document's losses.

Nothing is left out of the counts: the vocabulary is every word (known by its 64-bit hash), and every pair (v, w) of
neighbouring words of a document has a count of its own in each model. With n(v.) the pairs that start with v,

  P(w | v) = (n(v, w) + S P(w)) / (n(v.) + S),   P(w) = (n(w) + A) / (n + A (V + 1)),

which sums to 1 over the V words and the unknown one. The first word of a document costs -log P(w). The counts that a
document itself gave to a model are left out of n when that model scores it, so that it is not praised for its own words.

Counts are summed and looked up in one exchange. Texts are cut to chunks of whole documents (saved as Parquet, as
numbers of the chunk's words); a chunk sends its distinct words and pairs with their counts, packed and cut by ranges
of the key, to the buckets of these ranges; a bucket sums them over all chunks and answers each chunk in the order in
which it asked. A word or pair, however common, is sent once by a chunk, so no key is hot. Buckets and chunks have a
bounded size, their number grows with the corpus, and nothing is collected but sums.

Defined results: a null text or one with no word has no tokens and losses 0. A null target flag is background. With no
target (or no background) rows that model is uniform. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospan.llm.common import saved
from heliospan.llm.texts import mix, per_row, pieces, word_hashes

#: Words of a chunk (a longer document stays whole: its words, 8 bytes each, are held by one task), and words of the corpus for each bucket.
CHUNK_WORDS, BUCKET_WORDS = 1_000_000, 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of one kind: their number, then their bytes by significance, compressed."""
    head = len(values).to_bytes(8, "little")
    return head + pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), "zstd", asbytes=True) if len(values) else head


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _sums(at: np.ndarray, counts: list[np.ndarray], n: int) -> np.ndarray:
    return np.stack([np.bincount(at, c, n).astype(np.int64) for c in counts])


def chunks(docs: DataFrame, key: str, chunk_words: int) -> DataFrame:
    """docs: key, target, text as bytes -> chunks with keys, words and flag by document, distinct words, numbers of words."""
    schema = T.StructType([T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), *T.StructType.fromDDL("chunk long, t long, b long, sizes binary, flags binary, words binary, numbers binary").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, *_ in held])
            flags = np.concatenate([f for _, f, *_ in held])
            sizes = np.concatenate([s for *_, s, _ in held])
            words, at = np.unique(np.concatenate([h for *_, h in held]), return_inverse=True)
            t = int(sizes[flags].sum())
            rest = [made, t, int(sizes.sum()) - t, packed(sizes), packed(flags.view(np.uint8)), packed(words), packed(at.astype(np.uint32))]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(pa.array([x]) for x in rest)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in pieces(batches, 2):
            hashed, bounds = word_hashes(batch.column(2))
            held.append((batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds).astype(np.int64), hashed))
            size += len(hashed) + batch.num_rows
            if size >= chunk_words:
                yield row()
                held, size, made = [], 0, made + 1
        if held:
            yield row()

    return docs.mapInArrow(cut, schema)


def _neighbours(words: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the pairs, the place of each pair's second word, and the places of the documents' last words."""
    ends = np.cumsum(sizes)
    inner = np.ones(len(numbers), bool)
    inner[(ends - sizes)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    return mix(words[numbers[at - 1]] * _BASE + words[numbers[at]]), at, ends[sizes > 0] - 1


def _own_counts(doc: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each place, how often its document holds its kind."""
    if not len(kind):
        return np.zeros(0, np.int64)
    _, at, n = np.unique(doc * (int(kind.max()) + 1) + kind, return_inverse=True, return_counts=True)
    return n[at]


def _asked(cut: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk, a row for each bucket in which it has keys: distinct words and pairs in the order of their keys, and
    their counts. A chunk has a bounded number of keys, so both rows and steps grow with the corpus, not with chunks times buckets."""
    def cuts(keys: np.ndarray) -> dict[int, slice]:
        """The runs of sorted keys that lie in one bucket each: no more than keys, however many buckets there are."""
        if not len(keys):
            return {}
        # the bucket of a key from its upper half, in whole numbers: (key >> 32) * buckets >> 32
        own = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        starts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()]
        return {int(own[a]): slice(a, b) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = slice(0, 0)
        for batch in batches:
            for r in batch.to_pylist():
                sizes, words, numbers = unpacked(r["sizes"], np.int64), unpacked(r["words"], np.uint64), unpacked(r["numbers"], np.uint32)
                flags = np.repeat(unpacked(r["flags"], np.uint8).view(bool), sizes)
                keys, second, last = _neighbours(words, numbers, sizes)
                pairs, at = np.unique(keys, return_inverse=True)
                found = np.stack([_sums(numbers[x], [flags[x], ~flags[x]], len(words)) for x in (slice(None), last)]).reshape(4, -1)
                both = _sums(at, [flags[second], ~flags[second]], len(pairs))
                of_words, of_pairs = cuts(words), cuts(pairs)
                for i in sorted({*of_words, *of_pairs}):
                    w, p = of_words.get(i, none), of_pairs.get(i, none)
                    made = [i, r["chunk"], packed(words[w]), packed(found[:, w].reshape(-1)), packed(pairs[p]), packed(both[:, p].reshape(-1))]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=["bucket", "chunk", "words", "found", "pairs", "both"])

    return cut.select("chunk", "sizes", "flags", "words", "numbers").mapInArrow(ask, "bucket long, chunk long, words binary, found binary, pairs binary, both binary")


def _answer(asked: pa.Table) -> pa.Table:
    """One bucket's sums over all chunks, for each chunk in its order; n_words: the bucket's distinct words."""
    out, n_words = [], 0
    for keys, counts, kinds in (("words", "found", 4), ("pairs", "both", 2)):
        parts = [unpacked(x.as_py(), np.uint64) for x in asked.column(keys)]
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        given = np.concatenate([unpacked(x.as_py(), np.int64).reshape(kinds, -1) for x in asked.column(counts)], axis=1)
        sums, ends = _sums(at, list(given), len(distinct)), np.cumsum([len(x) for x in parts])
        out.append(pa.array([packed(sums[:, at[e - len(x) : e]].reshape(-1)) for x, e in zip(parts, ends, strict=True)], pa.binary()))
        n_words = len(distinct) if keys == "words" else n_words
    return pa.table([asked.column("bucket"), asked.column("chunk"), pa.array([n_words] * asked.num_rows, pa.int64()), *out], names=["bucket", "chunk", "n_words", "found", "both"])


def scored(docs: DataFrame, target: Column, key: str = "doc_id", text: str = "text", smoothing: float = 32.0, added: float = 0.5, chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """key, n_tokens, target_loss, background_loss (means over tokens) and difference of each row of docs."""
    cut = saved(chunks(docs.select(key, F.coalesce(target, F.lit(False)).alias("__target"), F.col(text).cast("binary").alias("__text")), key, chunk_words), "bigram-chunks")
    totals = [int(x or 0) for x in cut.agg(F.sum("t"), F.sum("b")).first()]
    asked = _asked(cut, max(1, -(-sum(totals) // bucket_words)))
    answers = saved(asked.groupBy("bucket").applyInArrow(_answer, "bucket long, chunk long, n_words long, found binary, both binary"), "bigram-counts")
    vocabulary = answers.groupBy("bucket").agg(F.max("n_words").alias("n")).agg(F.sum("n")).first()[0] or 0
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n_tokens long, target_loss double, background_loss double, difference double").fields])

    def rate(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        sizes, words, numbers = (unpacked(chunk.column(c)[0].as_py(), kind) for c, kind in (("sizes", np.int64), ("words", np.uint64), ("numbers", np.uint32)))
        flags = unpacked(chunk.column("flags")[0].as_py(), np.uint8).view(bool)
        keys, second, last = _neighbours(words, numbers, sizes)
        _, at = np.unique(keys, return_inverse=True)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own = _own_counts(doc, numbers)
        own_pairs = _own_counts(doc[second], at)
        starts = own[second - 1] - (numbers[second - 1] == numbers[np.repeat(last, np.maximum(sizes[sizes > 0] - 1, 0))])  # as the first of a pair
        answer = answer.sort_by("bucket")
        found, both = (np.concatenate([np.zeros((n, 0), np.int64), *(unpacked(x.as_py(), np.int64).reshape(n, -1) for x in answer.column(c))], axis=1) for c, n in (("found", 4), ("both", 2)))
        bounds, losses = np.concatenate([[0], np.cumsum(sizes)]), []
        for i, total in enumerate(totals):
            mine = (flags == (i == 0)).astype(np.int64)[doc]  # whether the document was counted in this model
            p = (found[i][numbers] - mine * own + added) / (total - mine * sizes[doc] + added * (vocabulary + 1))
            before = (found[i] - found[2 + i])[numbers[second - 1]] - mine[second] * starts
            p[second] = (both[i][at] - mine[second] * own_pairs + smoothing * p[second]) / (before + smoothing)
            losses.append(per_row(-np.log(p), bounds, np.add, 0.0) / np.maximum(sizes, 1))
        ids = chunk.column("keys").combine_chunks().flatten()
        return pa.table([ids, pa.array(sizes), pa.array(losses[0]), pa.array(losses[1]), pa.array(losses[0] - losses[1])], names=schema.names)

    return cut.drop("t", "b").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rate, schema)

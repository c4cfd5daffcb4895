"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - b_k) with thresholds b_0 < b_1 < ... that share the weights w; the severity of a text is
the expected grade, the sum of these probabilities. x marks which hashed words and word beginnings a text holds.

A text is toxic where the log odds of P(grade > 0) reach the model's cut. The cut is learned too: each part of the sample
is rated by a model fitted on the other parts, and the cut with the best F-measure there is taken, in the middle between
the two neighbouring texts (the highest such cut if several are as good; even odds if the parts have too few grades).

The model is fitted on a bounded sample of graded texts (the first by hash order, up to ``SAMPLE_ROWS`` texts and
``SAMPLE_FEATURES`` features in all, documented bounds; a text has 2**BITS features at most), whose sparse
features go through the driver to one task for each fit: the parts and the whole are fitted at the same time. A sampled
grade of MAX_GRADES or more is refused. The weights (2**BITS numbers) are broadcast, and scoring is map-only over whole
texts, a long one by itself.

Defined results: a null or empty text has no features and severity 0. With fewer than two grades to learn from (as with an
empty table), all severities are 0. Texts graded twice count with their highest grade. Rows that repeat a key and its text
count once in the sample, rows that share a key but hold other texts count each. Ties in severity do not matter. Extra
columns pass through, whatever their names; columns severity, grade and toxic are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.llm.common import discard, extended, saved, table
from heliospan.llm.texts import WORD_BYTES, hashes, joined, per_row, pieces, runs

BITS = 18
#: Bytes of the word beginnings that are features beside the whole words.
BEGINNINGS = (4, 6)
SAMPLE_ROWS = 7000
#: Features of all texts in the sample: 64 MB on the driver and, as sent, in each of the fits.
SAMPLE_FEATURES = 16_000_000
MAX_GRADES = 32
#: Features in fewer sampled texts have no weight.
LEAST_TEXTS = 3
STEPS, RATE, DECAY = 400, 0.1, 3e-5
#: Parts of the sample for the choice of the cut, each rated by a model fitted on the others.
FOLDS = 3
#: Weight of recall against precision in that choice: below 1, as a clean document lost is worse than a toxic one kept.
BETA = 0.5
#: Log odds beyond this are cut off, so that the middle of two of them exists.
MOST_ODDS = 30.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, ascending, and the bounds of the texts in them."""
    data, bounds = joined(column)
    lower = WORD_BYTES[data]
    starts, ends = runs((lower != 0).view(np.uint8), bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    keys = [_key(row, hashes(lower, starts, ends), 0)]
    for i, size in enumerate(BEGINNINGS, 1):
        long = ends - starts > size
        keys.append(_key(row[long], hashes(lower, starts[long], starts[long] + size), i))
    keys = np.unique(np.concatenate(keys))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(column) + 1, dtype=np.int64) << BITS)


def _key(row: np.ndarray, hashed: np.ndarray, kind: int) -> np.ndarray:
    salted = (hashed ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    return row << BITS | (salted >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Weights, ascending thresholds and the cut in log odds of P(grade > 0); no thresholds: nothing was learned."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cut: float = 0.0):
        self.weights, self.thresholds, self.cut = weights, thresholds, cut

    def exceed(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return _sigmoid(self.odds(*features(column)))

    def odds(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of grade > k for each text and threshold; those of a text with no features are -inf."""
        score = per_row(self.weights[at], bounds, np.add, 0.0)
        score[bounds[1:] == bounds[:-1]] = -np.inf
        return score[:, None] - self.thresholds[None, :]


def fit(at: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_features: int = 1 << BITS) -> Ordinal:
    """Maximum likelihood with weight decay by full-batch Adam. at: feature numbers text by text; grades: 0, 1, ..."""
    top = int(grades.max()) if len(grades) else 0
    if top < 1 or len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(n_features), np.zeros(0))
    common = np.bincount(at, minlength=n_features) >= LEAST_TEXTS
    n = int(common.sum())
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[common[at]]
    column = (np.cumsum(common) - 1)[at[common[at]]]
    by_row = np.searchsorted(row, np.arange(len(sizes) + 1))
    order = np.argsort(column, kind="stable")
    rows_of, by_column = row[order], np.searchsorted(column[order], np.arange(n + 1))
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    start = np.log1p(-share) - np.log(share)
    # free parameters: the weights, the first threshold and the logs of the gaps
    x = np.concatenate([np.zeros(n), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        w, gaps = x[:n], np.exp(x[n + 1 :])
        b = x[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = per_row(w[column], by_row, np.add, 0.0)
        edges = np.concatenate([[-np.inf], b, [np.inf]])
        low, high = _sigmoid(edges[grades] - eta), _sigmoid(edges[grades + 1] - eta)
        mass = np.maximum(high - low, 1e-12)
        d_eta = 1 - high - low
        d_edges = np.bincount(grades, low * (1 - low) / mass, top + 1)[1:] - np.bincount(grades, high * (1 - high) / mass, top + 1)[:-1]
        d_gaps = d_edges[::-1].cumsum()[::-1][1:] * gaps
        slope = np.concatenate([per_row(d_eta[rows_of], by_column, np.add, 0.0) + DECAY * len(sizes) * w, [d_edges.sum()], d_gaps]) / len(sizes)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        x -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(n_features)
    weights[common] = x[:n]
    return Ordinal(weights, x[n] + np.concatenate([[0.0], np.cumsum(np.exp(x[n + 1 :]))]))


def _taken(at: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, and the bounds of these rows in them."""
    sizes = np.diff(bounds)[rows]
    ends = np.cumsum(sizes)
    return at[np.repeat(bounds[:-1][rows] - (ends - sizes), sizes) + np.arange(sizes.sum())], np.concatenate([[0], ends])


def part_odds(at: np.ndarray, bounds: np.ndarray, grades: np.ndarray, k: int) -> np.ndarray:
    """Log odds of grade > 0 of the rows of part k, by a model fitted on the other parts; empty if those have too few grades."""
    part = np.arange(len(grades)) % FOLDS
    taken, ends = _taken(at, bounds, np.flatnonzero(part != k))
    model = fit(taken, np.diff(ends), grades[part != k])
    return model.odds(*_taken(at, bounds, np.flatnonzero(part == k)))[:, 0].clip(-MOST_ODDS, MOST_ODDS) if len(model.thresholds) else np.zeros(0)


def cut_of(parts: list[np.ndarray], grades: np.ndarray) -> float:
    """The cut with the best F-measure over the rows as rated by ``part_odds``."""
    odds = np.full(len(grades), -MOST_ODDS)
    for k, own in enumerate(parts):
        if len(own) < len(odds[k::FOLDS]) or not len(own):
            return 0.0
        odds[k::FOLDS] = own
    order = np.argsort(-odds, kind="stable")
    odds, toxic = odds[order], grades[order] > 0
    below = np.append(odds[1:], -MOST_ODDS)
    hits = np.cumsum(toxic)
    worth = (1 + BETA**2) * hits / (BETA**2 * hits[-1] + np.arange(1, len(hits) + 1))
    worth[below == odds] = -1.0  # rows of the same odds are not parted
    best = int(worth.argmax())
    return float((odds[best] + below[best]) / 2)


def best_cut(at: np.ndarray, bounds: np.ndarray, grades: np.ndarray) -> float:
    return cut_of([part_odds(at, bounds, grades, k) for k in range(FOLDS)], grades)


def _fitted(spark: SparkSession, at: np.ndarray, bounds: np.ndarray, grades: np.ndarray) -> Ordinal:
    """The model of all rows with its cut: one task fits it, one more for each part of the rows."""
    held = spark.sparkContext.broadcast((at.astype(np.int32), bounds, grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                features_at, ends, own = held.value
                features_at = features_at.astype(np.int64)
                if k < FOLDS:
                    made = [part_odds(features_at, ends, own, k), np.zeros(0)]
                else:
                    model = fit(features_at, np.diff(ends), own)
                    made = [model.weights, model.thresholds]
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x.astype(np.float64).tobytes()]) for x in made)], names=["part", "a", "b"])

    tasks = spark.range(0, FOLDS + 1, 1, FOLDS + 1)
    found = sorted(tuple(r) for r in tasks.mapInArrow(run, "part long, a binary, b binary").collect())
    *parts, (_, weights, thresholds) = found
    model = Ordinal(np.frombuffer(bytes(weights)), np.frombuffer(bytes(thresholds)))
    model.cut = cut_of([np.frombuffer(bytes(a)) for _, a, _ in parts], grades)
    held.destroy()
    return model


def train(docs: DataFrame, grades: DataFrame, text: str = "text", key: str = "doc_id", grade: str = "grade", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Ordinal:
    """grades: (key, grade from 0). Of the graded texts, at most sample_rows are taken, those first by hash of the key, and of these
    the first that have sample_features in all; the rest is not moved. Their features lie in the shared folder until then."""
    value, named = F.col(f"`{text}`"), F.col(f"`{key}`")
    known = grades.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(F.col(grade)).cast("int").alias("__g"))
    texts = docs.where(value.isNotNull()).select(named.alias("__k"), F.xxhash64(value).alias("__h"))
    held = texts.join(known, "__k").distinct().orderBy(F.xxhash64("__k"), "__k", "__h").limit(sample_rows)
    rows = docs.where(value.isNotNull()).select(named.alias("__k"), F.xxhash64(value).alias("__h"), value.cast("binary").alias("__text")).join(F.broadcast(held), ["__k", "__h"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            at, bounds = features(batch.column(3))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()), lists], names=["k", "h", "grade", "features"])

    found = rows.select("__k", "__h", "__g", "__text").mapInArrow(extract, f"k {dict(docs.dtypes)[key]}, h long, grade int, features array<int>")
    extracted = saved(found.dropDuplicates(["k", "h"]).withColumn("size", F.size("features")), "toxicity-features")
    # sizes of at most sample_rows texts, without their features
    total = F.sum("size").over(W.orderBy(F.xxhash64("k"), "k", "h"))
    within = extracted.select("k", "h", "size").withColumn("total", total).where(F.col("total") <= sample_features).select("k", "h")
    found = extracted.join(F.broadcast(within), ["k", "h"]).select("grade", "features").toArrow().combine_chunks()
    discard(extracted)
    if not found.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = found.column("features").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    level = np.maximum(found.column("grade").to_numpy().astype(np.int64), 0)
    if level.max() >= MAX_GRADES:
        raise ValueError(f"grades go from 0 to {MAX_GRADES - 1}; {level.max()} was given")
    at, bounds = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    del found
    # a fixed order of the rows gives the same sums and parts in every run
    rows = np.lexsort((per_row(at, bounds, np.add, 0), np.diff(bounds), level))
    at, bounds = _taken(at, bounds, rows)
    return _fitted(docs.sparkSession, at, bounds, level[rows])


def score(docs: DataFrame, model: Ordinal, text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with severity (expected grade), grade (its rounding) and toxic: P(grade > 0) is the threshold or more, the model's cut where none is given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("severity", "grade", "toxic")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(docs, "severity double, grade int, toxic boolean")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    at, width = len(columns), len(columns)
    least = float(_sigmoid(np.float64(model.cut))) if threshold is None else threshold

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(schema).names
        for batch in pieces(batches, at):
            p = held.value.exceed(batch.column(at))
            severity = p.sum(1)
            toxic = p[:, 0] >= least if p.shape[1] else np.zeros(len(p), bool)
            made = [pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)

    return docs.select(*columns, F.col(f"`{text}`").cast("binary")).toDF(*(f"__{i}" for i in range(width + 1))).mapInArrow(rate, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 clean, 1 toxic, 2 toxic and of low quality (where the labels have such rows)."""
    grade: Column = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", grade.alias("grade"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, learned from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "severity", "grade", "toxic")

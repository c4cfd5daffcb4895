"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased letters, everything else is a blank. N-grams of 1 to 3 characters that hold a letter are
hashed to 2**BITS bins. Training counts bins per language over all training rows (no sample), summed by Spark; the
log-probability matrix of at most MAX_CELLS entries is broadcast. Where there are more languages, they are split into
several matrices, and the documents pass through one after the other with the best language and the sum so far. Scoring
gathers each text's sparse bins from the matrix in numpy batches; a text is scored whole, every n-gram once, however long.

Defined results: a null text or one with no letter is ``und`` with score 0; so is every text if nothing can be learned
from, as with an empty table. Ties go to the first language by name. Rows are independent, so repeats do not matter;
columns lang_pred and score are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import extended, saved, table
from heliospan.llm.texts import mix, per_row

BITS = 16
ORDERS = (1, 2, 3)
MAX_CELLS = 1 << 25
#: Characters that are handled at once.
PIECE_CHARS = 1 << 20
_BLANK = 0x20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased texts with a blank around them, in groups of about PIECE_CHARS; a longer text is a group of its own."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        lowered = f" {t.lower()} " if t else " "
        if held and size + len(lowered) > PIECE_CHARS:
            yield rows, held
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(lowered)
        size += len(lowered)
    if held:
        yield rows, held


def bins(texts: list[str | None], bits: int = BITS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Parts of all n-grams, each n-gram once: the numbers of some texts, the bins of their n-grams, and the texts' bounds in them.

    A group is cut by where n-grams start, and reads on by n - 1 characters, so the cuts change nothing.
    """
    for rows, held in _groups(texts):
        ends = np.cumsum([len(t) for t in held])
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        known = letters()[np.minimum(codes, 0x10FFFF)]
        codes[~known] = _BLANK
        for n in ORDERS:
            for a in range(0, len(codes), PIECE_CHARS):
                part, letter_at = (x[a : a + PIECE_CHARS + n - 1] for x in (codes, known))
                m = len(part) - n + 1
                if m <= 0:
                    continue
                wide, value, letter = part.astype(np.uint64), np.full(m, n, np.uint64), np.zeros(m, bool)
                for k in range(n):
                    value = value * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + m]
                    letter |= letter_at[k : k + m]
                start = np.arange(a, a + m)
                at = np.flatnonzero(letter & (ends[np.searchsorted(ends, start, "right")] - start >= n))
                yield rows, (mix(value[at]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], np.searchsorted(at + a, ends)])


class Model:
    """Some languages, their log-probabilities by bin, and their log priors."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.languages, self.log_prob, self.prior = languages, log_prob, prior

    def rate(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(languages, texts): log of prior x likelihood; and the number of n-grams of each text."""
        total, n = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts), np.int64)
        for rows, hashed, bounds in bins(texts, int(self.log_prob.shape[1]).bit_length() - 1):
            np.add.at(n, rows, np.diff(bounds))
            for j in range(len(total)):
                np.add.at(total[j], rows, per_row(self.log_prob[j][hashed], bounds, np.add, 0.0))
        return total + self.prior[:, None], n


class Counts:
    """Training counts: languages with their numbers of rows, and the table (lang, bin, n)."""

    def __init__(self, rows: dict[str, int], summed: DataFrame, bits: int, smoothing: float):
        self.rows, self.summed, self.bits, self.smoothing = rows, summed, bits, smoothing

    def models(self) -> Iterator[Model]:
        """One model for each group of languages whose matrix has at most MAX_CELLS entries; no more than one is held here."""
        size, languages = 1 << self.bits, sorted(self.rows)
        share = np.log(max(1, sum(self.rows.values())))
        for a in range(0, len(languages), max(1, MAX_CELLS // size)):
            part = languages[a : a + max(1, MAX_CELLS // size)]
            index = {x: i for i, x in enumerate(part)}
            counts = np.full((len(part), size), self.smoothing)
            summed = self.summed if len(part) == len(languages) else self.summed.where(F.col("lang").between(part[0], part[-1]))
            for batch in summed.toArrow().to_batches():
                row = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
                counts[row, batch.column(1).to_numpy()] += batch.column(2).to_numpy()
            log_prob = np.log(counts) - np.log(counts.sum(1, keepdims=True))
            yield Model(part, log_prob, np.log([self.rows[x] for x in part]) - share)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, smoothing: float = 0.5) -> Counts:
    """Counts all rows with a language and a text."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for x, own in held.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bin", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in sorted(set(langs)):
                own = held.setdefault(x, np.zeros(size, np.int64))
                for _, hashed, _ in bins([t for t, y in zip(texts, langs, strict=True) if y == x], bits):
                    own += np.bincount(hashed, minlength=size)
                if len(held) * size >= MAX_CELLS // 4:
                    yield from flush()
        yield from flush()

    used = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = {r["lang"]: r["n"] for r in used.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    summed = used.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return Counts(known, saved(summed, "language-counts") if len(known) * size > MAX_CELLS else summed, bits, smoothing)


_SO_FAR = "lang_pred string, score double, __top double, __sum double"


def predict(docs: DataFrame, counts: Counts, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the probability of that language; map-only, one pass for each model."""
    docs = docs.drop("lang_pred", "score")
    width, at = len(docs.columns), docs.columns.index(text)
    inner = [f"__{i}" for i in range(width)]  # columns may have the names made here
    out = docs.toDF(*inner).select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(float("-inf")).alias("__top"), F.lit(0.0).alias("__sum"))
    schema = extended(docs.toDF(*inner), _SO_FAR)
    for i, model in enumerate(counts.models()):
        out = _pass(out if i < 1 else saved(out, "language-pass"), model, at, width, schema)
    return out.select(*inner, "lang_pred", "score").toDF(*docs.columns, "lang_pred", "score")


def _pass(docs: DataFrame, model: Model, at: int, width: int, schema: object) -> DataFrame:
    """docs with the best language so far, its log-probability (__top) and the sum of all languages' probabilities over its own (__sum)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(schema).names
        for batch in batches:
            total, n = held.value.rate(batch.column(at).to_pylist())
            best = total.argmax(0)
            top = total.max(0)
            before, earlier = batch.column(width + 2).to_numpy(), batch.column(width + 3).to_numpy()
            most = np.maximum(before, top)
            sums = np.exp(total - most).sum(0) + earlier * np.exp(before - most)
            found = [old if not k else model_name if t > b else old for old, k, t, b, model_name in zip(batch.column(width).to_pylist(), n.tolist(), top.tolist(), before.tolist(), (held.value.languages[x] for x in best), strict=True)]
            made = [pa.array(found, pa.string()), pa.array(np.where(n > 0, 1 / sums, 0.0)), pa.array(most), pa.array(sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)

    return docs.mapInArrow(score, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out")
    model = train(docs.where(~held_out))
    found = predict(docs.select("doc_id", held_out, "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")

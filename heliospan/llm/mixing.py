"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to source, language and topic marginals: each sweep scales the cells of (source, language,
topic) so that one dimension after the other meets its target shares. Documents are then sampled with probability
proportional to the calibrated weight of their cell (``reachable``): no probability is cut, so the expected shares of the
kept tokens are the fitted ones (``achieved`` reports them), and the budget is an upper bound. One over the largest weight
of all tokens can be kept at most.

Targets name values; all other values (null too) share the rest as one value. So there are at most the product of
(named values + 1) cells whatever the data, which is why they may be collected and broadcast. Token counts are summed
over all documents. The draw of a document depends on its key alone.

Defined results: null texts have 0 tokens; cells with no tokens have weight 0 and probability 1 (they cost nothing);
target shares of values that have no tokens go to the others in proportion; targets that cannot be met together
give the last sweep's fit, with a warning that says by how much shares miss them (``calibrate(exact=True)`` raises), and ``achieved`` shows it. Rows with equal keys share their draw. An
empty table stays empty. Texts are read whole, in bounded pieces of rows; a long one only by itself. Other columns pass
through; the columns made here are replaced, and the names __tokens and __topic are reserved.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm.common import UNIFORM_SQL, extended, table, uniform
from heliospan.llm.texts import joined, pieces, runs

#: Sweeps at least, and those without progress after which targets count as out of reach.
SWEEPS, STALL = 25, 1000
#: Largest miss of a target share that counts as met.
TOLERANCE = 1e-6
MAX_CELLS = 100_000
OTHER = "(other)"
BUDGET = 0.8
SOURCES = {"src0": 0.30, "src1": 0.04, "src2": 0.03}
LANGUAGES = {"en": 0.60, "fr": 0.15, "de": 0.14, "es": 0.10}
TOPICS = {"prose": 0.93, "contact": 0.01, "legal": 0.04, "listing": 0.01}
Targets = Mapping[str, Mapping[str, float]]
MADE = ("n_tokens", "source_cell", "lang_cell", "topic_cell", "weight", "probability", "draw", "kept")


_BLANKS = np.zeros(256, bool)
_BLANKS[list(b" \t\r\n")] = True
_LEGAL = (b"license", b"licence", b"copyright")
_CONTACT = (b"@", b"http://", b"https://")


def _topic(text: bytes | None, lines: int, chars: int) -> str | None:
    """A plain rule: legal notices, contact data, listings of short lines, prose."""
    if text is None:
        return None
    lower = text.lower()
    if any(x in lower for x in _LEGAL):
        return "legal"
    if any(x in text for x in _CONTACT):
        return "contact"
    return "listing" if lines * 90 > chars else "prose"


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __tokens (runs of other characters than blanks) and __topic of each whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    value = F.col(f"`{text}`").cast("binary")
    docs = docs.drop("__tokens", "__topic")
    schema, width = extended(docs, "__tokens long, __topic string"), len(docs.columns)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(schema).names
        for batch in pieces(batches, width):
            data, bounds = joined(batch.column(width))
            starts, _ = runs((~_BLANKS[data]).view(np.uint8), bounds)
            within = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (data == 0x0A, (data & 0xC0) != 0x80)]
            lines, chars = (np.diff(x).tolist() for x in within)
            topics = [_topic(t.as_py(), *x) for t, *x in zip(batch.column(width), lines, chars, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.diff(np.searchsorted(starts, bounds))), pa.array(topics, pa.string())], names=names)

    return docs.select("*", value).toDF(*(f"__{i}" for i in range(width + 1))).mapInArrow(describe, schema)


def missed(fitted: np.ndarray, goals: list[np.ndarray]) -> float:
    """The largest distance of a marginal from its goal, as a share of the sum."""
    total = fitted.sum()
    sums = (fitted.sum(tuple(i for i in range(fitted.ndim) if i != axis)) for axis in range(fitted.ndim))
    return max((float(np.abs(s - g).max()) / total for s, g in zip(sums, goals, strict=True)), default=0.0) if total > 0 else 0.0


def rake(mass: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """mass, scaled along each axis in turn so that its marginals are the target shares of its sum; and by how much they miss.

    At least so many sweeps, and on until the largest miss is within the tolerance. Targets that cannot be met together (two
    dimensions that go hand in hand, with other shares) never are: it ends when STALL sweeps bring no tenth less.
    """
    total, fitted = mass.sum(), mass.astype(float)
    goals = []
    for axis, shares in enumerate(targets):
        there = mass.sum(tuple(i for i in range(mass.ndim) if i != axis))
        goal = np.where(there > 0, shares, 0.0)
        goals.append(goal / goal.sum() * total if goal.sum() > 0 else there.astype(float))
    done, miss, best, since = 0, 0.0, np.inf, 0
    while total > 0 and (done < sweeps or (miss > tolerance and since < STALL)):
        for axis, goal in enumerate(goals):
            now = fitted.sum(tuple(i for i in range(mass.ndim) if i != axis))
            fitted = fitted * np.divide(goal, now, out=np.zeros_like(now), where=now > 0).reshape([-1 if i == axis else 1 for i in range(mass.ndim)])
        done, miss = done + 1, missed(fitted, goals)
        best, since = (miss, 0) if miss < 0.9 * best else (best, since + 1)
    return fitted, miss


def reachable(mass: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """s x weight with the largest s that leaves no probability over 1 and the expected mass within budget x its sum; 1 for cells of no mass."""
    held = mass > 0
    if not held.any() or not weight[held].max() > 0:
        return np.ones_like(weight)
    scale = min(1 / weight[held].max(), budget * mass.sum() / (mass * weight).sum())
    return np.where(held, np.minimum(1.0, scale * weight), 1.0)


def calibrate(docs: DataFrame, columns: Mapping[str, Column], n_tokens: Column, targets: Targets, key: str = "doc_id", budget: float = BUDGET, sweeps: int = SWEEPS, exact: bool = False) -> DataFrame:
    """docs with tokens, cell, weight, probability, draw and kept. columns: the value of each dimension of targets.

    exact: targets that cannot be met together are an error, else a warning that says by how much they are missed.
    """
    spark, names = docs.sparkSession, list(targets)
    values = {d: [*sorted(targets[d]), OTHER] for d in names}
    shape = [len(values[d]) for d in names]
    if np.prod(shape) > MAX_CELLS:
        raise ValueError(f"the targets make over {MAX_CELLS} cells")
    rows = docs.drop(*MADE).withColumn("n_tokens", n_tokens)
    for d in names:
        rows = rows.withColumn(f"{d}_cell", F.when(columns[d].isin(*values[d][:-1]), columns[d]).otherwise(OTHER))
    cells = [f"{d}_cell" for d in names]
    mass = np.zeros(shape)
    for row in rows.groupBy(*cells).agg(F.sum("n_tokens").alias("n")).collect():
        mass[tuple(values[d].index(row[c]) for d, c in zip(names, cells, strict=True))] = row["n"]
    shares = []
    for d in names:
        named = np.array([float(targets[d][v]) for v in values[d][:-1]])
        shares.append(np.append(named, max(0.0, 1.0 - named.sum())))
    fitted, miss = rake(mass, shares, sweeps)
    if miss > TOLERANCE:
        told = f"the targets cannot be met together: shares miss them by up to {miss:.6f}"
        if exact:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    weight = np.divide(fitted, mass, out=np.zeros_like(fitted), where=mass > 0)
    p = reachable(mass, weight, budget)
    made = [(*(values[d][i] for d, i in zip(names, at, strict=True)), float(weight[at]), float(p[at])) for at in np.ndindex(*shape)]
    fields = ", ".join(f"`{c}` string" for c in cells)
    small = spark.createDataFrame(made, f"{fields}, weight double, probability double")
    draw = uniform(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("|mix")))
    return rows.join(F.broadcast(small), cells).withColumn("draw", draw).withColumn("kept", F.col("draw") < F.col("probability"))


TARGETS: Targets = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}


def mixed(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """docs calibrated to targets of source, language and topic."""
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("__topic")}
    return calibrate(described(docs), columns, F.col("__tokens"), targets).drop("__tokens", "__topic")


def achieved(rows: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """dimension, value, target, natural, expected: shares of all tokens and of those expected to be kept. rows: ``mixed``."""
    values = [(d, v, t) for d, named in targets.items() for v, t in (*named.items(), (OTHER, max(0.0, 1.0 - sum(named.values()))))]
    goals = rows.sparkSession.createDataFrame(values, "dimension string, value string, target double")
    long = rows.select("n_tokens", "probability", F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_cell").alias("value")) for d in targets))))
    sums = long.groupBy("dimension", "value").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("kept"))
    total = sums.groupBy("dimension").agg(F.sum("n").alias("all_n"), F.sum("kept").alias("all_kept"))
    shares = {"natural": F.try_divide("n", "all_n"), "expected": F.try_divide("kept", "all_kept")}
    return goals.join(sums, ["dimension", "value"], "left").join(total, "dimension", "left").select("dimension", "value", "target", *(F.coalesce(x, F.lit(0.0)).alias(n) for n, x in shares.items()))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated weight, probability and draw of every document; the expected shares of the kept tokens meet the targets."""
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return found.select("doc_id", "source_cell", "lang_cell", "topic_cell", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def _in(column: str, named: Mapping[str, float]) -> str:
    return f"CASE WHEN {column} IN ({', '.join(repr(v) for v in sorted(named))}) THEN {column} ELSE '{OTHER}' END"


def _share(column: str, named: Mapping[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {named[v]}::DOUBLE" for v in sorted(named)) + f" ELSE greatest(0::DOUBLE, 1 - {sum(named[v] for v in sorted(named))}::DOUBLE) END"


def _sql() -> str:
    steps, before = [], "w0"
    for i in range(SWEEPS):
        for j, (d, named) in enumerate(TARGETS.items()):
            c, name = f"{d}_cell", f"w{i}_{j}"
            steps.append(f"{name}a AS MATERIALIZED (SELECT *, sum(f) OVER (PARTITION BY {c}) AS now FROM {before})")
            steps.append(f"{name}g AS MATERIALIZED (SELECT sum(s) AS goals FROM (SELECT DISTINCT {c}, {_share(c, named)} AS s FROM {name}a WHERE now > 0))")
            steps.append(f"{name} AS MATERIALIZED (SELECT source_cell, lang_cell, topic_cell, m, total, CASE WHEN now > 0 THEN f * ({_share(c, named)} / goals * total) / now ELSE 0 END AS f FROM {name}a, {name}g)")
            before = name
    return f"""
    WITH docs AS (
      SELECT doc_id, {_in('source', SOURCES)} AS source_cell, {_in('lang', LANGUAGES)} AS lang_cell,
        CASE WHEN text IS NULL THEN '{OTHER}' WHEN regexp_matches(lower(text), 'licen[cs]e|copyright') THEN 'legal'
          WHEN regexp_matches(text, '@|https?://') THEN 'contact'
          WHEN (length(text) - length(replace(text, chr(10), ''))) * 90 > length(text) THEN 'listing' ELSE 'prose' END AS topic_cell,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens,
        {UNIFORM_SQL.format("coalesce(doc_id::VARCHAR, 'null') || '|mix'")} AS draw
      FROM documents),
    w0 AS MATERIALIZED (SELECT source_cell, lang_cell, topic_cell, sum(n_tokens)::DOUBLE AS m, sum(sum(n_tokens)) OVER ()::DOUBLE AS total, sum(n_tokens)::DOUBLE AS f FROM docs GROUP BY ALL),
    {', '.join(steps)},
    weights AS (SELECT source_cell, lang_cell, topic_cell, m, total, CASE WHEN m > 0 THEN f / m ELSE 0 END AS weight FROM {before}),
    scale AS (SELECT least(1 / max(weight), {BUDGET}::DOUBLE * max(total) / sum(m * weight)) AS s FROM weights WHERE m > 0),
    cells AS (SELECT source_cell, lang_cell, topic_cell, weight, CASE WHEN m > 0 THEN least(1::DOUBLE, coalesce(s * weight, 1)) ELSE 1 END AS p FROM weights, scale)
    SELECT doc_id, source_cell, lang_cell, topic_cell, n_tokens, round(weight, 6) AS weight, round(p, 6) AS probability, draw < p AS kept
    FROM docs JOIN cells USING (source_cell, lang_cell, topic_cell)"""


SQL = _sql()

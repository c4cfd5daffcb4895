"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the next one's docs; ``run`` writes each result as Parquet in the
shared folder and reads it back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm import decontaminate, jaccard, mixing, sharding, toxicity
from heliospan.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, learned from this stage's documents, calls toxic."""
    model = toxicity.train(docs, toxicity.graded(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where(~F.col("toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return jaccard.representatives(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages; documents that are mostly such passages go. n_chars follows the text."""
    clean = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, calibrated to the source, language and topic targets."""
    return mixing.mixed(docs).where("kept").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with region, rack and shard."""
    return sharding.assign(docs, "doc_id", sharding.topology(sharding.SHARDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can't express the severity model; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

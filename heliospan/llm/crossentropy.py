"""Cross-entropy difference: matched target and background n-gram models share one vocabulary and score each document.

The models are word bigrams with back-off to words, over every word and word pair of the corpus (``heliospan.llm.bigrams``):
the same vocabulary and smoothing, only the counts differ. A document's score is the mean over its tokens of the target loss
less the background loss; below 0 it is nearer to the target.

Defined results, also for null, empty and repeated texts and an empty table, are those of ``bigrams.scored``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.llm import bigrams
from heliospan.llm.common import table

SMOOTHING, ADDED = 32.0, 0.5
#: The sources whose documents are the target.
TARGET_SOURCES = ("src1", "src2", "src3")


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every document under the models of the target sources and of all others, its own counts left out."""
    docs = table(spark, sf_dir, "documents")
    return bigrams.scored(docs, F.col("source").isin(*TARGET_SOURCES), smoothing=SMOOTHING, added=ADDED)

"""New archive files as a stream: each batch is parsed, merged and appended to the hours table, and its years to the climate's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliospan.functions.rules import RULES, Rules
from heliospan.operators.days import stations, year_scores
from heliospan.operators.hours import KEYS, merge_hours
from heliospan.plans.weather import climate
from heliospan.sources import files
from heliospan.sources.outputs import by_year, stored


def _lines(spark: SparkSession, root: str) -> DataFrame:
    held = spark.readStream.schema("value string").option("lineSep", "\n").option("pathGlobFilter", files.GLOB).option("recursiveFileLookup", "true").format("text").load(root)
    return held.select("value", F.col("_metadata.file_path").alias("path"))


def batch_hours(batch: DataFrame) -> DataFrame:
    """The merged hours of a batch of lines (value, path)."""
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\r$", "")
    named = batch.withColumn("line_no", F.monotonically_increasing_id()).withColumn("line", line).withColumns(files.name_parts(F.col("path"))).where("known").select("station", "file_year", "line_no", "line")
    return merge_hours(files.parse(named))


def _start(lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def stream_hours(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watches root/<year>/*.gz. A file is one station-year, so its hours never wait for another batch and no state is kept.
    A batch has a folder of its own (``batch``, with a folder for each file year in it), so a retried one replaces what it
    wrote, and the number of files grows with batches and years, not with stations."""

    def write(batch: DataFrame, number: int) -> None:
        by_year(batch_hours(batch)).write.mode("overwrite").partitionBy("file_year").parquet(f"{out}/batch={number}")

    return _start(_lines(spark, root), write, checkpoint, once)


def stream_climate(spark: SparkSession, root: str, out: str, checkpoint: str, places: DataFrame, rules: Rules = RULES, once: bool = True) -> StreamingQuery:
    """The same, on to years and months: a batch upserts the rows of its station-years (``upsert``), and ``streamed`` reads the
    tables as they stand. places: station, lat, lon."""

    def write(batch: DataFrame, number: int) -> None:
        hours = stored(batch_hours(batch), "batch-hours")
        if not hours.isEmpty():
            upsert(hours, places, out, number, rules)

    return _start(_lines(spark, root), write, checkpoint, once)


def upsert(hours: DataFrame, places: DataFrame, out: str, number: int, rules: Rules = RULES) -> None:
    """Writes the years and months of the hours of whole station-years under the batch's number; they replace those of lower
    numbers. A batch that runs again overwrites its own folders alone, so it changes nothing."""
    made = climate(hours, places, rules)
    # months first: those of a number that has no years yet are not read
    made.months.write.mode("overwrite").parquet(f"{out}/months/batch={number}")
    made.years.write.mode("overwrite").parquet(f"{out}/years/batch={number}")


def streamed(spark: SparkSession, out: str, rules: Rules = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Years, months and stations as they stand: each station-year as its last batch has it.

    The last batch of each is found by an aggregate over keys and numbers alone; the stations are means over their years, so
    they are made anew from rows that are few (one for each station and year, and twelve at most).
    """
    years, months = (spark.read.option("basePath", f"{out}/{n}").parquet(f"{out}/{n}") for n in ("years", "months"))
    last = years.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    years, months = (df.join(last, [*KEYS, "batch"], "left_semi").drop("batch") for df in (years, months))
    return years, months, stations(year_scores(years, rules), months, rules=rules)

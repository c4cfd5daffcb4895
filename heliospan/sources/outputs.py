"""Sinks: station tables, detail files, versioned caches, outcomes of deriving."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Of each open ``scratch``, the folders that were written in it.
_OWNED: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, intermediate tables (``stored``) belong to who opened it: they are deleted at its end, so results must be written
    by then."""
    _OWNED.append([])
    try:
        yield
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _OWNED.pop():
            place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place(path), True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read back, so that its consumers don't compute it again.

    In the folder that driver and executors share (spark.checkpoint.dir); a local master may do without that setting.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="heliospan-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_year(hours: DataFrame) -> DataFrame:
    """Ranges of years and stations: a year is written by as many tasks as its share of the rows needs, and a task writes few years."""
    return hours.repartitionByRange("file_year", "station")


def write_hours(hours: DataFrame, path: str) -> None:
    """Merged hours, one folder for each file year, so that a year is read alone."""
    by_year(hours).write.mode("overwrite").partitionBy("file_year").parquet(path)


BUCKETED = ("station", "file_year")


def write_bucketed(hours: DataFrame, table: str, path: str, buckets: int) -> None:
    """Merged hours as a table whose files are clustered by station and year and sorted by hour within, so that everything by
    station and year is computed where its rows lie: a plan from it to days has no exchange."""
    writer = hours.repartition(buckets, *BUCKETED).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *BUCKETED).sortBy(*BUCKETED, "utc_date", "utc_hour").saveAsTable(table)


def bucketed(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The table of ``write_bucketed``, declared anew from its files where this session's catalog does not know it."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by, order = ", ".join(BUCKETED), ", ".join((*BUCKETED, "utc_date", "utc_hour"))
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_index(index: DataFrame, path: str) -> None:
    """A JSON object for each station with its files by year (``files.station_index``)."""
    index.orderBy("station").write.mode("overwrite").json(path)


def write_ids(ids: DataFrame, path: str, key: str = "station") -> None:
    ids.select(key).orderBy(key).write.mode("overwrite").json(path)


def write_raster(cells: DataFrame, path: str) -> None:
    """Raster cells (row, col and values), in the order of rows, so that a range of rows reads few files."""
    cells.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def stations_json(stations: DataFrame) -> DataFrame:
    """One JSON text for each station, null fields kept, by id."""
    return stations.select("id", F.to_json(F.struct(*stations.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_stations(stations: DataFrame, path: str) -> None:
    """One file with all stations as one JSON array, by id; an empty array for none. Stations are thousands at most; their
    lines stream through one task."""
    before = F.when(F.row_number().over(W.orderBy("id")) == 1, "[").otherwise(",")
    lines = stations_json(stations).select(F.lit(1).alias("part"), "id", F.concat(before, "json").alias("value"))
    # the bracket that ends it, and that which begins an empty one
    end = stations.agg(F.count("*").alias("n")).select(F.lit(2).alias("part"), F.lit(None).cast(dict(stations.dtypes)["id"]).alias("id"), F.when(F.col("n") == 0, "[]").otherwise("]").alias("value"))
    lines.union(end).coalesce(1).sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(path)


def details_json(details: DataFrame) -> DataFrame:
    """id and the JSON text of ``days.details``: a year has only the fields that apply to it, all else keeps its nulls."""
    rest = F.to_json(F.struct(*(c for c in details.columns if c != "years")), {"ignoreNullFields": "false"})
    return details.select("id", F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"years":'), F.to_json("years"), F.lit("}")).alias("json"))


def write_details(details: DataFrame, path: str) -> None:
    """A file <id>.json for each station; those of stations that are no longer there are removed.

    Spark writes a folder for each id beside the place; the driver then only renames files.
    """
    spark, temporary = details.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    details_json(details).withColumnRenamed("json", "value").repartition("id").write.partitionBy("id").text(temporary)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place(path))
    made = set()
    for folder in files.listStatus(place(temporary)):
        if folder.isDirectory():
            name = jvm.java.net.URLDecoder.decode(folder.getPath().getName().split("=", 1)[1], "UTF-8") + ".json"
            part = next(f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            files.delete(place(path, name), False)
            files.rename(part, place(path, name))
            made.add(name)
    files.delete(place(temporary), True)
    for old in files.listStatus(place(path)):
        if old.getPath().getName().endswith(".json") and old.getPath().getName() not in made:
            files.delete(old.getPath(), False)


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    df.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_versioned(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The rows written by this version, None where nothing can be read. Damaged files are passed over."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("ignoreCorruptFiles", "true").parquet(path).where(F.col("version") == version).drop("version")
    except AnalysisException:
        return None


def to_process(files: DataFrame, done: DataFrame | None, on: Sequence[str] = ("station", "file_year")) -> DataFrame:
    """Files not yet in the cache. With the size and time of a file in ``on``, also those that changed since."""
    return files if done is None else files.join(done.select(*on).distinct(), list(on), "left_anti")


def signatures(files: DataFrame) -> DataFrame:
    """station and a signature of its files' names, sizes and times: another one means that it must be derived anew."""
    one = F.concat_ws("|", F.col("file_year").cast("string"), F.col("size").cast("string"), F.col("modified").cast("string"))
    return files.groupBy("station").agg(F.md5(F.array_join(F.sort_array(F.collect_list(one)), ";")).alias("signature"))


def outcomes(derived: DataFrame, excluded: DataFrame, signed: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """The derived stations, and the markers (reason) of those left out, with version and signature. A station is in one of
    them only: who qualifies now loses its marker, who no longer does loses its result."""
    stamp = signed.withColumn("version", F.lit(version))
    return derived.join(stamp, "station"), excluded.join(derived.select("station"), "station", "left_anti").join(stamp, "station")


def to_derive(signed: DataFrame, version: int, *known: DataFrame | None) -> DataFrame:
    """Stations whose version or signature is in none of the known outcomes."""
    out = signed
    for table in known:
        if table is not None:
            out = out.join(table.where(F.col("version") == version).select("station", "signature"), ["station", "signature"], "left_anti")
    return out


def counted_outcomes(ids: DataFrame, derived: DataFrame, manifest: DataFrame) -> tuple[DataFrame, Observation]:
    """The published stations: derived and manifest columns of ids, and an observation of how many of the ids are published, have
    no derived result, or no manifest row. It is filled by the job that writes the stations, so nothing is joined twice."""
    seen = ids.select(F.col("station").alias("id")).join(derived.withColumnRenamed("station", "id").withColumn("__derived", F.lit(1)), "id", "left")
    seen = seen.join(manifest.withColumn("__manifest", F.lit(1)), "id", "left")
    has, placed = F.col("__derived").isNotNull(), F.col("__manifest").isNotNull()
    observed = Observation("outcomes")
    counts = {"published": has & placed, "without derived data": ~has, "without manifest match": has & ~placed}
    return seen.observe(observed, *(F.count_if(c).alias(n) for n, c in counts.items())).where(has & placed).drop("__derived", "__manifest"), observed


def publish_misses(ids: DataFrame, derived: DataFrame, manifest: DataFrame) -> DataFrame:
    """How many of the stations are published, without a derived result, or without a manifest row."""
    has: Column = F.when(F.col("__derived").isNull(), "without derived data").when(F.col("__manifest").isNull(), "without manifest match").otherwise("published")
    seen = ids.select("station").join(derived.select("station", F.lit(1).alias("__derived")).distinct(), "station", "left")
    seen = seen.join(manifest.select(F.col("id").alias("station"), F.lit(1).alias("__manifest")).distinct(), "station", "left")
    return seen.groupBy(has.alias("outcome")).agg(F.count("*").alias("n"))


def report(df: DataFrame, rows: int = 50) -> str:
    """An aligned text table of the first rows."""
    lines = [df.columns, *([("" if v is None else str(v)) for v in r] for r in df.take(rows))]
    widths = [max(len(r[i]) for r in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in lines)

"""What the operators of this subpackage share: the shared folder, saved tables, document keys and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder serves a
    local master (tests); on a cluster that is an error, as executors would write where the driver doesn't read."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="heliospan-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a saved table that nothing reads any more."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for file in table.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written or collected in here gives back its shuffle files when it is done, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of a Bloom filter for each of its keys, at least, and its most bits (32 MB) as a power of two.
KEY_BITS, MOST_BITS = 8, 28


def bloom(keys: DataFrame) -> np.ndarray:
    """The Bloom filter of a table with one column of 64-bit hashes, each of which sets two bits: its 64-bit words."""
    key = F.col(keys.columns[0])
    bits = min(MOST_BITS, max(6, (KEY_BITS * keys.count()).bit_length()))
    cells = keys.select(F.explode(F.array(key, F.shiftrightunsigned(key, 32))).alias("cell")).select(F.col("cell").bitwiseAND((1 << bits) - 1).alias("cell"))
    mask = F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))")
    words = cells.groupBy(F.shiftright("cell", 6).cast("int").alias("word")).agg(mask.alias("mask")).toArrow()  # 2^bits / 64 rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def likely(df: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """df without nearly all of its rows whose columns ``on`` have no match in wanted, so that a join that follows moves few others.

    All rows with a match stay. A filter that fills up lets more rows pass.
    """
    held = df.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.xxhash64(*on))))
    columns = list(range(len(df.columns)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        last = np.uint64(64 * len(words) - 1)
        for batch in batches:
            hashed = batch.column(len(columns)).to_numpy(zero_copy_only=False).view(np.uint64)
            cells = hashed & last, (hashed >> np.uint64(32)) & last
            hit = np.logical_and(*((words[c >> np.uint64(6)] >> (c & np.uint64(63))) & np.uint64(1) for c in cells))
            yield batch.select(columns).filter(pa.array(hit))

    return df.withColumn("__hash", F.xxhash64(*on)).mapInArrow(keep, df.schema)


#: Bytes of an Arrow batch: texts cross to Python in bounded pieces whatever their lengths.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, made: str) -> T.StructType:
    """The schema of df with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(made).fields])


def uniform(key: Column) -> Column:
    """A draw from (0, 1) that depends on the string key alone: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


UNIFORM_SQL = "((('0x' || substr(md5({0}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) of the graph with the given edges; component is the smallest node that can be reached.

    Alternates large-star and small-star steps over the edge list until a round leaves it as it was. Every step is a
    minimum by node, combined before the shuffle, and an equi-join that adaptive execution can split at a hot node.
    Nodes with no edge, or an edge to themselves alone, have no row. The number of rounds grows with the logarithm of
    the number of nodes.
    """
    x, y = F.col(a), F.col(b)
    links = checkpointed(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(links)
    while seen[0]:
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        links = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = mark(links)
        if now == seen:
            break
        seen = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def numbered(df: DataFrame, name: str, node: str = "node") -> DataFrame:
    """df, saved, with a number for each row. The numbers are written once, so every later read finds the same ones."""
    return saved(df.withColumn(node, F.monotonically_increasing_id()), name)


def least_keys(reach: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(node, component_key): the smallest key of the component of each node. reach: ``components``; nodes: node, key.

    Null keys do not count; a component of them alone has a null key.
    """
    own = reach.join(nodes.select("node", F.col(key).alias("component_key")), "node")
    least = own.groupBy("component").agg(F.min("component_key").alias("component_key"))
    return reach.join(least, "component").select("node", "component_key")

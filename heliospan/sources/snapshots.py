"""Several tables that change together: a commit file names them all, so a reader sees all of a run's tables or none.

A run writes its tables to a folder of its own, then moves one small file into place. The move fails if another run
has taken the number, and until it has happened readers see the run before. Commits are numbered; the highest is current.
The tables of the commit before stay for their readers, older ones go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshot(NamedTuple):
    number: int
    tables: dict[str, DataFrame]
    notes: dict


def _files(spark: SparkSession, root: str) -> tuple:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    return place, place(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, root: str) -> list[int]:
    place, files = _files(spark, root)
    folder = place(root, "commits")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/commits/{number:012d}").collect()))


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The tables of the last commit; None where there is none."""
    found = _commits(spark, root)
    if not found:
        return None
    held = _read(spark, root, found[-1])
    tables = {n: spark.read.schema(T.StructType.fromJson(s)).parquet(f"{root}/{held['folder']}/{n}") for n, s in held["tables"].items()}
    return Snapshot(found[-1], tables, held["notes"])


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], notes: Mapping, after: int = 0) -> Snapshot:
    """Writes the tables and makes them current. after: number of the snapshot that they were made from (0: none); it fails
    if that is no longer the current one, and then the tables of the other run stay."""
    folder = f"tables/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    _publish(spark, root, after + 1, json.dumps({"folder": folder, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}, "notes": dict(notes)}))
    for old in [n for n in _commits(spark, root) if n < after]:
        place, files = _files(spark, root)
        files.delete(place(f"{root}/{_read(spark, root, old)['folder']}"), True)
        files.delete(place(f"{root}/commits/{old:012d}"), False)
    return current(spark, root)


def _publish(spark: SparkSession, root: str, number: int, text: str) -> None:
    place, files = _files(spark, root)
    files.mkdirs(place(root, "commits"))
    made = place(f"{root}/commits/.{uuid.uuid4().hex}")
    out = files.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    no_overwrite = spark.sparkContext._gateway.new_array(kinds, 1)
    no_overwrite[0] = kinds.NONE
    whole = files.makeQualified(made)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(whole, files.makeQualified(place(f"{root}/commits/{number:012d}")), no_overwrite)

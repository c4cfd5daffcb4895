"""Ends of compressed files, read by range: the first bytes and the length in the trailer, and nothing between.

``spark.read.format("archive_ends").load(root)`` after ``register``: a partition is a pack of files, and a file costs two reads
however large it is. Options: pattern (of names), only (a JSON list of names), sample (bytes), pack (files). Files are reached through Arrow's file systems (local, HDFS, S3, GCS, by the path's scheme).
"""

from __future__ import annotations

import fnmatch
import json
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SAMPLE_BYTES = 64 << 10
#: Files of a partition.
PACK = 256


class Pack(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def reachable(root: str) -> bool:
    """Whether the path's scheme is one of Arrow's."""
    try:
        pafs.FileSystem.from_uri(root)
    except (ValueError, OSError):
        return False
    return True


class EndsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.sample, self.pack = int(options.get("sample", SAMPLE_BYTES)), int(options.get("pack", PACK))
        self.only = frozenset(json.loads(options["only"])) if options.get("only") else None

    def partitions(self) -> list[Pack]:
        system, path = pafs.FileSystem.from_uri(self.root)
        listed = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in listed if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and (self.only is None or f.base_name in self.only))
        return [Pack(files[i : i + self.pack]) for i in range(0, max(len(files), 1), self.pack)]

    def read(self, partition: Pack) -> Iterator[tuple]:
        system, _ = pafs.FileSystem.from_uri(self.root)
        for path, size in partition.files:
            try:
                with system.open_input_file(path) as f:
                    head = f.read_at(min(self.sample, size), 0)
                    tail = head[-4:] if len(head) == size else f.read_at(min(4, size), max(0, size - 4))
                cost = len(head) + (0 if len(head) == size else len(tail))
                yield (path, size, cost, *unpacked(head), int.from_bytes(tail, "little"), None)
            except OSError as e:
                yield (path, size, 0, 0, 0, 0, str(e))


def unpacked(head: bytes) -> tuple[int, int]:
    """Bytes and line ends that the first bytes of a gzip file unpack to; none if they are no gzip."""
    try:
        text = zlib.decompressobj(wbits=31).decompress(head)
    except zlib.error:
        return 0, 0
    return len(text), text.count(b"\n")


class ArchiveEnds(DataSource):
    """path, size (as stored), cost (bytes read), bytes and newlines of the sample, whole (length in the trailer, modulo 2^32), error."""

    @classmethod
    def name(cls) -> str:
        return "archive_ends"

    def schema(self) -> str:
        return "path string, size bigint, cost bigint, bytes bigint, newlines bigint, whole bigint, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EndsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveEnds)

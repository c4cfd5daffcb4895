"""Raw report archives and dimension files."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.functions import reports, scalar
from heliospan.sources import ranged

YEARS = (2010, 2025)
#: The same as a path pattern, so that other files are not opened.
GLOB = f"{'[0-9]' * 6}-{'[0-9]' * 5}-{'[0-9]' * 4}.gz"
NAME = r"^(\d{6})-(\d{5})-(\d{4})\.gz$"
#: Bytecode of the largest method that HotSpot compiles.
METHOD_BYTES = 8000


def name_parts(path: Column) -> dict[str, Column]:
    """station and file_year from a file's name; null where the name does not match."""
    name = F.element_at(F.split(path, "/"), -1)
    known = name.rlike(NAME)
    part = lambda i: F.when(known, F.regexp_extract(name, NAME, i))
    return {"station": F.concat_ws("-", part(1), part(2)), "file_year": part(3).try_cast("int"), "known": known}


def station_files(spark: SparkSession, root: str) -> DataFrame:
    """station, file_year, path, size, modified of the archive's files (root/<year>/<name>.gz), without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(root)
    listed = listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed.withColumns(name_parts(F.col("path"))).where("known").drop("known").where(F.col("file_year").between(*YEARS))


def station_index(files: DataFrame) -> DataFrame:
    """station and its files as an array sorted by year."""
    return files.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("file_year", "path"))).alias("files"))


def with_files(ids: DataFrame, index: DataFrame) -> DataFrame:
    """ids with the files of the index; a station that it does not hold has an empty list."""
    kind = dict(index.dtypes)["files"]
    return ids.join(index, "station", "left").withColumn("files", F.coalesce("files", F.array().cast(kind)))


def report_lines(spark: SparkSession, paths: str | Sequence[str], damaged: bool = False) -> DataFrame:
    """station, file_year, line_no, line (ISO-8859-1, one character for each byte). Lines end at \\n; one \\r before it is dropped.

    A gzip file is one split, so line numbers in a partition are in file order. damaged: a file that cannot be read to its
    end gives the lines before, and ``stored``, the bytes of each line with its end, tells who adds them up.
    """
    raw = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", str(damaged).lower()).text(paths if isinstance(paths, str) else list(paths))
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\r$", "")
    size = [(F.octet_length("value") + 1).alias("stored")] if damaged else []
    out = raw.select(F.col("_metadata.file_path").alias("path"), line.alias("line"), F.monotonically_increasing_id().alias("line_no"), *size)
    return out.withColumns(name_parts(F.col("path"))).where("known").drop("known", "path")


def bounded_methods(spark: SparkSession) -> None:
    """Operators whose fused method the JVM would not compile (over 8,000 bytes, it runs interpreted) run one by one."""
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, str(min(METHOD_BYTES, int(spark.conf.get(key)))))


def parse(lines: DataFrame, strict: bool = False, line: str = "line", keep_dropped: bool = False) -> DataFrame:
    """Reports of the lines: short lines and summaries dropped. Strict: a malformed number fails the query.

    keep_dropped: those lines stay as rows with no date, hour or value, for who counts lines.
    """
    bounded_methods(lines.sparkSession)
    at = F.col(line)
    used = F.coalesce((F.length(at) >= reports.MANDATORY) & ~F.trim(reports.field(at, 41, 46)).isin(*reports.SUMMARIES), F.lit(False))
    kept = lines.withColumn(line, F.when(used, at)) if keep_dropped else lines.where(used)
    return reports.parsed(kept, line, strict).drop(line).withColumn("special", F.coalesce(F.col("report_type") == reports.SPECIAL, F.lit(False)))


def malformed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines whose mandatory numbers cannot be read: the quarantine beside a lenient parse."""
    return lines.where(is_malformed(line))


def is_malformed(line: str = "line") -> Column:
    bad = F.lit(False)
    for start, end, missing in ((65, 69, "9999"), (87, 92, "+9999"), (93, 98, "+9999")):
        text = F.trim(reports.field(F.col(line), start, end))
        bad = bad | ((text != missing) & text.try_cast("int").isNull())
    stamp = F.try_to_date(reports.field(F.col(line), 15, 23), "yyyyMMdd")
    return F.coalesce((F.length(line) >= reports.MANDATORY) & (bad | stamp.isNull()), F.lit(False))


def line_estimate(sample_bytes: Column, sample_newlines: Column, file_bytes: Column) -> Column:
    """Lines of a file from a sample of it; 0 where the sample is empty or has no line end."""
    return F.when((sample_bytes == 0) | (sample_newlines == 0), 0.0).otherwise(sample_newlines / F.nullif(sample_bytes, F.lit(0)) * file_bytes)


#: Most names that are handed to the source one by one; of more files, all of the archive are looked at.
NAMED = 10_000


def archive_ends(spark: SparkSession, root: str, pattern: str = GLOB, names: Sequence[str] | None = None) -> DataFrame:
    """station, file_year and the ends of each file of the archive (``ranged.ArchiveEnds``), read by range.

    names: those files alone, if they are few. Where Arrow has no file system for the path's scheme, Spark reads the files whole.
    """
    if ranged.reachable(root):
        ranged.register(spark)
        reader = spark.read.format("archive_ends").option("pattern", pattern)
        if names is not None and len(names) <= NAMED:
            reader = reader.option("only", json.dumps(list(names)))
        ends = reader.load(root)
    else:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        cut = held.select("path", F.col("length").alias("size"), F.substring("content", 1, ranged.SAMPLE_BYTES).alias("head"), F.substring("content", -4, 4).alias("tail"))
        ends = cut.mapInArrow(_unpack, "path string, size bigint, cost bigint, bytes bigint, newlines bigint, whole bigint, error string")
    return ends.withColumns(name_parts(F.col("path"))).where("known").drop("known").where(F.col("file_year").between(*YEARS))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path, size, head, tail = (c.to_pylist() for c in batch.columns)
        samples = [ranged.unpacked(h) for h in head]
        columns = [path, size, size, [b for b, _ in samples], [n for _, n in samples], [int.from_bytes(t, "little") for t in tail]]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.nulls(len(path), pa.string())], names=["path", "size", "cost", "bytes", "newlines", "whole", "error"])


def estimated_lines(spark: SparkSession, root: str) -> DataFrame:
    """station, file_year, path, lines, cost: lines estimated from the first 64 KB of each gzip file and the length in its
    trailer (modulo 2^32); 0 where the sample holds no line end. cost: bytes of the file that were read."""
    ends = archive_ends(spark, root)
    lines = line_estimate(F.col("bytes").cast("double"), F.col("newlines").cast("double"), F.col("whole").cast("double"))
    return ends.select("station", "file_year", "path", lines.alias("lines"), "cost")


def estimate_error(estimated: DataFrame, counted: DataFrame) -> DataFrame:
    """files, median and p95: how far estimates are from counted lines (station, file_year, lines), as shares of these."""
    both = estimated.join(counted.withColumnRenamed("lines", "counted"), ["station", "file_year"])
    error = F.try_divide(F.abs(F.col("lines") - F.col("counted")), F.col("counted"))
    return both.agg(F.count("*").alias("files"), F.percentile_approx(error, 0.5).alias("median"), F.percentile_approx(error, 0.95).alias("p95"))


def manifest(rows: DataFrame, drop_origin: bool = True) -> DataFrame:
    """id, name, country, lat, lon, elevation from the text columns usaf, wban, name, ctry, lat, lon, elev and row_no.

    Rows without coordinates go, those at (0, 0) too if ``drop_origin`` (published stations) and not else (scoring).
    Elevations of -900 or less are unknown. Of repeated ids the last row counts.
    """
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    out = rows.select(
        F.concat_ws("-", "usaf", "wban").alias("id"), F.trim("name").alias("name"), F.trim("ctry").alias("country"), number("lat").alias("lat"), number("lon").alias("lon"),
        F.when(number("elev") > -900, number("elev")).alias("elevation"), "row_no",
    )
    out = out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if drop_origin:
        out = out.where(~((F.col("lat") == 0) & (F.col("lon") == 0)))
    return out.groupBy("id").agg(*(F.max_by(c, "row_no").alias(c) for c in ("name", "country", "lat", "lon", "elevation")))


def manifest_file(spark: SparkSession, path: str, drop_origin: bool = True) -> DataFrame:
    raw = spark.read.option("header", True).csv(path).withColumn("row_no", F.monotonically_increasing_id())
    names = {"USAF": "usaf", "WBAN": "wban", "STATION NAME": "name", "CTRY": "ctry", "LAT": "lat", "LON": "lon", "ELEV(M)": "elev"}
    return manifest(raw.select(*(F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(v) for k, v in names.items()), "row_no"), drop_origin)


def country_names(lines: DataFrame, line: str = "line") -> DataFrame:
    """code and country_name from fixed-width lines: 12 characters of code, then the name."""
    code, name = F.trim(F.substring(line, 1, 12)), F.trim(F.substr(F.col(line), F.lit(13)))
    return lines.select(code.alias("code"), scalar.title_name(name).alias("country_name")).where((F.col("code") != "") & (F.col("country_name") != ""))


def country_file(spark: SparkSession, path: str, header: int = 2) -> DataFrame:
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    numbered = raw.withColumn("no", F.row_number().over(W.orderBy("at")))  # a few hundred lines
    return country_names(numbered.where(F.col("no") > header))


def raster(spark: SparkSession, path: str, rows: int, columns: int, months: int = 12) -> DataFrame:
    """row, col, m (array of byte values by month) of a dense file of months x rows x columns bytes; land cells only.

    A file of another size fails the query. Each month of each row is cut out once, so no task holds more than the file.
    """
    size = rows * columns * months
    wrong = F.raise_error(F.concat(F.lit(f"a raster has {size} bytes, this one "), F.col("length").cast("string")))
    held = spark.read.format("binaryFile").load(path).select(F.when(F.col("length") == size, F.col("content")).otherwise(wrong.cast("binary")).alias("content"))
    cells = held.select("content", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    lines = cells.select("row", F.array(*(F.hex(F.substr(F.col("content"), F.lit(m * rows * columns + 1) + F.col("row") * columns, F.lit(columns))) for m in range(months))).alias("h"))
    out = lines.repartition("row").select("row", "h", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("col"))
    values = F.transform("h", lambda h: F.conv(F.substr(h, F.col("col") * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return out.select("row", "col", values.alias("m")).where(F.get("m", F.lit(0)) != 0)


def raster_tiles(spark: SparkSession, path: str, rows: int, columns: int) -> DataFrame:
    """The tile store (``spatial.tiles``) of a dense file of months x rows x columns bytes, cut from its bytes: no cell becomes a row.

    A file of another size fails the query. A raster is read by one task (78 MB at 0.1 degrees); tiles without land have no row.
    """
    from heliospan.operators import spatial

    size, wide, halo, months = spatial.tile_size(columns), spatial.tile_cells(spatial.tile_size(columns)), spatial.HALO, spatial.MONTHS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = content.as_buffer()
                if held.size != rows * columns * months:
                    raise ValueError(f"a raster has {rows * columns * months} bytes, this one {held.size}")
                grid = np.moveaxis(np.frombuffer(held, np.uint8).reshape(months, rows, columns), 0, 2)
                for trow in range(-(-rows // size)):
                    first, last = max(0, trow * size - halo), min(rows, (trow + 1) * size + halo)
                    band = np.zeros((wide, columns, months), np.uint8)
                    band[first - trow * size + halo :][: last - first] = grid[first:last]
                    found = []
                    for tcol in range(columns // size):
                        tile = band[:, np.arange(tcol * size - halo, (tcol + 1) * size + halo) % columns]
                        if tile[:, :, 0].any():
                            found.append((tcol, tile.tobytes()))
                    if found:
                        columns_of = [pa.array([trow] * len(found), pa.int32()), pa.array([t for t, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns_of, names=["trow", "tcol", "data"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "trow int, tcol int, data binary")


def class_image(spark: SparkSession, path: str) -> DataFrame:
    """row, col, code of a PNG image of 8-bit grey levels (not interlaced); level 0 is no class and has no row."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                levels = grey_levels(content)
                row, col = np.nonzero(levels)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(levels[row, col].astype(np.int32))], names=["row", "col", "code"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "row int, col int, code int")


def grey_levels(png: bytes) -> np.ndarray:
    """(rows, columns): the bytes of an 8-bit grey PNG, its line filters undone."""
    at, packed, shape = 8, b"", (0, 0)
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            shape = (int.from_bytes(data[4:8], "big"), int.from_bytes(data[:4], "big"))
            if data[8:] != bytes([8, 0, 0, 0, 0]):
                raise ValueError("not an image of 8-bit grey levels without interlacing")
        packed += data if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape[0], shape[1] + 1)
    out = np.zeros((shape[0] + 1, shape[1] + 1), np.int32)  # a line and a column of zeros before the first
    for i, line in enumerate(lines.astype(np.int32), 1):
        kind, line = line[0], line[1:]
        if kind in (0, 2):
            out[i, 1:] = line + (out[i - 1, 1:] if kind == 2 else 0) & 255
        elif kind == 1:
            out[i, 1:] = np.cumsum(line) & 255
        else:
            for j in range(1, shape[1] + 1):
                a, b, c = out[i, j - 1], out[i - 1, j], out[i - 1, j - 1]
                near = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                out[i, j] = line[j - 1] + near & 255
    return out[1:, 1:].astype(np.uint8)


#: Names of the monthly vegetation files, with year and month.
NDVI_NAME = r"^veg_ndvi_avhrr\.mod09ga_p90_5km_s0\.\.0cm_(\d{4})(\d{2})01\.\.\d{8}_v1\.0\.tif$"


def ndvi_files(listed: DataFrame, years: Sequence[int], months: Sequence[int], name: str = "name") -> DataFrame:
    """Of the listed files, those of the given years and months, with year and month, by name."""
    part = lambda i: F.regexp_extract(F.col(name), NDVI_NAME, i).try_cast("int")
    found = listed.where(F.col(name).rlike(NDVI_NAME)).withColumns({"year": part(1), "month": part(2)})
    return found.where(F.col("year").isin(*years) & F.col("month").isin(*months)).orderBy(name)

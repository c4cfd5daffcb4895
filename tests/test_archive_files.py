"""Files read by range, damaged files and caches, and counts that come with the write."""

import gzip
import random

from pyspark.sql import functions as F
from test_derived import STATIONS, manifest
from test_reports import line, write_archive

from heliospan.plans import weather
from heliospan.sources import files, outputs, ranged


def statuses(df):
    return {(r["station"][0], r["file_year"]): r["status"] for r in df.collect()}


def test_reads_only_the_ends(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    text = "\n".join(line(rest="".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randint(20, 120)))) for _ in range(9000)) + "\n"
    folder = tmp_path / "isd" / "2021"
    folder.mkdir(parents=True)
    big, small = (folder / f"{s}-2021.gz" for s in STATIONS[:2])
    big.write_bytes(gzip.compress(text.encode()))
    small.write_bytes(gzip.compress(b"a\nb\nc\n"))
    (folder / f"{STATIONS[2]}-2021.gz").write_bytes(b"no gzip at all")
    (folder / "notes.gz").write_bytes(b"x")
    assert big.stat().st_size > 6 * ranged.SAMPLE_BYTES
    got = {r["station"]: r for r in files.estimated_lines(spark, str(tmp_path / "isd")).collect()}
    assert {s: r["cost"] for s, r in got.items()} == {STATIONS[0]: ranged.SAMPLE_BYTES + 4, STATIONS[1]: small.stat().st_size, STATIONS[2]: 14}
    assert got[STATIONS[1]]["lines"] == 3 and got[STATIONS[2]]["lines"] == 0 and abs(got[STATIONS[0]]["lines"] / 9000 - 1) < 0.05
    counted = spark.createDataFrame([(STATIONS[0], 2021, 9000), (STATIONS[1], 2021, 3)], "station string, file_year int, lines long")
    error = files.estimate_error(files.estimated_lines(spark, str(tmp_path / "isd")), counted).first()
    assert error["files"] == 2 and error["median"] == 0 and error["p95"] < 0.05
    # a scheme that only Spark reads: the same numbers, at the cost of whole files
    monkeypatch.setattr(ranged, "reachable", lambda root: False)
    whole = {r["station"]: r for r in files.estimated_lines(spark, str(tmp_path / "isd")).collect()}
    assert {s: r["lines"] for s, r in whole.items()} == {s: r["lines"] for s, r in got.items()} and whole[STATIONS[0]]["cost"] == big.stat().st_size


def test_packs_of_files(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}.gz").write_bytes(gzip.compress(b"x\n" * i))
    ranged.register(spark)
    read = spark.read.format("archive_ends").option("pattern", "*.gz").option("pack", 3).load(str(tmp_path))
    assert sorted(r["newlines"] for r in spark.read.format("archive_ends").option("only", '["f2.gz", "f5.gz", "x"]').load(str(tmp_path)).collect()) == [2, 5]
    assert read.rdd.getNumPartitions() == 3 and sorted(r["newlines"] for r in read.collect()) == list(range(7))
    assert spark.read.format("archive_ends").load(str(tmp_path / "nothing")).count() == 0


def test_bad_files_do_not_stop_the_others(spark, tmp_path):
    root, strict = tmp_path / "isd", True
    for s in STATIONS:
        write_archive(root, s, (2021,))
    write_archive(root, STATIONS[0], (2022, 2023))
    cut, odd = root / "2021" / f"{STATIONS[1]}-2021.gz", root / "2021" / f"{STATIONS[2]}-2021.gz"
    cut.write_bytes(cut.read_bytes()[:-9000])
    odd.write_bytes(gzip.compress(gzip.decompress(odd.read_bytes()).replace(b"+0235", b"+0x35", 1)))
    cache = str(tmp_path / "cache")
    found = weather.from_archive(spark, str(root), manifest(tmp_path), strict=strict, cache=cache)
    want = {("1", 2021): "ok", ("1", 2022): "ok", ("1", 2023): "ok", ("2", 2021): "damaged", ("3", 2021): "malformed"}
    assert statuses(found.files) == want
    assert {(r["station"][0], r["file_year"]) for r in found.years.collect()} == {k for k, v in want.items() if v == "ok"}
    # not strict, what cannot be read in a line is null; the bad ones are tried again, the good ones are not
    again = weather.cached_hours(spark, str(root), cache)
    assert statuses(again[1]) == {("2", 2021): "damaged", ("3", 2021): "ok"}
    # a damaged file of the cache: its station-years are read anew
    part = next(p for p in (tmp_path / "cache" / "file_year=2022").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:40])
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    third, status = weather.cached_hours(spark, str(root), cache)
    assert statuses(status) == {("1", 2022): "ok", ("2", 2021): "damaged"}
    assert {r["file_year"]: r["count"] for r in third.where(F.col("station") == STATIONS[0]).groupBy("file_year").count().collect()} == dict.fromkeys((2021, 2022, 2023), 8760)


def test_outcomes_are_counted_by_the_write(spark, tmp_path):
    ids = spark.createDataFrame([(s,) for s in "abcdef"], "station string")
    derived = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "station string, avg_score double")
    places = spark.createDataFrame([("a", "A"), ("c", "C"), ("f", "F")], "id string, name string")
    stations, outcomes = outputs.counted_outcomes(ids, derived, places)
    stations.write.parquet(str(tmp_path / "out"))
    asked = {r["outcome"]: r["n"] for r in outputs.publish_misses(ids, derived, places).collect()}
    assert outcomes.get == asked == {"published": 2, "without derived data": 3, "without manifest match": 1}
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1.0, "A"), ("c", 3.0, "C")]

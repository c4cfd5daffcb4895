"""The stream beyond hours: after several batches, one of them replayed, it holds what one batch run holds."""

from pyspark.sql import functions as F
from test_derived import STATIONS, manifest
from test_reports import write_archive

from heliospan.plans import weather
from heliospan.sources import files
from heliospan.streaming import ingest


def rows(df, columns):
    kinds = dict(df.dtypes)
    return sorted(map(str, df.select(*(F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in columns)).collect()))


def test_stream_equals_batch(spark, tmp_path):
    root, out, checkpoint = tmp_path / "isd", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    places = files.manifest_file(spark, manifest(tmp_path)).select(F.col("id").alias("station"), "lat", "lon")
    write_archive(root, STATIONS[0], (2021, 2022))
    ingest.stream_climate(spark, str(root), out, checkpoint, places).awaitTermination()
    write_archive(root, STATIONS[0], (2023,))
    write_archive(root, STATIONS[1], (2021,))
    ingest.stream_climate(spark, str(root), out, checkpoint, places).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out" / "years").iterdir()) == ["batch=0", "batch=1"]
    whole = weather.from_archive(spark, str(root), str(tmp_path / "m.csv"))
    want = [rows(df, df.columns) for df in (whole.years, whole.months, whole.stations)]
    columns = [df.columns for df in (whole.years, whole.months, whole.stations)]

    def now():
        return [rows(df, c) for df, c in zip(ingest.streamed(spark, out), columns, strict=True)]

    assert now() == want and [len(x) for x in want] == [4, 48, 1]
    # a replayed batch, and one that died between its two tables
    held = whole.hours.where(F.col("station") == STATIONS[1])
    ingest.upsert(whole.hours.where((F.col("file_year") == 2023) | (F.col("station") == STATIONS[1])), places, out, 1)
    whole.months.limit(3).write.parquet(f"{out}/months/batch=2")
    assert now() == want
    # a station-year that comes again replaces its rows
    ingest.upsert(held.withColumn("temp_c", F.lit(None).cast("double")), places, out, 2)
    years = {(r["station"], r["file_year"]): r["excluded_criterion"] for r in ingest.streamed(spark, out)[0].collect()}
    assert len(years) == 4 and years[STATIONS[1], 2021] == "temp_c" and years[STATIONS[0], 2023] is None
    assert {r["station"] for r in ingest.streamed(spark, out)[1].select("station").distinct().collect()} == {STATIONS[0]}

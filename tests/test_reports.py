"""Golden report lines and a whole archive, from gzip files to stations."""

import datetime
import gzip
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospan.functions import reports, scalar
from heliospan.operators import compose, days, hours
from heliospan.plans import raw, weather
from heliospan.sources import files, outputs
from heliospan.streaming.ingest import stream_hours


def line(date="20240105", hour="12", kind="FM-15", wind="0031", temp="+0215", dew="-0040", rest=""):
    head = "0" * 15 + date + hour + "00" + "0" * 14 + kind.ljust(5) + "0" * 19 + wind + "0" * 18 + temp + "1" + dew + "1" + "0" * 6
    assert len(head) == 105
    return head + rest


def parse(spark, text, strict=False):
    rows = files.parse(spark.createDataFrame([("s", 2024, 0, text)], "station string, file_year int, line_no long, line string"), strict).collect()
    return rows[0] if rows else None


def test_mandatory(spark):
    r = parse(spark, line())
    assert (r["utc_date"], r["utc_hour"], r["wind_mps"], r["temp_c"], r["dew_c"]) == (datetime.date(2024, 1, 5), 12, 3.1, 21.5, -4.0)
    r = parse(spark, line(wind="9999", temp="+9999", dew="+9999"))
    assert (r["wind_mps"], r["temp_c"], r["dew_c"]) == (None, None, None)
    assert parse(spark, line()[:104]) is None and parse(spark, line(kind="SOD")) is None
    assert parse(spark, line(temp="+0x15"))["temp_c"] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parse(spark, line(temp="+0x15"), strict=True)
    bad = spark.createDataFrame([(line(temp="+0x15"),), (line(),)], "line string")
    assert files.malformed(bad).count() == 1


@pytest.mark.parametrize(
    "rest,want",
    [
        ("AA101000591AA101001291", {"precip_mm": 1.2}),
        ("AA112005091AA106009991AA103001191", {"precip_mm": None}),
        ("AA124005091AA206009991AA303001191AA403002291", {"acc_period": 3, "acc_depth": 1.1}),
        ("AA106999991AA101999991", {"acc_period": None, "precip_mm": None}),
        ("GA1091+003001061", {"cloud_pct": 100.0}),
        ("GA1991+003001061GA2101+003001061", {"cloud_pct": None}),
        ("GA1041+003001061GA2021+003001061", {"cloud_pct": 50.0}),
        ("MW1501", {"wx_wet": True}),
        ("MW1491", {"wx_wet": False}),
        ("MW1201", {"wx_wet": None}),
        ("AW1401", {"wx_wet": True}),
        ("AW1291", {"wx_wet": None}),
        ("REMMET060METAR KXYZ -RA BKN010CB RMK RA OVC001", {"wx_wet": True, "cloud_pct": 75.0}),
        ("REMMET060SPECI KXYZ VCSH BLSN CLR", {"wx_wet": False, "cloud_pct": 0.0}),
        ("REMMET060METAR KXYZ +FZRA VV002", {"wx_wet": True, "cloud_pct": 100.0}),
        ("MW1551REMMET060METAR KXYZ CAVOK", {"wx_wet": True, "cloud_pct": 0.0}),
        ("GA1021+003001061REMMET060METAR KXYZ OVC010", {"cloud_pct": 25.0, "wx_wet": False}),
    ],
)
def test_groups(spark, rest, want):
    r = parse(spark, line(rest=rest))
    if rest.startswith("AA112"):
        want = {"precip_mm": None, "acc_period": 3, "acc_depth": 1.1}
    assert {k: r[k] for k in want} == want


def test_merge(spark):
    rows = [(0, False, 1.0, None, 0.0, None), (1, True, 9.0, 5.0, 2.0, True), (2, False, 2.0, None, None, False)]
    made = spark.createDataFrame(rows, "line_no long, special boolean, temp_c double, dew_c double, precip_mm double, wx_wet boolean")
    made = made.withColumns({"station": F.lit("s"), "file_year": F.lit(2024), "utc_date": F.lit(datetime.date(2024, 1, 1)), "utc_hour": F.lit(3), "wind_mps": F.lit(1.0), "cloud_pct": F.lit(None).cast("double"), "acc_period": F.lit(None).cast("int"), "acc_depth": F.lit(None).cast("double")})
    for frame in (made, made.repartition(3), made.orderBy(F.desc("line_no"))):
        r = hours.merge_hours(frame).first()
        assert (r["temp_c"], r["dew_c"], r["precip_mm"], r["wx_wet"], r["cloud_pct"], r["acc_period"]) == (2.0, 5.0, 2.0, True, None, None)


def write_archive(root, station="123456-99999", years=(2021, 2022, 2023)):
    for year in years:
        (root / str(year)).mkdir(parents=True, exist_ok=True)
        text = []
        for day in range(365):
            date = datetime.date(year, 1, 1) + datetime.timedelta(day)
            for h in range(24):
                sky = "CLR" if day % 4 else "OVC010"
                text.append(line(date.strftime("%Y%m%d"), f"{h:02d}", temp=f"+{(235 if day % 3 else 401):04d}", dew="+0100", rest=("AA101000091" if h == 0 else "") + f"REMMET060METAR KXYZ {sky} \xe9"))
        with gzip.open(root / str(year) / f"{station}-{year}.gz", "wb") as f:
            f.write("\r\n".join(text).encode("latin-1"))


@pytest.mark.parametrize(
    "rest,want",
    [
        ("AA199001091AA101999991AA101000391", {"precip_mm": 0.3}),
        ("AA103999991AA206004091AA303002091", {"acc_period": 3, "acc_depth": 2.0}),
        ("GA1091+003001061GA2111+003001061", {"cloud_pct": 137.5}),
        ("MW1281", {"wx_wet": False}),
        ("MW1291AW1281", {"wx_wet": False}),
        ("MW1991", {"wx_wet": True}),
        ("REMMET060METAR KXYZ XOVC010 OVC01 SCT020", {"cloud_pct": 50.0}),
        ("REMMET060METAR KXYZ FEW010 BKN020TCU VV1", {"cloud_pct": 75.0}),
        ("REMMET060METAR KXYZ CLRX -RAX RA- +-RA", {"cloud_pct": None, "wx_wet": False}),
        ("REMMET060METAR KXYZ -SHTSRASN", {"wx_wet": True}),
        ("REMMET060SPECI K METAR A RA RMK SN", {"wx_wet": True}),
        ("REMMET060NOTHING RA", {"wx_wet": None, "cloud_pct": None}),
    ],
)
def test_groups_by_pattern(spark, rest, want):
    r = parse(spark, line(rest=rest))
    assert {k: r[k] for k in want} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_sorts_nothing(spark):
    rows = files.parse(spark.createDataFrame([("s", 2024, 0, line())], "station string, file_year int, line_no long, line string"))
    text = plan(hours.merge_hours(rows))
    assert "SortAggregate" not in text and "Sort " not in text and "HashAggregate" in text


def test_reads_raw_files_once(spark, tmp_path):
    """The hours are cached by file with its size and time; a run reads what is new or changed, and years and stations read days, not hours."""
    root = tmp_path / "isd"
    write_archive(root, years=(2021, 2022))
    cache = str(tmp_path / "cache")
    first, _ = weather.cached_hours(spark, str(root), cache)
    assert "FileScan text" not in plan(first) and {r["n"] for r in first.groupBy("file_year").agg(F.count("*").alias("n")).collect()} == {8760}
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    write_archive(root, years=(2023,))
    (tmp_path / "m.csv").write_text("USAF,WBAN,STATION NAME,CTRY,LAT,LON,ELEV(M)\n123456,99999,HILL,US,10.0,15.0,7\n")
    again = weather.from_archive(spark, str(root), str(tmp_path / "m.csv"), cache=cache)
    assert sorted(r["file_year"] for r in again.years.collect()) == [2021, 2022, 2023]
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert "text" not in plan(again.hours) and "utc_hour" not in plan(again.stations) and "utc_hour" not in plan(again.months)
    write_archive(root, years=(2023,))  # written again: only its newest hours count
    assert weather.cached_hours(spark, str(root), cache)[0].count() == 3 * 8760


def test_inspect(spark, tmp_path):
    write_archive(tmp_path / "isd", years=(2021,))
    (tmp_path / "m.csv").write_text("USAF,WBAN,STATION NAME,CTRY,LAT,LON,ELEV(M)\n123456,99999,HILL,US,10.0,15.0,7\n")
    text = weather.inspect(spark, str(tmp_path / "isd"), str(tmp_path / "m.csv"), "123456-99999")
    assert text.startswith("123456-99999\nyear") and "score=0." in text and "needs 3 usable years" in text


def test_cadence_counts_raw_lines(spark, tmp_path):
    """Short lines and summaries are lines too: without them this station would have too few."""
    (tmp_path / "2021").mkdir()
    with gzip.open(tmp_path / "2021" / "123456-99999-2021.gz", "wb") as f:
        f.write("\n".join([line("20210105", "12")] + ["short"] * 2000 + [line("20210105", "13", kind="SOD")] * 600).encode())
    held = weather.archive_hours(spark, f"{tmp_path}/*/{files.GLOB}")
    assert held.agg(F.sum("lines")).first()[0] == 2601 and held.where("utc_date is not null").count() == 1
    found = hours.cadence_of(held.groupBy("station", "file_year").agg(F.sum("lines").alias("lines"))).first()
    assert found["accepted"] and hours.cadence(files.report_lines(spark, f"{tmp_path}/*/{files.GLOB}")).first()["lines"] == 2601
    guess = files.estimated_lines(spark, str(tmp_path)).first()
    assert abs(guess["lines"] - 2600) <= 1 and (guess["station"], guess["file_year"]) == ("123456-99999", 2021)


def year_rows(spark, rows):
    """years: (station, year, excluded criterion, 'days' or None, coverage)."""
    made = [(s, y, None if why is None else "days" if why == "days" else "coverage", None if why in (None, "days") else why, 0.2 if why else None, c, 1 + y % 2) for s, y, why, c in rows]
    frame = spark.createDataFrame(made, "station string, file_year int, excluded_kind string, excluded_criterion string, excluded_value double, cover double, step int")
    return frame.withColumns({f"coverage_{c}": F.col("cover") for c in ("temp_c", "dew_c", "precip_mm", "cloud_pct", "wind_mps")})


def test_exclusions(spark):
    """The reason is the criterion, whatever the percentages: two years without temperature beat one without dew."""
    rows = [("a", 2010, "dew_c", 0.1), ("a", 2011, "temp_c", 0.2), ("a", 2012, "temp_c", 0.21), ("b", 2010, "days", 0.5), ("b", 2011, "cloud_pct", 0.3), ("c", 2010, None, 0.9), ("c", 2011, "days", 0.9), ("d", 2010, None, 0.9), ("d", 2011, None, 0.9), ("d", 2012, None, 0.9)]
    years = year_rows(spark, rows)
    got = {r["station"]: r["reason"] for r in days.exclusions(years).collect()}
    assert got == {"a": "temp_c", "b": "too few valid days", "c": "fewer than 3 valid years"}
    names = spark.createDataFrame([("a", "Hill")], "station string, name string")
    shown = [(r["station"], r["reason"], r["name"], r["years"], r["last_step"], r["mean_temp_c"]) for r in compose.explained(years, names).collect()]
    assert shown == [("c", "few years", "?", 2, 2, 90), ("a", "temp_c", "Hill", 3, 1, 17), ("b", "valid days", "?", 2, 2, 40)]
    assert [r["station"] for r in compose.explained(years, names, ["valid days", "few years"]).collect()] == ["c", "b"]


def test_published_files(spark, tmp_path):
    root = tmp_path / "isd"
    write_archive(root)
    (tmp_path / "m.csv").write_text("USAF,WBAN,STATION NAME,CTRY,LAT,LON,ELEV(M)\n123456,99999,HILL,US,10.0,15.0,7.5\n")
    found = weather.from_archive(spark, str(root), str(tmp_path / "m.csv"))
    countries = spark.createDataFrame([("US", "United States")], "code string, country_name string")
    green = spark.createDataFrame([(800, 1950, [128 + m for m in range(12)])], "row int, col int, m array<int>")
    stations = weather.publish(found, files.manifest_file(spark, str(tmp_path / "m.csv")), countries, green)
    outputs.write_stations(stations, str(tmp_path / "stations"))
    text = "".join(p.read_text() for p in (tmp_path / "stations").glob("part-*"))
    (row,) = json.loads(text)
    assert tuple(row) == compose.PUBLISHED and row["elevation"] == 8 and row["vegetation_source"] == "ndvi" and row["id"] == "123456-99999"
    s = found.stations.first()
    for c, d in compose.DIGITS.items():
        if c in s.asDict() and s[c] is not None:
            assert row[c] == round(s[c], d)
    assert row["avg_net_days"] == round(s["avg_perfect_days"] - s["avg_indoor_days"], 2) and row["avg_ndvi"] == round(sum((127 + m) / 254 for m in range(12)) / 12, 3)
    folder = tmp_path / "details"
    folder.mkdir()
    (folder / "999999-00000.json").write_text("{}")
    outputs.write_details(weather.details(found), str(folder))
    assert [f.name for f in folder.iterdir() if f.suffix == ".json"] == ["123456-99999.json"]
    detail = json.loads((folder / "123456-99999.json").read_text())
    assert detail["min_data_fraction"] == 0.3333 and [y["year"] for y in detail["years"]] == [2021, 2022, 2023] and "excluded" not in detail["years"][0] and detail["years"][0]["valid_days"] == 1.0
    assert set(detail["monthly"]) == {"temp", "dew", "cloud", "wind", "rain", "perfect", "indoor", "gloom"} and len(detail["monthly"]["temp"]) == 12
    left_out = days.year_details(found.years.withColumns({"excluded_kind": F.lit("days"), "excluded_value": F.lit(0.28571)}))
    gone = json.loads(outputs.details_json(left_out.groupBy(F.col("station").alias("id")).agg(F.collect_list(F.struct("year", "excluded", "score")).alias("years"))).first()["json"])
    assert gone["years"][0]["excluded"] == {"kind": "days", "value": 0.286} and "score" not in gone["years"][0]


def test_outcomes(spark):
    signed = spark.createDataFrame([(s, f"v{s}") for s in "abc"], "station string, signature string")
    derived, excluded = (spark.createDataFrame(x, f"station string, {c} string") for x, c in (([("a", "1")], "score"), ([("a", "old"), ("b", "no data")], "reason")))
    kept, marks = outputs.outcomes(derived, excluded, signed, 3)
    assert [tuple(r) for r in marks.select("station", "reason", "version").collect()] == [("b", "no data", 3)]
    todo = lambda v, s=signed: sorted(r["station"] for r in outputs.to_derive(s, v, kept, marks, None).collect())
    assert todo(3) == ["c"] and todo(4) == ["a", "b", "c"] and todo(3, signed.withColumn("signature", F.concat("signature", F.when(F.col("station") == "a", "x").otherwise("")))) == ["a", "c"]
    listed = spark.createDataFrame([("a", 2010, 5, 1), ("a", 2011, 6, 1), ("b", 2010, 5, 1)], "station string, file_year int, size int, modified int")
    one, two = (outputs.signatures(x).where("station = 'a'").first()["signature"] for x in (listed, listed.withColumn("size", F.col("size") + 1)))
    assert one != two and one == outputs.signatures(listed.orderBy(F.desc("file_year"))).where("station = 'a'").first()["signature"]


def png(levels, kind):
    """An 8-bit grey image whose lines all have one filter."""
    levels = np.array(levels, np.int32)
    up = np.vstack([np.zeros_like(levels[:1]), levels[:-1]])
    left, corner = (np.hstack([np.zeros((len(x), 1), np.int32), x[:, :-1]]) for x in (levels, up))
    p = left + up - corner
    paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    body = (levels - [0, left, up, (left + up) // 2, paeth][kind]) % 256
    data = b"".join(bytes([kind]) + bytes(r.astype(np.uint8)) for r in body)
    chunk = lambda name, x: len(x).to_bytes(4, "big") + name + x + zlib.crc32(name + x).to_bytes(4, "big")
    head = levels.shape[1].to_bytes(4, "big") + levels.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 31, (6, 9))
    for kind in range(5):
        (tmp_path / f"{kind}.png").write_bytes(png(levels, kind))
        cells = {(r["row"], r["col"]): r["code"] for r in files.class_image(spark, str(tmp_path / f"{kind}.png")).collect()}
        assert cells == {(i, j): int(levels[i, j]) for i in range(6) for j in range(9) if levels[i, j]}
    held = rng.integers(0, 3, (12, 4, 5)).astype(np.uint8)
    (tmp_path / "grid.u8").write_bytes(held.tobytes())
    grid = files.raster(spark, str(tmp_path / "grid.u8"), 4, 5)
    assert {(r["row"], r["col"]): r["m"] for r in grid.collect()} == {(i, j): held[:, i, j].tolist() for i in range(4) for j in range(5) if held[0, i, j]}
    outputs.write_raster(grid, str(tmp_path / "grid"))
    assert spark.read.parquet(str(tmp_path / "grid")).count() == grid.count()
    with pytest.raises(Exception, match="a raster has 300 bytes"):
        files.raster(spark, str(tmp_path / "grid.u8"), 5, 5).collect()


def test_archive(spark, tmp_path):
    root = tmp_path / "isd"
    write_archive(root)
    (root / "2021" / "notes.gz").write_bytes(b"x")
    (tmp_path / "m.csv").write_text('USAF,WBAN,STATION NAME,CTRY,LAT,LON,ELEV(M)\n123456,99999, HILL ,US,10.0,15.0,-999.9\n1,2,X,US,,1,2\n')
    index = files.station_index(files.station_files(spark, str(root))).collect()
    assert [(r["station"], [f["file_year"] for f in r["files"]]) for r in index] == [("123456-99999", [2021, 2022, 2023])]
    found = weather.from_archive(spark, str(root), str(tmp_path / "m.csv"))
    years = {r["file_year"]: r for r in found.years.collect()}
    assert all(y["valid_days"] == 365 and y["step"] == 1 and y["excluded_kind"] is None for y in years.values())
    days = range(365)
    assert years[2022]["indoor_count"] == sum(d % 3 == 0 for d in days) and years[2022]["gloomy_count"] >= 90
    s = found.stations.collect()
    assert len(s) == 1 and s[0]["years_included"] == 3 and 0 <= s[0]["avg_score"] <= 1 and s[0]["avg_bad_days"] <= s[0]["avg_indoor_days"] + s[0]["avg_gloomy_days"] + 1e-9
    manifest = files.manifest_file(spark, str(tmp_path / "m.csv"))
    countries = files.country_names(spark.createDataFrame([("US          UNITED STATES",)], "line string"))
    out = weather.publish(found, manifest, countries).collect()
    assert out[0]["country_name"] == "United States" and out[0]["elevation"] is None and out[0]["avg_score"] == 0.5 and out[0]["vegetation_source"] == "rain"
    outputs.write_hours(found.hours, str(tmp_path / "hours"))
    done = spark.read.parquet(str(tmp_path / "hours"))
    assert outputs.to_process(files.station_files(spark, str(root)), done).count() == 0 and outputs.read_versioned(spark, str(tmp_path / "none"), 1) is None
    query = stream_hours(spark, str(root), str(tmp_path / "stream"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == done.count()


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    for v, d in ((2.675, 2), (0.125, 2), (0.5, 0), (1.5, 0), (-2.345, 2), (1e5 / 3, 1)):
        assert get(scalar.rounded(F.lit(float(v)), d)) == round(v, d)
    assert [get(scalar.utc_offset(F.lit(x))) for x in (7.5, 22.5, -187.0, 179.0)] == [0, 2, -12, 12]
    assert get(scalar.utc_offset(F.lit(None).cast("double"))) == 0
    nothing = F.lit(None).cast("double")
    assert get(scalar.goodness(nothing, F.lit(0.0), F.lit(1.0))) is None and get(scalar.goodness(F.lit(0.25), F.lit(0.0), F.lit(1.0), False)) == 0.75
    assert get(scalar.vegetation(F.lit(None).cast("array<double>"))["vegetation"]) is None and get(scalar.utc_offset(F.lit(float("nan")))) == 0
    lush = F.array(*(F.lit(0.5 if m in (10, 11, 0, 1) else 0.2) for m in range(12)))
    assert get(scalar.longest_lush_run(lush)) == 4 and get(scalar.longest_lush_run(F.array(*[F.lit(0.6)] * 12))) == 12
    assert get(scalar.title_name(F.lit("COTE D'IVOIRE"))) == "Cote D'Ivoire" and get(scalar.title_name(F.lit("ANTIGUA AND BARBUDA"))) == "Antigua and Barbuda"
    assert get(reports.metar_wet(F.lit("KXYZ TSRA"))) and not get(reports.metar_wet(F.lit("VCSH RAX")))


def test_entry(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert __spark_entry__.entry(spark).count() > 0


def test_lines_are_made_once(spark):
    """No query on made-up lines spells them anew for its filter, and no fused method is larger than the JVM compiles."""
    shown, limit = "spark.sql.debug.maxToStringFields", "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(shown, "1000")
    for name in ("parse_lines", "parse_mandatory", "parse_precip_groups", "parse_cloud_groups", "present_weather", "metar_body", "wet_tokens", "metar_cloud", "malformed_lines"):
        spark.conf.unset(limit)
        plan = raw.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # in both branches of one CASE
        assert plan.count("REMMET050") == 2 and int(spark.conf.get(limit)) <= 8000
    spark.conf.unset(shown)


def test_lines_are_exploded_from_a_column_and_read_by_few_patterns(spark):
    """An explode of an expression would be interpreted, and all depths come from one pattern."""
    shown = "spark.sql.debug.maxToStringFields"
    spark.conf.set(shown, "1000")
    plans = [raw.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for name in ("parse_lines", "parse_precip_groups", "metar_body")]
    spark.conf.unset(shown)
    assert all("Generate explode(made#" in p for p in plans)
    assert [p.count("regexp_extract") for p in plans] == [2, 1, 0]
    held = spark.createDataFrame([("0" * 105 + "AAA101001291AA10199999AA206999991AA2060007919AA103003091REM",)], "line string")
    assert [tuple(r) for r in reports.with_sections(held).select(*(c.alias(n) for n, c in reports.precipitation().items())).collect()] == [(1.2, 3, 3.0)]


def test_methods_of_made_lines_are_compiled(spark):
    """Fused, no query on made-up lines has a method that the JVM would not compile, so none of them falls back to unfused operators."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        for name in ("parse_lines", "parse_mandatory", "parse_precip_groups", "parse_cloud_groups", "present_weather", "metar_body", "wet_tokens", "metar_cloud", "malformed_lines"):
            stages = raw.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
            assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() <= files.METHOD_BYTES for i in range(stages.size())), name
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_lines_are_rounded_without_decimal_text(spark):
    """Whole numbers as ``round`` gives them, halves and what lies next to them included."""
    values = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 7.000000000000001, 28.499999999999996, 99.99999999999999, 2147483646.5, -2147483647.5, None]
    held = spark.createDataFrame([(x,) for x in values], "x double")
    rows = held.select(raw._rounded(F.col("x")).alias("got"), F.round("x").cast("int").alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert "round(" not in raw.QUERIES["present_weather"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

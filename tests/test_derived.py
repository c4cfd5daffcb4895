"""Incremental results, tables that change together, clustered hours, and what the plans exchange and sort."""

import json

import pytest
from pyspark.sql import functions as F
from test_reports import write_archive

from heliospan.operators import days, hours
from heliospan.plans import weather
from heliospan.sources import files, outputs, snapshots

STATIONS = ("111111-99999", "222222-99999", "333333-99999")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def manifest(tmp_path):
    rows = "".join(f"{s[:6]},99999,HILL,US,10.0,{i * 30}.0,7\n" for i, s in enumerate(STATIONS))
    (tmp_path / "m.csv").write_text("USAF,WBAN,STATION NAME,CTRY,LAT,LON,ELEV(M)\n" + rows)
    return str(tmp_path / "m.csv")


def state(spark, folder):
    now = snapshots.current(spark, folder)
    return now.number, now.notes, {n: sorted(map(str, df.collect())) for n, df in now.tables.items()}


def test_derives_what_changed(spark, tmp_path, monkeypatch):
    root, folder, cache = tmp_path / "isd", str(tmp_path / "derived"), str(tmp_path / "cache")
    write_archive(root, STATIONS[0])
    write_archive(root, STATIONS[1], (2021, 2022))  # too few years
    (root / "2021" / "444444-99999-2021.gz").write_bytes(__import__("gzip").compress(b"short\n"))  # too few reports

    def run():
        return weather.from_archive(spark, str(root), manifest(tmp_path), cache=cache, derived=folder)

    found = run()
    whole = weather.from_archive(spark, str(root), str(tmp_path / "m.csv"))
    for got, want in ((found.stations, whole.stations), (found.years, whole.years), (found.months, whole.months)):
        shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
        assert sorted(map(str, got.select(*shown).collect())) == sorted(map(str, want.select(*shown).collect()))
    first = state(spark, folder)
    assert first[:2] == (1, {"listed": 3, "recomputed": 3}) and len(first[2]["stations"]) == 1
    marks = {r["station"]: r["reason"] for r in snapshots.current(spark, folder).tables["excluded"].collect()}
    assert marks == {STATIONS[1]: "fewer than 3 valid years", "444444-99999": weather.FEW_REPORTS}
    run()
    assert state(spark, folder) == first  # nothing to do, no commit

    # a run dies between writing its tables and the commit, and readers see the tables of before
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            snapshots.commit(spark, folder, {"stations": whole.stations.limit(0)}, {}, after=1)
    assert state(spark, folder) == first
    write_archive(root, STATIONS[1], (2023,))  # one file changes
    again = run()
    number, notes, tables = state(spark, folder)
    assert (number, notes) == (2, {"listed": 3, "recomputed": 1}) and len(tables["stations"]) == 2 and len(tables["excluded"]) == 1
    assert {r["station"] for r in again.days.select("station").distinct().collect()} == {STATIONS[1]}
    assert first[2]["stations"][0] in tables["stations"] and len(tables["years"]) == 6
    # another run took the number
    with pytest.raises(Exception, match="exist"):
        snapshots.commit(spark, folder, {"stations": again.stations}, {}, after=1)
    assert state(spark, folder)[:2] == (number, notes)
    # a station that is gone loses its rows, and nothing is derived
    for f in root.rglob("444444*"):
        f.unlink()
    for f in root.rglob(f"{STATIONS[0]}*"):
        f.unlink()
    run()
    number, notes, tables = state(spark, folder)
    assert (number, notes) == (3, {"listed": 1, "recomputed": 0}) and len(tables["stations"]) == 1 and tables["excluded"] == []
    assert len(list((tmp_path / "derived" / "tables").iterdir())) == 4  # of two commits, and of two runs that did not get there


def hour_rows(spark):
    return spark.sql(
        """SELECT s AS station, 2021 AS file_year, date_add(date'2021-01-01', d) AS utc_date, h AS utc_hour, 20.0D + h % 5 AS temp_c, 10.0D AS dew_c, 3.0D AS wind_mps,
        if(d % 7 < 4, 90.0D, 10.0D) AS cloud_pct, if(h % 3 = 0, null, 0.0D) AS precip_mm, if(h % 4 = 0, h % 8 = 0, null) AS wx_wet, if(h % 6 = 0, 6, null) AS acc_period, if(h % 6 = 0, 0.4D, null) AS acc_depth
        FROM (SELECT explode(array('a', 'b', 'c')) AS s) CROSS JOIN (SELECT explode(sequence(0, 364)) AS d) CROSS JOIN (SELECT explode(sequence(0, 23)) AS h)"""
    )


def test_clustered_hours_need_no_exchange(spark, tmp_path):
    places = spark.createDataFrame([("a", 10.0, 0.0), ("b", 50.0, 60.0), ("c", -30.0, -120.0)], "station string, lat double, lon double")
    outputs.write_bucketed(hour_rows(spark), "hours_by_station", str(tmp_path / "hours"), 4)
    held = outputs.bucketed(spark, "hours_by_station", str(tmp_path / "hours"), 4)
    try:
        text = plan(weather.summed_days(held, places, clustered=True)[1])
        _, found = weather.scored_days(held, places, clustered=True)
        assert "Exchange hashpartitioning" not in text and "SortAggregate" not in text and "Window" not in text and "SortMergeJoin" not in text
        _, plain = weather.scored_days(hour_rows(spark), places)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() >= 3 * 365
        spark.sql("DROP TABLE hours_by_station")  # another session: the files are still there
        assert outputs.bucketed(spark, "hours_by_station", str(tmp_path / "hours"), 4).count() == held.count()
    finally:
        spark.sql("DROP TABLE IF EXISTS hours_by_station")


def test_years_sort_nothing(spark):
    made = spark.sql("SELECT 's' AS station, 2020 AS file_year, date_add(date'2019-12-30', d) AS local_date, d % 9 < 4 AS bad, true AS valid FROM (SELECT explode(sequence(0, 370)) AS d)")
    runs = days.streaks(days.in_file_year(made).where("valid"), "bad")
    assert "Window" not in plan(runs) and "Sort" not in plan(runs)
    got = [(str(r["first_day"]), r["days"], r["weight"]) for r in runs.orderBy("first_day").collect()]
    flagged = [d for d in range(2, 368) if d % 9 < 4]
    want, at = [], 0
    while at < len(flagged):
        end = at
        while end + 1 < len(flagged) and flagged[end + 1] == flagged[end] + 1:
            end += 1
        if end - at + 1 >= 3:
            want.append((str(__import__("datetime").date(2019, 12, 30) + __import__("datetime").timedelta(flagged[at])), end - at + 1, (end - at + 3) // 3))
        at = end + 1
    assert got == want and len(got) == 40


@pytest.mark.parametrize(
    "good,bad,step,want",
    [([], [], 1, 0), ([9], [], 1, 1), ([9, 10, 12], [], 1, 2), ([9, 10, 12], [], 2, 3), ([9, 12, 15], [10], 3, 2), ([0, 23], [], 6, 1), ([0, 6, 12, 18], [], 6, 4), (range(24), [], 1, 24), ([5, 6, 7], [8], 1, 3)],
)
def test_longest_run(spark, good, bad, step, want):
    rows = [("s", 2021, 0, h, True, step) for h in good] + [("s", 2021, 0, h, False, step) for h in bad]
    frame = spark.createDataFrame(rows or [("s", 2021, 0, 3, False, step)], "station string, file_year int, local_date int, local_hour int, good boolean, step int")
    assert days.good_runs(frame).first()["best_run"] == want


def test_reporting_step(spark):
    rows = [("s", 2021, d, h) for d in range(3) for h in ((6, 9, 12, 13) if d < 2 else (6, 7))] + [("t", 2021, 0, 5), ("u", 2021, 1, 0), ("u", 2021, 1, 23), ("v", 2021, 0, 1), ("v", 2021, 0, 3), ("v", 2021, 0, 4)]
    frame = spark.createDataFrame(rows, "station string, file_year int, d int, local_hour int").selectExpr("*", "date_add(date'2021-05-01', d) AS local_date")
    assert {r["station"]: r["step"] for r in hours.reporting_step(frame).collect()} == {"s": 3, "t": 1, "u": 6, "v": 2}


def test_sinks(spark, tmp_path):
    nothing = spark.createDataFrame([], "id string, name string")
    outputs.write_stations(nothing, str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []
    outputs.write_stations(spark.createDataFrame([("b", None), ("a", "x"), ("c", 'q"')], "id string, name string").repartition(3), str(tmp_path / "some"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "some").glob("part-*"))) == [{"id": "a", "name": "x"}, {"id": "b", "name": None}, {"id": "c", "name": 'q"'}]
    write_archive(tmp_path / "isd", STATIONS[0], (2021, 2022))
    write_archive(tmp_path / "isd", STATIONS[1], (2022,))
    index = files.station_index(files.station_files(spark, str(tmp_path / "isd")))
    outputs.write_index(index, str(tmp_path / "index"))
    rows = [json.loads(x) for p in sorted((tmp_path / "index").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(r["station"], [f["file_year"] for f in r["files"]]) for r in rows] == [(STATIONS[0], [2021, 2022]), (STATIONS[1], [2022])]
    outputs.write_ids(index, str(tmp_path / "ids"))
    assert [json.loads(x)["station"] for p in sorted((tmp_path / "ids").glob("part-*")) for x in p.read_text().splitlines()] == list(STATIONS[:2])
    # a cache that cannot be read is as good as none
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_bytes(b"no parquet")
    assert outputs.read_versioned(spark, str(tmp_path / "cache"), 1) is None and outputs.read_versioned(spark, str(tmp_path / "missing"), 1) is None
    outputs.write_versioned(spark.range(3), str(tmp_path / "held"), 4)
    assert outputs.read_versioned(spark, str(tmp_path / "held"), 4).count() == 3 and outputs.read_versioned(spark, str(tmp_path / "held"), 5).count() == 0

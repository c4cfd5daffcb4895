"""python -m heliospan run | inspect | explain | grid: the steps of a whole run in order, and its tools."""

from __future__ import annotations

import argparse
import re
import sys
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.operators import compose, days, hours, spatial
from heliospan.plans import weather
from heliospan.sources import files, outputs, snapshots, tiff


def span(text: str) -> range:
    """2015-2019, or 2019."""
    first, _, last = text.partition("-")
    return range(int(first), int(last or first) + 1)


class Steps:
    """Runs steps one after the other, and keeps what each took and counted."""

    def __init__(self, say: Callable[[str], None] = print):
        self.say, self.took = say, []

    def __call__(self, name: str, step: Callable[[], tuple[Any, str]]) -> Any:
        self.say(f"=== {name} ===")
        began = time.time()
        out, told = step()  # a failure ends the run
        self.took.append((name, time.time() - began))
        self.say(f"  {told}")
        return out

    def table(self) -> str:
        rows = [*self.took, ("total", sum(t for _, t in self.took))]
        return "\n".join(f"  {name:<10} {t:8.1f} s" for name, t in rows)


def counted(df: DataFrame, *by: str) -> str:
    return ", ".join(f"{r['n']} {' '.join(map(str, r[:-1]))}" for r in compose.counters(df, *by).collect()) or "none"


def run(spark: SparkSession, root: str, manifest: str, out: str, countries: str | None = None, grid: str | None = None, max_stations: int | None = None, strict: bool = False, say: Callable[[str], None] = print) -> dict[str, int]:
    """Index, filter, parse, derive, publish. out gets index, ids, hours (cache), derived, stations, details; the result is
    how many of the ids that passed the filter are published, and why others are not.

    max_stations: a seeded sample of the archive's stations, whose results go to a derived folder of their own.
    """
    step = Steps(say)

    def index() -> tuple[DataFrame, str]:
        listed = outputs.stored(files.station_files(spark, root), "files")
        outputs.write_index(files.station_index(listed), f"{out}/index")
        return listed, f"{listed.select('station').distinct().count()} stations, {listed.count()} files"

    def keep() -> tuple[DataFrame, str]:
        ids = listed.select("station").distinct()
        ids = ids if max_stations is None else compose.sample(ids, "station", max_stations)
        rates = hours.cadence_of(compose.matched(files.estimated_lines(spark, root), ids, ["station"]))
        kept = outputs.stored(rates.where("accepted").select("station"), "ids")
        outputs.write_ids(kept, f"{out}/ids")
        return kept, f"{kept.count()} of {ids.count()} stations report often enough"

    def parse() -> tuple[None, str]:
        _, status = weather.cached_hours(spark, root, f"{out}/hours", strict, kept)
        return None, "nothing new" if status is None else f"files: {counted(status, 'status')}"

    folder = f"{out}/derived" if max_stations is None else f"{out}/derived-sample"

    def derive() -> tuple[weather.Climate, str]:
        found = weather.from_archive(spark, root, manifest, strict, cache=f"{out}/hours", derived=folder, only=kept)
        now = snapshots.current(spark, folder)
        return found, f"{now.notes['recomputed']} derived anew, {found.stations.count()} with a result, left out: {counted(now.tables['excluded'], 'reason')}"

    def publish() -> tuple[dict[str, int], str]:
        names = files.country_file(spark, countries) if countries else spark.createDataFrame([], "code string, country_name string")
        placed, outcomes = outputs.counted_outcomes(kept, found.stations, files.manifest_file(spark, manifest))
        placed = outputs.stored(placed, "placed")
        store = spark.read.parquet(grid) if grid else None
        outputs.write_stations(weather.publish(found, None, names, store, placed=placed), f"{out}/stations")
        shown = found._replace(stations=compose.matched(found.stations, placed.select(F.col("id").alias("station")), ["station"]))
        outputs.write_details(weather.details(shown), f"{out}/details")
        return outcomes.get, ", ".join(f"{n} {k}" for k, n in outcomes.get.items())

    with outputs.scratch(spark):
        listed = step("index", index)
        kept = step("filter", keep)
        step("parse", parse)
        found = step("derive", derive)
        told = step("publish", publish)
    say(f"All steps are done.\n{step.table()}")
    return told


def explain(spark: SparkSession, derived: str, manifest: str, reasons: Sequence[str] = ()) -> str:
    """Why stations are left out, as a table."""
    now = snapshots.current(spark, derived)
    if now is None:
        raise ValueError(f"no results in {derived}")
    names = files.manifest_file(spark, manifest).select(F.col("id").alias("station"), "name")
    return outputs.report(compose.explained(now.tables["years"], names, reasons), 1000)


def grid(spark: SparkSession, folder: str, out: str, years: Sequence[int], months: Sequence[int], factor: int = 2) -> int:
    """Makes the tile store of the vegetation climatology from a folder of monthly files; how many files there were."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    listed = [(r["path"], r["month"]) for r in files.ndvi_files(held, years, months).collect()]  # a few hundred names
    if not listed:
        raise ValueError("no file of these years and months")
    image = tiff.open_grid(listed[0][0])
    cells = spatial.coded(tiff.boxes(spark, listed, factor))
    spatial.tiles(cells, image.height // factor, image.width // factor).write.mode("overwrite").parquet(out)
    return len(listed)


def main(given: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="heliospan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    whole = commands.add_parser("run", help="all steps, in order")
    whole.add_argument("root")
    whole.add_argument("manifest")
    whole.add_argument("out")
    whole.add_argument("--countries")
    whole.add_argument("--grid", help="tile store of the vegetation climatology")
    whole.add_argument("--max-stations", type=int, help="a seeded sample of so many stations")
    whole.add_argument("--strict", action="store_true", help="withhold files with malformed lines")
    one = commands.add_parser("inspect", help="what each year of a station holds")
    one.add_argument("root")
    one.add_argument("manifest")
    one.add_argument("station")
    why = commands.add_parser("explain", help="why stations are left out")
    why.add_argument("derived")
    why.add_argument("manifest")
    why.add_argument("reasons", nargs="*")
    made = commands.add_parser("grid", help="vegetation climatology from monthly files")
    made.add_argument("folder")
    made.add_argument("out")
    made.add_argument("--years", type=span, default=span("2015-2019"), help="2015-2019, or 2019")
    made.add_argument("--months", type=span, default=span("1-12"))
    args = parser.parse_args(given)
    spark = SparkSession.builder.appName("heliospan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        run(spark, args.root, args.manifest, args.out, args.countries, args.grid, args.max_stations, args.strict)
    elif args.command == "inspect":
        if not re.fullmatch(r"\w{6}-\d{5}", args.station):
            sys.exit("a station is six characters, a dash and five digits")
        print(weather.inspect(spark, args.root, args.manifest, args.station))
    elif args.command == "explain":
        print(explain(spark, args.derived, args.manifest, args.reasons))
    else:
        print(f"{grid(spark, args.folder, args.out, args.years, args.months)} files")


if __name__ == "__main__":
    main()

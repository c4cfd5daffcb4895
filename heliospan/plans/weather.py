"""The whole climate plan: raw reports to published stations, as one lazy plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospan.functions import scalar
from heliospan.functions.rules import CRITERIA, RULES, Rules
from heliospan.operators import compose, days, hours, spatial
from heliospan.operators.hours import KEYS
from heliospan.sources import files, outputs, snapshots


class Climate(NamedTuple):
    """The tables of a run, each lazy."""

    hours: DataFrame
    effective: DataFrame
    days: DataFrame
    years: DataFrame
    months: DataFrame
    stations: DataFrame
    #: What became of each file that was read (``file_status``); None where hours were given.
    files: DataFrame | None = None


def summed_days(merged: DataFrame, places: DataFrame, rules: Rules = RULES, clustered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Effective hours and the sums of days. Partitioned once by station and year, which all later groups and joins contain.

    clustered: merged is so already (``outputs.bucketed``), and nothing at all is exchanged.
    """
    local = hours.localised(merged, hours.in_place(places) if clustered else places)
    effective = hours.effective_hours(local if clustered else local.repartition(*KEYS), rules=rules)
    return effective, days.day_rows(hours.scored(effective, rules), rules=rules)


def scored_days(merged: DataFrame, places: DataFrame, rules: Rules = RULES, clustered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Effective hours and day scores. The sums of days are written once; steps and scores are made from them."""
    effective, rows = summed_days(merged, places, rules, clustered)
    return effective, days.day_scores(outputs.stored(rows, "days"), rules=rules)


def climate(merged: DataFrame, places: DataFrame, rules: Rules = RULES, clustered: bool = False) -> Climate:
    """merged: hours; places: station, lat, lon. Years, months and stations read the written days, not the hours."""
    effective, by_day = scored_days(merged, places, rules, clustered)
    # its rows are few (one for each station and year), and three tables are made of them
    years = outputs.stored(days.year_stats(by_day, rules=rules), "years")
    months = days.monthly(by_day)
    return Climate(merged, effective, by_day, years, months, days.stations(days.year_scores(years, rules), months, rules=rules))


def publish(found: Climate, manifest: DataFrame | None, countries: DataFrame, ndvi: DataFrame | None = None, degrees: float = 0.1, rows: int = 1800, columns: int = 3600, rules: Rules = RULES, placed: DataFrame | None = None) -> DataFrame:
    """Stations with a manifest row, their country, vegetation (satellite, else rain) and composite score.

    ndvi: the vegetation raster, as a tile store (``files.raster_tiles``) or as cells.
    placed: the stations with their manifest columns if they are joined already (``outputs.counted_outcomes``, written, which
    counts them on the way).
    """
    placed = found.stations.withColumnRenamed("station", "id").join(manifest, "id") if placed is None else placed
    placed = placed.join(countries.withColumnRenamed("code", "country"), "country", "left").withColumn("country_name", F.coalesce("country_name", "country"))
    rain = scalar.vegetation_from_rain(F.col("avg_annual_precip_mm"), rules)
    if ndvi is None:
        placed = placed.withColumns({"avg_vegetation": rain, "avg_ndvi": F.lit(None).cast("double"), "vegetation_lush_months": F.lit(None).cast("int"), "vegetation_source": F.lit("rain")})
    else:
        temps = days.profile_arrays(days.monthly_profile(compose.matched(found.months, days.year_scores(found.years, rules), list(KEYS)))).select(F.col("station").alias("id"), F.col("temp").alias("__temp"))
        store = spatial.tiles(ndvi, rows, columns) if "m" in ndvi.columns else ndvi
        cells = spatial.nearest_ring(placed.select("id", "lat", "lon"), store, "id", degrees, rows, columns).select("id", F.col("ndvi").alias("__ndvi"))
        placed = placed.join(cells, "id", "left").join(temps, "id", "left")
        green = scalar.vegetation(F.col("__ndvi"), F.col("__temp"), rules)
        seen = F.col("__ndvi").isNotNull()
        placed = placed.withColumns(
            {
                "avg_vegetation": F.when(seen, green["vegetation"]).otherwise(rain),
                "avg_ndvi": F.when(seen, green["mean_ndvi"]),
                "vegetation_lush_months": F.when(seen, green["lush_months"]),
                "vegetation_source": F.when(seen, "ndvi").otherwise("rain"),
            }
        ).drop("__ndvi", "__temp")
    return compose.composite(compose.published(placed), rules).select(*compose.PUBLISHED)


def details(found: Climate, rules: Rules = RULES) -> DataFrame:
    """``days.details`` of the stations that have enough years."""
    counted = compose.matched(found.months, days.year_scores(found.years, rules), list(KEYS))
    return days.details(found.years, days.profile_arrays(days.monthly_profile(counted)), found.stations, rules)


def archive_hours(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """Merged hours of raw files, with ``lines``: how many lines of the file fell to each. Lines that are no reports are a row
    without date and hour, so that one pass over the files gives both the hours and the number of all lines.

    The same pass adds up what tells damaged files (``file_status``): ``stored``, the bytes read, and ``bad``, the malformed lines
    if strict. A file that ends too soon does not stop the others.
    """
    lines = files.report_lines(spark, paths, damaged=True).withColumn("bad", files.is_malformed() if strict else F.lit(False))
    rows = files.parse(lines, keep_dropped=True)
    return hours.merge_hours(rows, extra=[F.count("*").alias("lines"), F.sum("stored").alias("stored"), F.count_if("bad").alias("bad")])


#: What became of a file.
GOOD, DAMAGED, MALFORMED = "ok", "damaged", "malformed"


def file_status(held: DataFrame, ends: DataFrame) -> DataFrame:
    """station, file_year, lines, bad, status of every file. held: ``archive_hours``; ends: ``files.archive_ends``.

    A file is damaged if it cannot be opened, or if not all bytes came that its trailer names (or one more: the last line's end
    is counted even if it has none); malformed if lines were found to be.
    """
    read = held.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("lines", "stored", "bad")))
    both = ends.select(*KEYS, "whole", "error").join(read, list(KEYS), "left").fillna(0, ["lines", "stored", "bad"])
    missing = F.pmod(F.col("stored") - F.col("whole"), F.lit(1 << 32))
    status = F.when(F.col("error").isNotNull() | ~missing.isin(0, 1), DAMAGED).when(F.col("bad") > 0, MALFORMED).otherwise(GOOD)
    return both.select(*KEYS, "lines", "bad", status.alias("status"))


def sound(held: DataFrame, status: DataFrame) -> DataFrame:
    """The rows of the files that are as they should be; those of the others are withheld."""
    return compose.without(held, status.where(F.col("status") != GOOD), list(KEYS)).drop("stored", "bad")


def from_archive(spark: SparkSession, root: str, manifest_path: str, strict: bool = False, rules: Rules = RULES, cache: str | None = None, station: str | None = None, derived: str | None = None, only: DataFrame | None = None) -> Climate:
    """Files of stations whose cadence is enough, parsed and scored. station: that one alone; its files alone are read.

    cache: a folder of merged hours. Files that it holds in this version, with the same size and time, are not read again; the
    others are added. Without one, the hours are written once for this run.
    derived: a folder of results (``snapshots``). Stations whose files are as they were keep theirs; the others alone are derived, and
    all tables of the run become current together. Hours, effective hours and days are then those of the stations derived now.

    only: the stations (station) that the archive is taken to have, with derived results.

    Damaged files are withheld, and the others go on: ``Climate.files`` says what became of each file that was read. strict:
    files with malformed lines are withheld too, else what cannot be read in a line is null.
    """
    if derived is not None:
        if station is not None:
            raise ValueError("derived results are those of the whole archive")
        return _derived(spark, root, manifest_path, strict, rules, cache, derived, only)
    glob = f"{root}/*/{files.GLOB if station is None else f'{station}-[0-9][0-9][0-9][0-9].gz'}"
    if cache is None:
        held, status = read_hours(spark, root, glob, strict)
    else:
        held, status = cached_hours(spark, root, cache, strict)
        held = held if station is None else held.where(F.col("station") == station)
    return _accepted(spark, held, manifest_path, rules)[0]._replace(files=status)


def read_hours(spark: SparkSession, root: str, paths: str | list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The hours of the sound ones of some files of the archive, written once, and the status of these files."""
    held = outputs.stored(archive_hours(spark, paths, strict), "hours")
    if isinstance(paths, str):
        ends = files.archive_ends(spark, root, paths.rsplit("/", 1)[-1])
    else:
        ends = files.archive_ends(spark, root, names=[p.rsplit("/", 1)[-1] for p in paths])
    status = outputs.stored(file_status(held, ends), "status")  # a row for each file
    return sound(held, status), status


def _accepted(spark: SparkSession, held: DataFrame, manifest_path: str, rules: Rules) -> tuple[Climate, DataFrame]:
    """The climate of the stations whose cadence is enough, and the cadence of all. held: ``archive_hours``."""
    cadence = hours.cadence_of(held.groupBy(*KEYS).agg(F.sum("lines").alias("lines")), rules=rules)
    places = files.manifest_file(spark, manifest_path, drop_origin=False).select(F.col("id").alias("station"), "lat", "lon")
    used = held.where(F.col("utc_date").isNotNull() & F.col("utc_hour").isNotNull())
    return climate(compose.matched(used, cadence.where("accepted").select("station"), ["station"]).drop("lines"), places, rules=rules), cadence


#: Raised when a station's result would come out otherwise.
DERIVE_VERSION = 1
#: Fixed value: why stations whose cadence is not enough are left out.
FEW_REPORTS = "too few reports a day"


def _derived(spark: SparkSession, root: str, manifest_path: str, strict: bool, rules: Rules, cache: str | None, folder: str, only: DataFrame | None) -> Climate:
    listed = files.station_files(spark, root)
    listed = listed if only is None else compose.matched(listed, only, ["station"])
    signed = outputs.stored(outputs.signatures(listed), "signatures")  # a row for each station
    known = snapshots.current(spark, folder)
    old = known.tables if known else {}
    todo = outputs.stored(outputs.to_derive(signed, DERIVE_VERSION, old.get("stations"), old.get("excluded")), "to-derive")
    count, stations = todo.count(), signed.count()
    if known and not count:  # at most, stations are gone
        here = {n: compose.matched(old[n], signed, ["station"]) for n in old}
        if known.notes["listed"] != stations:
            here = snapshots.commit(spark, folder, here, {"listed": stations, "recomputed": 0}, known.number).tables
        nothing = spark.createDataFrame([], T.StructType())
        return Climate(nothing, nothing, nothing, *(here[n] for n in ("years", "months", "stations")))

    if cache is not None:
        held, status = cached_hours(spark, root, cache, strict, only)
        held = compose.matched(held, todo, ["station"])
    else:
        paths = [r["path"] for r in compose.matched(listed, todo, ["station"]).select("path").collect()]  # names only
        held, status = read_hours(spark, root, paths, strict)
        status = compose.matched(status, todo, ["station"])
    fresh, cadence = _accepted(spark, held, manifest_path, rules)
    few = cadence.where("not accepted").select("station", F.lit(FEW_REPORTS).alias("reason"))
    reasons = days.exclusions(fresh.years, rules=rules).union(few)
    silent = todo.select("station").join(fresh.years.select("station").union(few.select("station")).distinct(), "station", "left_anti")
    reasons = reasons.union(silent.select("station", F.lit(days.NO_DATA).alias("reason")))
    made, marked = outputs.outcomes(fresh.stations, reasons, todo, DERIVE_VERSION)
    tables = {"stations": made, "excluded": marked, "years": fresh.years, "months": fresh.months}
    # a station whose files are as they were keeps its rows; one that is gone, or was derived now, loses them
    same = signed.join(todo.select("station"), "station", "left_anti").select("station")
    tables = {n: df.unionByName(compose.matched(old[n], same, ["station"])) if known else df for n, df in tables.items()}
    now = snapshots.commit(spark, folder, tables, {"listed": stations, "recomputed": count}, known.number if known else 0).tables
    return Climate(held, fresh.effective, fresh.days, now["years"], now["months"], now["stations"], status)


#: Raised when the hours of a file would come out otherwise.
PARSE_VERSION = 1


def cached_hours(spark: SparkSession, root: str, cache: str, strict: bool = False, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The hours of all sound files of the archive from the cache, after what is new or changed was added to it, and the status of
    the files that were read for that (None if none was). only: the stations (station) to take.

    A station-year lies in one file of the cache, so a damaged file of the cache loses whole ones, which are read anew. Files that
    are withheld are not added, so they are tried again.
    """
    known = outputs.read_versioned(spark, cache, PARSE_VERSION)
    listed = files.station_files(spark, root)
    listed = listed if only is None else compose.matched(listed, only, ["station"])
    signed = [*KEYS, "size", "modified"]
    todo = outputs.stored(outputs.to_process(listed, known, signed), "to-read")  # a row for each file
    paths = [r["path"] for r in todo.select("path").collect()]  # names only
    status = None
    if paths:
        held, status = read_hours(spark, root, paths, strict)
        status = compose.matched(status, todo, list(KEYS))
        made = held.join(listed.select(*signed), list(KEYS))
        outputs.by_year(made.withColumn("version", F.lit(PARSE_VERSION))).write.mode("append").partitionBy("file_year").parquet(cache)
        known = outputs.read_versioned(spark, cache, PARSE_VERSION)
    return compose.matched(known, listed, signed).drop("size", "modified"), status


def inspect(spark: SparkSession, root: str, manifest_path: str, station: str, rules: Rules = RULES) -> str:
    """A text report of one station: what each year holds and why it counts or not, and the station's metrics."""
    found = from_archive(spark, root, manifest_path, rules=rules, station=station)
    share = lambda c: scalar.percent_text(F.col(c))
    rows = found.years.withColumn("valid", scalar.percent_text(F.col("valid_days") / F.col("days_in_year"))).orderBy("file_year")
    result = F.coalesce(F.concat(F.lit("EXCLUDED: "), "excluded_reason"), F.format_string("score=%.3f", F.col("score_sum") / F.col("valid_days")))
    table = rows.select(F.col("file_year").alias("year"), "obs", "step", *(share(f"coverage_{c}").alias(c) for c in CRITERIA), "valid", result.alias("result"))
    total = found.stations.drop("station")
    text = outputs.report(total) if not total.isEmpty() else f"needs {rules.min_years} usable years: would not be published"
    return f"{station}\n{outputs.report(table)}\n\n{text}"

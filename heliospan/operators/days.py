"""Hours to days, years and stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.functions import scalar
from heliospan.functions.rules import CRITERIA, RULES, Rules
from heliospan.operators.hours import KEYS, hour_mask, step_of_days


def longest_run(seen: Column, good: Column, step: Column) -> Column:
    """The longest run of good hours in a day's masks: a run goes on to the next record if that is good and at most a step later."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(-24).alias("last"))

    def follow(state: Column, hour: Column) -> Column:
        on = lambda mask: F.getbit(mask.cast("long"), hour) == 1
        run = F.when(on(good), F.when(hour - state["last"] <= step, state["run"]).otherwise(0) + 1).otherwise(0)
        return F.when(on(seen), F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"), hour.alias("last"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), start, follow, lambda state: state["best"]).cast("long")


def good_runs(hours: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest run of good hours of each day. hours: with good and step."""
    masks = hours.groupBy(*keys, "local_date").agg(hour_mask().alias("seen"), hour_mask(F.col("good")).alias("fine"), F.max("step").alias("step"))
    return masks.select(*keys, "local_date", longest_run(F.col("seen"), F.col("fine"), F.col("step")).alias("best_run"))


def _bad(rules: Rules) -> Column:
    return F.coalesce(F.col("max_temp") < rules.indoor_cold, F.lit(False)) | F.coalesce(F.col("max_temp") > rules.indoor_hot, F.lit(False)) | F.coalesce(F.col("max_dew") > rules.indoor_dew, F.lit(False)) | F.coalesce((F.col("max_cloud") > rules.indoor_cloud) & (F.col("sum_precip") > rules.indoor_precip), F.lit(False)) | F.coalesce(F.col("max_wind") > rules.indoor_wind, F.lit(False))


def day_rows(hours: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """The sums of each day: counts, extremes, masks of its hours, and its complete hours' scores by hour. hours: scored hours.

    All of them combine in any order and have a fixed width, so one hash aggregate makes them and nothing is sorted.
    """
    held = {h: F.max(F.when(F.col("complete") & (F.col("local_hour") == h), F.col("hour_score"))) for h in range(rules.day_start, rules.day_end)}
    out = hours.groupBy(*keys, "local_date").agg(
        hour_mask().alias("seen"),
        hour_mask(F.col("good")).alias("fine"),
        F.max(F.col("day_end") - F.col("day_start")).alias("day_len"),
        F.count("*").alias("obs"),
        F.count_if("complete").alias("complete"),
        *(F.count(c).alias(f"n_{c}") for c in CRITERIA),
        *(v.alias(f"score_{h}") for h, v in held.items()),
        F.max("temp_c").alias("max_temp"),
        F.max("dew_c").alias("max_dew"),
        F.max("cloud_pct").alias("max_cloud"),
        F.max("wind_mps").alias("max_wind"),
        F.sum("precip_mm").alias("sum_precip"),
        F.count_if(F.col("cloud_pct") > rules.gloom_cloud).alias("cloudy"),
        *(F.sum(c).alias(f"sum_{c}") for c in ("temp_c", "dew_c", "cloud_pct", "wind_mps")),
        F.count_if(F.col("precip_mm") > 0).alias("n_wet"),
    )
    best = F.sort_array(F.array_compact(F.array(*(F.col(f"score_{h}") for h in held))), False)
    return out.withColumn("best", best).drop(*(f"score_{h}" for h in held))


def day_scores(rows: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """One row for each day: counts, score of its best hours, indoor, gloomy, perfect and valid. rows: ``day_rows``, written,
    as they are read twice: for the file's reporting step, and with it."""
    out = rows.join(step_of_days(rows, keys), list(keys))
    top = F.ceil(F.lit(float(rules.top_hours)) / F.col("step")).cast("int")
    out = out.withColumn("best_run", longest_run(F.col("seen"), F.col("fine"), F.col("step")))
    need = F.when(F.col("step") == 1, rules.perfect_hours).otherwise(F.greatest(F.lit(2), F.ceil(F.lit(float(rules.perfect_hours)) / F.col("step")).cast("int")))
    score = F.when(F.col("complete") >= top, F.aggregate(F.slice("best", F.lit(1), top), F.lit(0.0), lambda a, v: a + v) / (top * 4))
    out = out.withColumn("day_score", score).withColumn("perfect", F.col("best_run") >= need).withColumn("indoor", _bad(rules)).withColumn("gloomy", F.col("cloudy") >= rules.gloom_records)
    enough = (F.col("day_len") > 0) & (F.col("complete") * F.col("step") >= F.col("day_len") * rules.min_fill)
    return out.withColumn("bad", F.col("indoor") | F.col("gloomy")).withColumn("valid", enough & F.col("day_score").isNotNull()).drop("best", "seen", "fine")


#: Days of a year in one number of a year's mask.
MASK_DAYS = 62


def day_mask(flag: Column, year: str) -> list[Column]:
    """The flagged days of a year as the bits of six numbers, which combine by OR in any order (see ``hour_mask``)."""
    day = F.date_diff("local_date", F.make_date(F.col(year), F.lit(1), F.lit(1)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(MASK_DAYS)))
    return [F.coalesce(F.bit_or(F.when(flag & (F.floor(day / MASK_DAYS) == i), bit)), F.lit(0)) for i in range(6)]


def runs_of(mask: Column) -> Column:
    """The runs of a year's mask (an array of numbers): an array of (begin, days), begin counted from January 1."""
    empty = F.array().cast("array<struct<begin:int,days:int>>")
    start = F.struct(F.lit(0).alias("run"), empty.alias("runs"))

    def follow(state: Column, day: Column) -> Column:
        on = F.getbit(F.get(mask, F.floor(day / MASK_DAYS).cast("int")), F.pmod(day, F.lit(MASK_DAYS))) == 1
        ended = F.struct((day - state["run"]).alias("begin"), state["run"].alias("days"))
        closed = F.when(state["run"] > 0, F.concat(state["runs"], F.array(ended))).otherwise(state["runs"])
        return F.when(on, F.struct((state["run"] + 1).alias("run"), state["runs"].alias("runs"))).otherwise(F.struct(F.lit(0).alias("run"), closed.alias("runs")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(366)), start, follow, lambda state: state["runs"])


def streaks(days: DataFrame, flag: str, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """Runs of consecutive flagged days of at least the least length: one row for each. days: valid days of their file's own year."""
    masks = days.groupBy(*keys).agg(F.array(*day_mask(F.col(flag), keys[1])).alias("mask"))
    runs = masks.select(*keys, F.inline(runs_of(F.col("mask")))).where(F.col("days") >= rules.streak_days)
    first = F.date_add(F.make_date(F.col(keys[1]), F.lit(1), F.lit(1)), F.col("begin"))
    return runs.select(*keys, first.alias("first_day"), F.col("days").cast("long").alias("days")).withColumn("weight", scalar.streak_weight(F.col("days"), rules))


def _streak_sums(mask: Column, name: str, rules: Rules) -> dict[str, Column]:
    """A year's sums over the streaks of a mask."""
    long = F.filter(runs_of(mask), lambda r: r["days"] >= rules.streak_days)
    total = lambda of: F.aggregate(F.col(f"{name}_runs"), F.lit(0).cast("long"), of)
    return {
        f"{name}_runs": F.transform(long, lambda r: r["days"].cast("long")),
        f"{name}_weighted": total(lambda a, n: a + scalar.streak_weight(n, rules)),
        f"{name}_longest": total(lambda a, n: F.greatest(a, n)),
        f"{name}_len_sum": total(lambda a, n: a + n),
        f"{name}_len_count": F.size(f"{name}_runs").cast("long"),
    }


def in_file_year(days: DataFrame) -> DataFrame:
    """Only local days of the file's own year."""
    return days.where(F.year("local_date") == F.col("file_year"))


def year_stats(days: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """One row for each station and year: coverage over all its days, sums over valid days, streaks."""
    own = in_file_year(days)
    valid = F.col("valid")
    flags = {"gloom": "bad", "pstreak": "perfect"}
    length = float(rules.day_end - rules.day_start)
    sums = own.groupBy(*keys).agg(
        F.max("step").alias("step"),
        F.sum("obs").alias("obs"),
        *(F.sum(f"n_{c}").alias(f"n_{c}") for c in CRITERIA),
        F.count_if(valid).alias("valid_days"),
        F.coalesce(F.sum(F.when(valid, F.col("day_score"))), F.lit(0.0)).alias("score_sum"),
        *(F.count_if(valid & F.col(c)).alias(f"{c}_count") for c in ("perfect", "indoor", "gloomy", "bad")),
        F.coalesce(F.sum(F.when(valid, F.col("complete"))), F.lit(0)).alias("samples"),
        F.coalesce(F.sum(F.when(valid, F.col("sum_precip") * 24.0 / F.col("day_len"))), F.lit(0.0)).alias("precip_mm"),
        *(F.array(*day_mask(valid & F.col(c), keys[1])).alias(f"{name}_mask") for name, c in flags.items()),
    )
    for name in flags:
        for made, value in _streak_sums(F.col(f"{name}_mask"), name, rules).items():
            sums = sums.withColumn(made, value)
        sums = sums.drop(f"{name}_mask", f"{name}_runs")
    sums = sums.withColumn("days_in_year", scalar.days_in_year(F.col(keys[1])))
    for c in CRITERIA:
        sums = sums.withColumn(f"coverage_{c}", F.col(f"n_{c}") / (F.col("days_in_year") * length / F.col("step"))).drop(f"n_{c}")
    cover = {c: F.col(f"coverage_{c}") for c in CRITERIA}
    return sums.withColumns(scalar.exclusion(cover, F.col("valid_days"), F.col("days_in_year"), rules))


SLOTS = ("days", "perfect", "indoor", "temp_sum", "temp_n", "dew_sum", "dew_n", "cloud_sum", "cloud_n", "wind_sum", "wind_n", "precip_n", "wet_n", "gloomy")


def monthly(days: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The monthly sums over valid days, one row for each month that has any."""
    counted = in_file_year(days).where("valid")
    pairs = (("temp", "temp_c"), ("dew", "dew_c"), ("cloud", "cloud_pct"), ("wind", "wind_mps"))
    return counted.groupBy(*keys, F.month("local_date").alias("month")).agg(
        F.count("*").alias("days"),
        F.count_if("perfect").alias("perfect"),
        F.count_if("indoor").alias("indoor"),
        *(x for short, c in pairs for x in (F.coalesce(F.sum(f"sum_{c}"), F.lit(0.0)).alias(f"{short}_sum"), F.sum(f"n_{c}").alias(f"{short}_n"))),
        F.sum("n_precip_mm").alias("precip_n"),
        F.sum("n_wet").alias("wet_n"),
        F.count_if("gloomy").alias("gloomy"),
    )


def year_scores(years: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Metrics of the years that count, tallies scaled to a full year."""
    scale = rules.target_days / F.col("valid_days")
    scaled = {"year_perfect_days": "perfect_count", "year_indoor_days": "indoor_count", "year_precip_mm": "precip_mm", "year_gloomy_days": "gloomy_count", "year_bad_days": "bad_count", "year_gloom_streaks": "gloom_weighted", "year_perfect_streaks": "pstreak_weighted"}
    kept = years.where(F.col("excluded_kind").isNull())
    return kept.withColumns({"year_score": F.col("score_sum") / F.col("valid_days"), "valid_day_fraction": F.col("valid_days") / F.col("days_in_year"), **{k: F.col(c) * scale for k, c in scaled.items()}})


def seasonal_concentration(months: DataFrame, station: str = "station", rules: Rules = RULES) -> DataFrame:
    """Spread of the monthly rates of perfect days: 0 even, 1 all in one month; null under the least number of months."""
    total = months.groupBy(station, "month").agg(F.sum("perfect").alias("perfect"), F.sum("days").alias("days"))
    rate = 100.0 * F.col("perfect") / F.col("days")
    out = total.groupBy(station).agg(F.count("*").alias("n"), F.avg(rate).alias("mean"), F.stddev_pop(rate).alias("spread"))
    value = F.least(F.lit(1.0), F.try_divide(F.col("spread"), F.col("mean")) / F.sqrt(F.greatest(F.col("n") - 1, F.lit(1))))
    return out.select(station, F.when(F.col("n") >= rules.seasonal_months, F.when(F.col("mean") == 0, 0.0).otherwise(value)).alias("concentration"))


def monthly_profile(months: DataFrame, station: str = "station") -> DataFrame:
    """Means and rates of each month over the counted years."""
    total = months.groupBy(station, "month").agg(*(F.sum(c).alias(c) for c in SLOTS))
    out = {name: F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n")) for name in ("temp", "dew", "cloud", "wind")}
    out["rain"] = F.try_divide(100.0 * F.col("wet_n"), F.col("precip_n"))
    out |= {name: F.try_divide(100.0 * F.col(c), F.col("days")) for name, c in (("perfect_rate", "perfect"), ("indoor_rate", "indoor"), ("gloom_rate", "gloomy"))}
    return total.select(station, "month", *(v.alias(k) for k, v in out.items()))


def profile_arrays(profile: DataFrame, station: str = "station") -> DataFrame:
    """Twelve values for each measure, January first, null where a month has none; rounded as published."""
    digits = {"temp": 2, "dew": 2, "cloud": 2, "wind": 2, "rain": 1, "perfect_rate": 1, "indoor_rate": 1, "gloom_rate": 1}
    held = profile.groupBy(station).agg(*(F.map_from_entries(F.collect_list(F.struct("month", F.struct(scalar.rounded(F.col(c), d).alias("v"))))).alias(c) for c, d in digits.items()))
    twelve = F.sequence(F.lit(1), F.lit(12))

    def by_month(c: str) -> Column:
        return F.transform(twelve, lambda m: F.try_element_at(F.col(c), m)["v"]).alias(c)

    return held.select(station, *map(by_month, digits))


def first_mode(value: str, order: str, keys: Sequence[str], df: DataFrame) -> DataFrame:
    """The most common value of each key, of equal ones that seen first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value))


def stations(years: DataFrame, months: DataFrame, station: str = "station", rules: Rules = RULES) -> DataFrame:
    """Means over the counted years of stations that have enough. years: ``year_scores``; months: ``monthly`` of all years."""
    counted = months.join(years.select(station, "file_year"), [station, "file_year"], "left_semi")
    out = years.groupBy(station).agg(
        F.avg("year_score").alias("avg_score"),
        *(F.avg(f"year_{c}").alias(f"avg_{n}") for c, n in (("perfect_days", "perfect_days"), ("indoor_days", "indoor_days"), ("precip_mm", "annual_precip_mm"), ("gloomy_days", "gloomy_days"), ("bad_days", "bad_days"), ("gloom_streaks", "gloom_streaks"), ("perfect_streaks", "perfect_streaks"))),
        F.max("gloom_longest").alias("gloom_longest_run"),
        F.try_divide(F.sum("gloom_len_sum").cast("double"), F.sum("gloom_len_count")).alias("gloom_avg_length"),
        F.max("pstreak_longest").alias("perfect_streak_longest_run"),
        F.try_divide(F.sum("pstreak_len_sum").cast("double"), F.sum("pstreak_len_count")).alias("perfect_streak_avg_length"),
        F.count("*").alias("years_included"),
        F.avg("valid_day_fraction").alias("coverage"),
        F.sum("samples").alias("samples"),
    )
    out = out.where(F.col("years_included") >= rules.min_years)
    out = out.join(first_mode("step", "file_year", [station], years), station).join(seasonal_concentration(counted, station, rules), station, "left")
    out = out.withColumn("seasonal_concentration", F.when(F.col("avg_perfect_days") >= rules.seasonal_days, F.col("concentration"))).drop("concentration")
    return out.withColumn("perfect_indoor_ratio", scalar.perfect_indoor_ratio(F.col("avg_perfect_days"), F.col("avg_indoor_days")))


#: Why stations are left out.
TOO_FEW_DAYS, NO_DATA = "too few valid days", "no data"


def passed_years(years: DataFrame, station: str = "station") -> DataFrame:
    """station, passed: how many of its years count."""
    return years.groupBy(station).agg(F.count_if(F.col("excluded_kind").isNull()).alias("passed"))


def exclusions(years: DataFrame, station: str = "station", rules: Rules = RULES) -> DataFrame:
    """Why stations without enough counted years are left out: that years are few, or else the most common reason of a year
    (a criterion's name, or too few valid days), of equal ones the first."""
    named = years.where(F.col("excluded_kind").isNotNull()).withColumn("reason", F.coalesce("excluded_criterion", F.lit(TOO_FEW_DAYS)))
    out = passed_years(years, station).where(F.col("passed") < rules.min_years).join(first_mode("reason", "file_year", [station], named), station, "left")
    few = F.lit(f"fewer than {rules.min_years} valid years")
    return out.select(station, F.when(F.col("passed") > 0, few).otherwise(F.coalesce("reason", F.lit(NO_DATA))).alias("reason"))


def year_details(years: DataFrame, rules: Rules = RULES) -> DataFrame:
    """What is shown of each year, rounded: its data, and either why it is left out (``excluded``) or its results."""
    rounded = scalar.rounded
    share = F.col("valid_days") / F.col("days_in_year")
    scale = rules.target_days / F.col("valid_days")
    counts = F.col("excluded_kind").isNull()
    results = {"score": (F.col("score_sum") / F.col("valid_days"), 3), "perfect": (F.col("perfect_count") * scale, 1), "indoor": (F.col("indoor_count") * scale, 1), "gloom": (F.col("gloom_weighted") * scale, 1), "pstreak": (F.col("pstreak_weighted") * scale, 1)}
    why = F.struct(F.col("excluded_kind").alias("kind"), F.col("excluded_criterion").alias("criterion"), rounded(F.col("excluded_value"), 3).alias("value"))
    return years.select(
        "station",
        F.col("file_year").alias("year"),
        "obs",
        "step",
        F.struct(*(rounded(F.col(f"coverage_{c}"), 3).alias(c) for c in CRITERIA)).alias("coverage"),
        rounded(share, 3).alias("valid_days"),
        F.when(~counts, why).alias("excluded"),
        *(F.when(counts, rounded(v, d)).alias(n) for n, (v, d) in results.items()),
    )


def details(years: DataFrame, profiles: DataFrame, stations: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row for each published station: id, its years in order, monthly arrays, streaks. profiles: ``profile_arrays``."""
    rows = year_details(years, rules)
    by_station = rows.groupBy("station").agg(F.sort_array(F.collect_list(F.struct(*rows.columns[1:]))).alias("years"))
    names = {"temp": "temp", "dew": "dew", "cloud": "cloud", "wind": "wind", "rain": "rain", "perfect_rate": "perfect", "indoor_rate": "indoor", "gloom_rate": "gloom"}
    monthly_ = profiles.select("station", F.struct(*(F.col(c).alias(n) for c, n in names.items())).alias("monthly"))
    shown = stations.select("station", "gloom_longest_run", scalar.rounded(F.col("gloom_avg_length"), 1).alias("gloom_avg_length"), "perfect_streak_longest_run", scalar.rounded(F.col("perfect_streak_avg_length"), 1).alias("perfect_streak_avg_length"))
    out = shown.join(by_station, "station").join(monthly_, "station", "left").withColumn("min_data_fraction", scalar.rounded(F.lit(rules.min_fraction), 4))
    return out.select(F.col("station").alias("id"), "min_data_fraction", "years", "monthly", *shown.columns[1:])

"""Reports to hours: merging, local solar time, daylight, and what missing precipitation means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliospan.functions import scalar
from heliospan.functions.rules import CRITERIA, RULES, Rules

KEYS = ("station", "file_year")


#: Added to the line number of a routine report, so that it goes before every special one.
ROUTINE = 1 << 62


def merge_hours(reports: DataFrame, line: str = "line_no", keys: Sequence[str] = KEYS, extra: Sequence[Column] = ()) -> DataFrame:
    """One row for each hour: first known value by priority (routine before special, later lines first), the greatest
    rain, and wet if any report is wet. line: a whole number under 2^62. One aggregation by hash with map-side combining:
    priorities are one number and all values have a fixed width, so nothing is sorted."""
    rank = F.when(F.col("special"), F.col(line)).otherwise(F.col(line) + F.lit(ROUTINE))

    def first_known(column: str, known: str | None = None) -> Column:
        return F.max_by(F.col(column), F.when(F.col(known or column).isNotNull(), rank)).alias(column)

    return reports.groupBy(*keys, "utc_date", "utc_hour").agg(
        *(first_known(c) for c in ("temp_c", "dew_c", "wind_mps", "cloud_pct")),
        F.max("precip_mm").alias("precip_mm"),
        F.bool_or("wx_wet").alias("wx_wet"),
        first_known("acc_period"),
        first_known("acc_depth", "acc_period"),
        *extra,
    )


#: Most stations that are broadcast, a few dozen bytes each; there are some 30,000.
FEW_STATIONS = 1_000_000


def in_place(stations: DataFrame) -> DataFrame:
    """stations, to be broadcast if they are few: counted, as hours that are clustered would else be exchanged for them."""
    return F.broadcast(stations) if stations.limit(FEW_STATIONS + 1).count() <= FEW_STATIONS else stations


def localised(hours: DataFrame, stations: DataFrame, station: str = "station") -> DataFrame:
    """Adds lat, abs_hour, local_date and local_hour; unknown stations keep UTC and the civil window."""
    place = stations.select(station, F.col("lat").cast("double").alias("lat"), scalar.utc_offset(F.col("lon").cast("double")).alias("utc_offset"))
    joined = hours.join(place, station, "left").withColumn("utc_offset", F.coalesce("utc_offset", F.lit(0)))
    at = scalar.abs_hour(F.col("utc_date"), F.col("utc_hour"), F.col("utc_offset"))
    return joined.withColumn("abs_hour", at).withColumn("local_date", scalar.local_day(F.col("abs_hour"))).withColumn("local_hour", scalar.local_hour(F.col("abs_hour")))


def with_daylight(hours: DataFrame, rules: Rules = RULES) -> DataFrame:
    start, end = scalar.daylight(F.col("__half"), rules)
    halved = hours.withColumn("__half", scalar.half_day(F.col("lat"), F.dayofyear("local_date"), rules))
    return halved.withColumns({"day_start": start, "day_end": end}).drop("__half")


def evidence(hours: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hours of a file that show its gauge or observer reports precipitation."""
    return hours.groupBy(*keys).agg(F.count_if(_shows()).alias("evidence"))


def _shows() -> Column:
    return F.col("precip_mm").isNotNull() | F.coalesce(F.col("wx_wet"), F.lit(False)) | F.col("acc_period").isNotNull()


def _covers(rules: Rules) -> tuple[Column, Column, Column]:
    """Whether an hour's accumulation is spread, the hours that it covers, and the rain of each."""
    used = F.col("acc_period").isNotNull() & ((F.col("acc_period") <= 6) | (F.col("acc_depth") == 0))
    fill = F.when(F.col("acc_depth") == 0, 0.0).otherwise(F.greatest(F.col("acc_depth") / F.col("acc_period"), F.lit(rules.wet_mm)))
    return used, F.sequence(F.col("abs_hour") - F.col("acc_period") + 1, F.col("abs_hour")), fill


def accumulation_slots(hours: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """For each hour that an accumulation covers, the rain by the earliest-ending one. An interval join as an equi-join:
    a period has at most 24 hours, so its slots are listed. Hours are merged, so one accumulation ends in each, and the
    earliest is found by a number: the aggregate hashes and sorts nothing."""
    used, covered, fill = _covers(rules)
    slots = hours.where(used).select(*keys, F.col("abs_hour").alias("end_hour"), fill.alias("fill"), F.explode(covered).alias("abs_hour"))
    return slots.groupBy(*keys, "abs_hour").agg(F.min_by("fill", "end_hour").alias("fill"))


def daytime(hours: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The hours within their day's daylight window."""
    return with_daylight(hours, rules).where(_in_daylight())


def _in_daylight() -> Column:
    return (F.col("local_hour") >= F.col("day_start")) & (F.col("local_hour") < F.col("day_end"))


def effective_hours(hours: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """Daytime hours with precipitation resolved: measured, wet, dry by evidence, accumulated, else unknown.

    Each hour goes to itself and to those that its accumulation covers, and one hash aggregate by hour brings both together.
    Where hours are clustered by keys (a repartition or a bucketed table), that and the join with the evidence (a row for each
    file, hashed) are made in place: no hours are exchanged or sorted.
    """
    lit_up = with_daylight(hours, rules)
    used, covered, fill = _covers(rules)
    one = lambda hour, own: F.struct(hour.alias("to"), F.lit(own).alias("own"))
    none = F.array().cast("array<struct<to:bigint,own:boolean>>")
    itself = F.when(_in_daylight(), F.array(one(F.col("abs_hour"), True))).otherwise(none)
    spread = F.when(used, F.transform(covered, lambda h: one(h, False))).otherwise(none)
    values = ("lat", "temp_c", "dew_c", "precip_mm", "cloud_pct", "wind_mps", "wx_wet", "day_start", "day_end")
    given = lit_up.select(*keys, "abs_hour", *values, fill.alias("fill"), F.inline(F.concat(itself, spread)))
    met = given.groupBy(*keys, "to").agg(F.bool_or("own").alias("own"), *(F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in values), F.min_by("fill", F.when(~F.col("own"), F.col("abs_hour"))).alias("fill"))
    met = met.where("own").withColumnRenamed("to", "abs_hour").withColumn("local_date", scalar.local_day(F.col("abs_hour"))).withColumn("local_hour", scalar.local_hour(F.col("abs_hour")))
    shown = evidence(hours, keys).where(F.col("evidence") >= rules.evidence_hours).select(*keys, F.lit(True).alias("reports_rain"))
    met = met.join(shown.hint("shuffle_hash"), list(keys), "left")
    stated = F.coalesce(F.col("precip_mm"), F.when(F.col("wx_wet"), rules.wet_mm), F.when(~F.col("wx_wet") & F.col("reports_rain"), 0.0))
    return met.withColumn("precip_mm", F.coalesce(stated, "fill")).select(*keys, "lat", "local_date", "local_hour", "abs_hour", "day_start", "day_end", *CRITERIA)


def scored(hours: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Adds the factor scores, their sum, and whether the hour is complete and good."""
    names = factor_names()
    out = hours.withColumns(scalar.factor_scores(*(F.col(c) for c in ("temp_c", "dew_c", "precip_mm", "cloud_pct")), rules))
    total = F.col(names[0])
    known, good = F.col(names[0]).isNotNull(), F.col(names[0]) > 0
    for n in names[1:]:
        total, known, good = total + F.col(n), known & F.col(n).isNotNull(), good & (F.col(n) > 0)
    return out.withColumn("hour_score", total).withColumn("complete", known).withColumn("good", F.coalesce(good, F.lit(False)))


def factor_names() -> tuple[str, ...]:
    return ("temp_score", "dew_score", "precip_score", "cloud_score")


def hour_mask(flag: Column | None = None) -> Column:
    """The local hours of a group of rows (those with the flag) as the bits of a number: masks of parts combine by OR, in any
    order, so they are made by map-side aggregates and nothing is sorted."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("local_hour").cast("int"))
    return F.coalesce(F.bit_or(bit if flag is None else F.when(flag, bit)), F.lit(0))


def gaps(mask: Column) -> Column:
    """The distances between neighbouring hours of a mask: an array of (gap, n, first), first being the hour after the first such gap."""
    found, between = [], F.lit(0)
    for gap in range(1, 24):
        ends = mask.bitwiseAND(F.shiftleft(mask, gap)).bitwiseAND(F.bitwise_not(between))
        first = F.bit_count(ends.bitwiseAND(-ends) - 1)
        found.append(F.when(ends != 0, F.struct(F.lit(gap).alias("gap"), F.bit_count(ends).alias("n"), first.alias("first"))))
        between = between.bitwiseOR(F.shiftleft(mask, gap))
    return F.array_compact(F.array(*found))


def reporting_step(hours: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The most common gap between a day's hours, of equal ones that seen first, within 1 to 6; 1 where there is none."""
    return step_of_days(hours.groupBy(*keys, "local_date").agg(hour_mask().alias("seen")), keys)


def step_of_days(by_day: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``reporting_step`` from the days' masks of hours (``seen``)."""
    each = by_day.select(*keys, "local_date", F.col("seen").cast("int").alias("seen")).select(*keys, "local_date", F.inline_outer(gaps(F.col("seen"))))
    counted = each.groupBy(*keys, "gap").agg(F.sum("n").alias("n"), F.min(F.unix_date("local_date").cast("long") * 24 + F.col("first")).alias("first"))
    best = counted.groupBy(*keys).agg(F.max_by("gap", F.when(F.col("gap").isNotNull(), F.shiftleft(F.col("n"), 32) - F.col("first"))).alias("gap"))
    within = F.when(F.col("gap").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(6), F.col("gap")))).otherwise(1)  # greatest and least skip nulls
    return best.select(*keys, within.cast("int").alias("step"))


def masked(hours: DataFrame, share: float = 1.0, opens: int = 0, closes: int = 24, keys: Sequence[str] = KEYS, seed: int = 0) -> DataFrame:
    """hours with gaps, to see what they change: only local hours from opens to before closes, and of those a share.

    An hour is kept by a hash of its keys, time and seed, so the same ones stay whatever the partitions.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in (*keys, "abs_hour")), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return hours.where(F.col("local_hour").between(opens, closes - 1) & (draw < share))


def cadence(lines: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """Raw lines (all of them, also short ones and summaries) for each calendar day of the years that have a file, by station, and whether that reaches the bound."""
    return cadence_of(lines.groupBy(*keys).agg(F.count("*").alias("lines")), keys, rules)


def cadence_of(by_year: DataFrame, keys: Sequence[str] = KEYS, rules: Rules = RULES) -> DataFrame:
    """The same from the number of lines (or an estimate of it) of each station and year."""
    out = by_year.groupBy(keys[0]).agg(F.sum("lines").alias("lines"), F.sum(scalar.days_in_year(F.col(keys[1]))).cast("long").alias("days"))
    rate = F.coalesce(F.try_divide(F.col("lines").cast("double"), F.col("days")), F.lit(0.0))
    return out.withColumn("obs_per_day", rate).withColumn("accepted", F.col("obs_per_day") >= rules.min_obs_per_day)

"""Cross-station metrics, published columns, explanations and the queries of the map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan.functions import scalar
from heliospan.functions.rules import CRITERIA, RULES, Rules


def with_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the least and greatest known value of each column: a one-row aggregate, broadcast because it is one row."""
    bounds = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    return df.crossJoin(F.broadcast(bounds))


def normalised(column: str) -> Column:
    """Min-max over the whole table, 0.5 where all are equal. Needs ``with_bounds``."""
    least, most = F.col(f"__min_{column}"), F.col(f"__max_{column}")
    return F.when(least == most, 0.5).otherwise((F.col(column) - least) / (most - least))


def composite(stations: DataFrame, rules: Rules = RULES) -> DataFrame:
    """avg_score: outside days + part of the vegetation - bad days, normalised before and after."""
    columns = ("avg_perfect_days", "avg_bad_days")
    raw = with_bounds(stations, columns)
    raw = raw.withColumn("__raw", normalised(columns[0]) + rules.vegetation_weight * F.col("avg_vegetation") - normalised(columns[1]))
    out = with_bounds(raw, ["__raw"]).withColumn("avg_score", scalar.rounded(normalised("__raw"), 4))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


#: Digits of the published columns.
DIGITS = {
    "elevation": 0, "avg_annual_precip_mm": 0, "avg_ndvi": 3, "avg_vegetation": 3, "avg_perfect_days": 2, "avg_gloomy_days": 2, "avg_bad_days": 2, "avg_indoor_days": 2, "avg_net_days": 2,
    "avg_perfect_minus_gloom": 2, "avg_gloom_streaks": 2, "avg_perfect_streaks": 2, "perfect_indoor_ratio": 3, "seasonal_concentration": 3, "coverage": 3,
}
#: The columns of a published station, in their order.
PUBLISHED = (
    "id", "name", "country", "country_name", "lat", "lon", "elevation", "avg_annual_precip_mm", "avg_ndvi", "avg_vegetation", "vegetation_lush_months", "vegetation_source", "avg_perfect_days", "avg_gloomy_days",
    "avg_bad_days", "avg_indoor_days", "avg_net_days", "avg_perfect_minus_gloom", "avg_gloom_streaks", "avg_perfect_streaks", "perfect_indoor_ratio", "seasonal_concentration", "years_included", "coverage", "step", "samples", "avg_score",
)


def published(stations: DataFrame, digits: Mapping[str, int] = DIGITS) -> DataFrame:
    """Adds the net counts and rounds the columns as published; those of no digits become whole numbers."""
    net = {"avg_net_days": F.col("avg_perfect_days") - F.col("avg_indoor_days"), "avg_perfect_minus_gloom": F.col("avg_perfect_days") - F.col("avg_gloom_streaks")}
    out = stations.withColumns(net)
    rounded = {c: scalar.rounded(F.col(c).cast("double"), d) for c, d in digits.items() if c in out.columns}
    return out.withColumns({c: v if digits[c] else v.cast("long") for c, v in rounded.items()})


def backfilled(stations: DataFrame) -> DataFrame:
    """Older station files: missing columns get their defaults, missing values follow from the others."""
    have = set(stations.columns)
    old = stations
    for c in ("avg_gloom_streaks", "avg_perfect_streaks", "avg_net_days", "avg_perfect_minus_gloom", "perfect_indoor_ratio", "seasonal_concentration"):
        if c not in have:
            old = old.withColumn(c, F.lit(None).cast("double"))
    old = old.fillna(0.0, ["avg_gloom_streaks", "avg_perfect_streaks"])
    return old.withColumns(
        {
            "avg_net_days": F.coalesce("avg_net_days", F.col("avg_perfect_days") - F.col("avg_indoor_days")),
            "avg_perfect_minus_gloom": F.coalesce("avg_perfect_minus_gloom", F.col("avg_perfect_days") - F.col("avg_gloom_streaks")),
            "perfect_indoor_ratio": F.coalesce("perfect_indoor_ratio", scalar.perfect_indoor_ratio(F.col("avg_perfect_days"), F.col("avg_indoor_days"))),
        }
    )


def metric_stats(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, least, most, n over known values; equal bounds are moved apart. One pass for all metrics."""
    sums = df.agg(*(f(F.col(m).cast("double")).alias(f"{n}_{m}") for m in metrics for n, f in (("a", F.min), ("b", F.max), ("n", F.count))))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b"), F.col(f"n_{m}").alias("n")) for m in metrics))
    least, most = scalar.widened(F.col("r.a"), F.col("r.b"))
    return sums.select(F.explode(rows).alias("r")).select("r.metric", least.alias("least"), most.alias("most"), "r.n")


def in_range(value: Column, low: float, high: float) -> Column:
    """Unknown values always pass."""
    return value.isNull() | value.between(low, high)


def snapped(low: Column, high: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """Slider values: low at most high, ends within a millionth of the span snap to the bounds."""
    eps = (most - least) * 1e-6
    a, b = F.least(low, high), F.greatest(low, high)
    return F.when(a <= least + eps, least).otherwise(a), F.when(b >= most - eps, most).otherwise(b)


def sample(ids: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n keys by a seeded hash order, sorted: the same ones whatever the partitions."""
    return ids.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n).orderBy(key)


def without(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left whose key is not in right: what is left to do, to publish or to remove."""
    return left.join(right.select(*on), list(on), "left_anti")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left whose key is in right, each once: what is derived, or what is published."""
    return left.join(right.select(*on), list(on), "left_semi")


def merged_years(*parts: DataFrame) -> DataFrame:
    """The rows of all parts by column names, equal ones once: the years of a station from several runs."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def counters(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def explained(years: DataFrame, stations: DataFrame, reasons: Sequence[str] = (), station: str = "station", rules: Rules = RULES) -> DataFrame:
    """For each station left out: its name, main reason, last step, years, and the mean coverage of each criterion in percent.

    The reason is "few years" where one or more count but not enough, else the most common one of a year: a criterion's name,
    or "valid days". reasons: only stations of these, all where none is given. In the order of reason and station; unknown
    names are "?".
    """
    from heliospan.operators.days import first_mode, passed_years

    named = years.where(F.col("excluded_kind").isNotNull()).withColumn("reason", F.coalesce("excluded_criterion", F.lit("valid days")))
    means = (scalar.rounded(F.avg(f"coverage_{c}") * 100, 0).cast("int").alias(f"mean_{c}") for c in CRITERIA)
    out = years.groupBy(station).agg(F.count("*").alias("years"), F.max_by("step", "file_year").alias("last_step"), *means)
    out = out.join(passed_years(years, station).where(F.col("passed") < rules.min_years), station).join(first_mode("reason", "file_year", [station], named), station, "left")
    out = out.withColumn("reason", F.when(F.col("passed") > 0, "few years").otherwise(F.coalesce("reason", F.lit("ok")))).drop("passed")
    if reasons:
        out = out.where(F.col("reason").isin(*reasons))
    out = out.join(stations, station, "left").fillna("?", [c for c, t in stations.dtypes if t == "string" and c != station])
    return out.orderBy("reason", station)


def notes(years: DataFrame, station: str = "station") -> DataFrame:
    """Numbers behind the trust notes of a station's details: counted years, usual step (of equal ones the last seen), weak criteria, mean valid days."""
    used = years.where(F.col("excluded_kind").isNull())
    steps = used.groupBy(station, "step").agg(F.count("*").alias("n"), F.max("file_year").alias("last"))
    usual = steps.groupBy(station).agg(F.max_by("step", F.struct("n", "last")).alias("usual_step"))
    means = used.groupBy(station).agg(F.count("*").alias("counted"), *(F.avg(f"coverage_{c}").alias(c) for c in CRITERIA), F.avg(F.col("valid_days") / F.col("days_in_year")).alias("mean_valid"))
    weak = F.concat_ws(",", *(F.when(F.col(c) < 0.6, c) for c in CRITERIA))
    total = years.groupBy(station).agg(F.count("*").alias("all_years"))
    out = means.join(usual, station).join(total, station)
    return out.select(station, "counted", "all_years", "usual_step", weak.alias("weak"), (F.col("counted") <= 2).alias("rough"), F.when(F.col("mean_valid") < 0.95, scalar.percent_text(F.col("mean_valid"))).alias("usable"))

"""The named queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.functions import scalar
from heliospan.functions.rules import CRITERIA
from heliospan.operators import compose, days, hours
from heliospan.operators.hours import KEYS
from heliospan.plans import display, geography, raw
from heliospan.plans.synthetic import CHAIN, PATCHY_CHAIN, patchy, places, reports
from heliospan.plans.weather import Climate, climate, scored_days

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _climate(spark: SparkSession, sf_dir: str) -> Climate:
    return climate(_merged(spark, sf_dir), places(spark, sf_dir))


def _patchy(spark: SparkSession, sf_dir: str) -> Climate:
    """The same with gaps, so that years and stations are left out for every reason."""
    return climate(hours.merge_hours(patchy(reports(spark, sf_dir))), places(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours.merge_hours(reports(spark, sf_dir))


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours.localised(_merged(spark, sf_dir), places(spark, sf_dir))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours.effective_hours(_local(spark, sf_dir).repartition(*KEYS))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_days(_merged(spark, sf_dir), places(spark, sf_dir))[1]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every station-day, valid or not: the part of the plan that any amount of data fills."""
    return _days(spark, sf_dir).select(*KEYS, "local_date", "step", "complete", F.round("day_score", 6).alias("day_score"), "indoor", "gloomy", "perfect", "valid")


def _add(name: str, columns: dict[str, str] | str, source: str, query: Query, where: str = "", chain: str = CHAIN) -> None:
    """columns: output -> 'plain' or the digits to which both sides round it; source: a table of the SQL chain."""
    shown = dict.fromkeys(columns.replace(",", " ").split(), "") if isinstance(columns, str) else columns

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*(F.round(F.col(c), int(d)).alias(c) if d else F.col(c) for c, d in shown.items()))

    QUERIES[name] = run
    ORACLES[name] = f"{chain} SELECT {', '.join(f'round({c}, {d}) AS {c}' if d else c for c, d in shown.items())} FROM {source}{f' WHERE {where}' if where else ''}"


def _plain(text: str, **digits: str) -> dict[str, str]:
    return dict.fromkeys(text.replace(",", " ").split(), "") | digits


_HOUR = "station file_year utc_date utc_hour temp_c dew_c wind_mps cloud_pct precip_mm wx_wet acc_period acc_depth"
_add("merge_hour", _HOUR, "hours", _merged)
_add("local_solar_shift", "station file_year utc_date utc_hour lat utc_offset abs_hour local_date local_hour", "localised", _local)
_add("daylight_window", "station file_year abs_hour day_start day_end", "lit", lambda s, d: hours.with_daylight(_local(s, d)))
_add("precip_evidence", "station file_year evidence", "evidence", lambda s, d: hours.evidence(_merged(s, d)))
_add("accumulation_fill", "station file_year abs_hour fill", "slots", lambda s, d: hours.accumulation_slots(_local(s, d)))
_add("effective_hours", "station file_year local_date local_hour temp_c dew_c precip_mm cloud_pct wind_mps", "effective", _effective)
_add("factor_scores", _plain("station file_year abs_hour", temp_score="9", dew_score="9", precip_score="9", cloud_score="9"), "factors", lambda s, d: hours.scored(_effective(s, d)))
_add("hour_flags", "station file_year abs_hour complete good", "scored", lambda s, d: hours.scored(_effective(s, d)))
_add("reporting_step", "station file_year step", "steps", lambda s, d: hours.reporting_step(hours.daytime(_local(s, d))))
_add("daily_score_topk", _plain("station file_year local_date complete", day_score="8"), "days", _days)
_add("perfect_day_runs", "station file_year local_date best_run perfect", "days", _days)
_add("indoor_day", _plain("station file_year local_date max_temp max_dew max_cloud max_wind indoor", sum_precip="6"), "days", _days)
_add("gloomy_day", "station file_year local_date cloudy gloomy bad", "days", _days)
_add("valid_day", "station file_year local_date day_len obs complete valid", "days", _days)
_add("file_year_days", "station file_year local_date obs", "own", lambda s, d: days.in_file_year(_days(s, d)))
_add("indoor_streaks", "station file_year first_day days weight", "gloom_runs", lambda s, d: days.streaks(days.in_file_year(_days(s, d)).where("valid"), "bad"))
_add("perfect_streaks", "station file_year first_day days weight", "pstreak_runs", lambda s, d: days.streaks(days.in_file_year(_days(s, d)).where("valid"), "perfect"))
_add("coverage", _plain("station file_year obs days_in_year", **{f"coverage_{c}": "9" for c in CRITERIA}), "years", lambda s, d: _climate(s, d).years)
_add(
    "year_stats",
    _plain("station file_year step obs valid_days perfect_count indoor_count gloomy_count bad_count samples gloom_weighted gloom_longest gloom_len_sum gloom_len_count pstreak_weighted pstreak_longest pstreak_len_sum pstreak_len_count", score_sum="5", precip_mm="5"),
    "years",
    lambda s, d: _climate(s, d).years,
)
_add("exclusion", _plain("station file_year excluded_kind excluded_criterion", excluded_value="9"), "years", lambda s, d: _patchy(s, d).years, chain=PATCHY_CHAIN)
_add("monthly_table", _plain("station file_year month days perfect indoor temp_n dew_n cloud_n wind_n precip_n wet_n gloomy", temp_sum="5", dew_sum="5", cloud_sum="5", wind_sum="5"), "months", lambda s, d: _climate(s, d).months)
_YEAR = {f"year_{c}": "6" for c in ("score", "perfect_days", "indoor_days", "precip_mm", "gloomy_days", "bad_days", "gloom_streaks", "perfect_streaks")}
_add("year_scores", _plain("station file_year step", valid_day_fraction="9", **_YEAR), "year_scores", lambda s, d: days.year_scores(_climate(s, d).years))
_add("seasonal_concentration", _plain("station", concentration="6"), "seasonal", lambda s, d: days.seasonal_concentration(_counted(_climate(s, d))))
_MEANS = {c: "6" for c in ("avg_score", "avg_perfect_days", "avg_indoor_days", "avg_annual_precip_mm", "avg_gloomy_days", "avg_bad_days", "avg_gloom_streaks", "avg_perfect_streaks", "gloom_avg_length", "perfect_streak_avg_length", "coverage", "seasonal_concentration", "perfect_indoor_ratio")}
_add("station_aggregate", _plain("station years_included step samples gloom_longest_run perfect_streak_longest_run", **_MEANS), "stations", lambda s, d: _climate(s, d).stations)


def _counted(found: Climate) -> DataFrame:
    return compose.matched(found.months, days.year_scores(found.years), list(KEYS))


_PROFILE = ("temp", "dew", "cloud", "wind")
_add(
    "monthly_profile",
    _plain("station month", **{c: "6" for c in (*_PROFILE, "rain", "perfect_rate", "indoor_rate", "gloom_rate")}),
    f"""(SELECT station, month, {', '.join(f'CASE WHEN sum({c}_n) > 0 THEN sum({c}_sum) / sum({c}_n) END AS {c}' for c in _PROFILE)},
      CASE WHEN sum(precip_n) > 0 THEN 100::DOUBLE * sum(wet_n) / sum(precip_n) END AS rain, {', '.join(f'100::DOUBLE * sum({c}) / sum(days) AS {n}' for n, c in (('perfect_rate', 'perfect'), ('indoor_rate', 'indoor'), ('gloom_rate', 'gloomy')))} FROM counted GROUP BY station, month)""",
    lambda s, d: days.monthly_profile(_counted(_climate(s, d))),
)
_PASSED = "(SELECT station, count(*) FILTER (WHERE excluded_kind IS NULL) AS passed FROM years GROUP BY station)"


def _mode(few_days: str) -> str:
    """SQL: station and its most common reason, of equal ones the first."""
    return f"""(SELECT station, reason, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, min(file_year)) AS place
      FROM (SELECT station, file_year, coalesce(excluded_criterion, '{few_days}') AS reason FROM years WHERE excluded_kind IS NOT NULL) GROUP BY station, reason)"""


_add(
    "station_exclusions",
    "station reason",
    f"(SELECT p.station, CASE WHEN passed > 0 THEN 'fewer than 3 valid years' ELSE coalesce(m.reason, 'no data') END AS reason FROM {_PASSED} p LEFT JOIN (SELECT * FROM {_mode(days.TOO_FEW_DAYS)} WHERE place = 1) m ON m.station = p.station WHERE passed < 3)",
    lambda s, d: days.exclusions(_patchy(s, d).years),
    chain=PATCHY_CHAIN,
)
_MEAN = {f"mean_{c}": "" for c in CRITERIA}
_add(
    "explain_years",
    {"station": "", "name": "", "reason": "", "years": "", "last_step": "", **_MEAN},
    f"""(SELECT p.station, coalesce(name, '?') AS name, CASE WHEN passed > 0 THEN 'few years' ELSE coalesce(m.reason, 'ok') END AS reason, years, last_step, {', '.join(_MEAN)}
      FROM {_PASSED} p JOIN (SELECT station, count(*) AS years, arg_max(step, file_year) AS last_step, {', '.join(f'round_even(avg(coverage_{c}) * 100, 0)::INT AS mean_{c}' for c in CRITERIA)} FROM years GROUP BY station) y ON y.station = p.station
      LEFT JOIN (SELECT * FROM {_mode('valid days')} WHERE place = 1) m ON m.station = p.station LEFT JOIN (SELECT station, name FROM places WHERE station <> 1) n ON n.station = p.station WHERE passed < 3)""",
    lambda s, d: compose.explained(_patchy(s, d).years, places(s, d).where("station <> 1").select("station", "name")),
    chain=PATCHY_CHAIN,
)
_add(
    "explain_filtered",
    "station reason",
    f"(SELECT p.station, m.reason FROM {_PASSED} p JOIN (SELECT * FROM {_mode('valid days')} WHERE place = 1) m ON m.station = p.station WHERE passed = 0 AND m.reason IN ('valid days', 'temp_c'))",
    lambda s, d: compose.explained(_patchy(s, d).years, places(s, d).select("station", "name"), ["valid days", "temp_c"]),
    chain=PATCHY_CHAIN,
)
_RESULTS = {"score": "3", "perfect": "1", "indoor": "1", "gloom": "1", "pstreak": "1"}
_add(
    "year_details",
    {"station": "", "year": "", "obs": "", "step": "", "kind": "", "criterion": "", **dict.fromkeys(("valid_days", "value", "cover_temp", "cover_cloud"), ""), **dict.fromkeys(_RESULTS, "")},
    f"""(SELECT station, file_year AS year, obs, step, excluded_kind AS kind, excluded_criterion AS criterion, round(valid_days / days_in_year, 3) AS valid_days, round(excluded_value, 3) AS value,
      round(coverage_temp_c, 3) AS cover_temp, round(coverage_cloud_pct, 3) AS cover_cloud, {', '.join(f'CASE WHEN excluded_kind IS NULL THEN round({c}, {_RESULTS[n]}) END AS {n}' for n, c in (('score', 'score_sum / valid_days'), *((n, f'{c} * (365::DOUBLE / valid_days)') for n, c in (('perfect', 'perfect_count'), ('indoor', 'indoor_count'), ('gloom', 'gloom_weighted'), ('pstreak', 'pstreak_weighted')))))} FROM years)""",
    lambda s, d: days.year_details(_patchy(s, d).years).select("*", "excluded.kind", "excluded.criterion", "excluded.value", F.col("coverage.temp_c").alias("cover_temp"), F.col("coverage.cloud_pct").alias("cover_cloud")),
    chain=PATCHY_CHAIN,
)


def _with_vegetation(s: SparkSession, d: str) -> DataFrame:
    return _climate(s, d).stations.withColumn("avg_vegetation", scalar.vegetation_from_rain(F.col("avg_annual_precip_mm")))


_VEG = "least(1::DOUBLE, greatest(0::DOUBLE, (avg_annual_precip_mm - 125) / 875))"
_NORM = "CASE WHEN max({0}) OVER () = min({0}) OVER () THEN 0.5 ELSE ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) END"
_add(
    "minmax_composite",
    {"station": "", "avg_vegetation": "6", "avg_score": "4"},
    f"(SELECT station, avg_vegetation, {_NORM.format('raw')} AS avg_score FROM (SELECT station, avg_vegetation, {_NORM.format('avg_perfect_days')} + 0.5::DOUBLE * avg_vegetation - {_NORM.format('avg_bad_days')} AS raw FROM (SELECT *, {_VEG} AS avg_vegetation FROM stations)))",
    lambda s, d: compose.composite(_with_vegetation(s, d)),
)
_add("cadence_filter", {"station": "", "lines": "", "days": "", "obs_per_day": "9", "accepted": ""}, """(SELECT station, sum(lines)::BIGINT AS lines, sum(days)::BIGINT AS days, sum(lines)::DOUBLE / sum(days) AS obs_per_day, sum(lines)::DOUBLE / sum(days) >= 7 AS accepted
  FROM (SELECT station, file_year, count(*) AS lines, dayofyear(make_date(file_year, 12, 31)) AS days FROM reports GROUP BY station, file_year) GROUP BY station)""", lambda s, d: hours.cadence(reports(s, d)))  # fmt: skip
_add("details_notes", "station counted all_years usual_step weak rough usable", f"""(SELECT station, counted, all_years, usual_step, concat_ws(',', {', '.join(f"CASE WHEN {c} < 0.6::DOUBLE THEN '{c}' END" for c in CRITERIA)}) AS weak, counted <= 2 AS rough,
  CASE WHEN mean_valid < 0.95::DOUBLE THEN floor(mean_valid * 100 + 0.5)::INT || '%' END AS usable FROM (SELECT station, count(*) AS counted, {', '.join(f'avg(coverage_{c}) AS {c}' for c in CRITERIA)}, avg(valid_days / days_in_year) AS mean_valid FROM year_scores GROUP BY station)
  JOIN (SELECT station, count(*) AS all_years FROM years GROUP BY station) USING (station)
  JOIN (SELECT station, step AS usual_step, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, max(file_year) DESC) AS r FROM year_scores GROUP BY station, step) u USING (station) WHERE u.r = 1)""", lambda s, d: compose.notes(_climate(s, d).years))  # fmt: skip
for module in (raw, geography, display):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)

"""Weather-like rows made from the driver tables, so that every operator runs on them.

``SQL`` is the same chain for DuckDB: reports, hours, local, effective hours, days, years, months and stations.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.functions.rules import CRITERIA, RULES

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stations: station, name, lat 5 to 65, lon -120 to 120."""
    st = F.col("r_regionkey")
    return read(spark, sf_dir, "region").select(st.cast("int").alias("station"), F.col("r_name").alias("name"), (st * 15 + 5).cast("double").alias("lat"), (st * 60 - 120).cast("double").alias("lon"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lineitem is a report of each of the five stations; its hour is local, 7 to 20."""
    held = read(spark, sf_dir, "lineitem").select(*LINE, "l_discount", "l_tax", "l_returnflag", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("station"), F.to_date("l_shipdate").alias("day"))
    st, q, ln = F.col("station"), F.col("l_quantity"), F.col("l_linenumber")
    e, hour = F.unix_date("day").cast("long"), 7 + (F.col("l_orderkey") * 7 + ln) % 14
    dc, tx = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    at = e * 24 + hour - (st * 4 - 8)
    cloud = 12.5 * F.greatest(F.lit(0), F.least(F.lit(8), (F.floor(e / 4) * 5 + st * 3) % 9 + tx % 3 - 1))
    temp = F.lit(-8.0) + (183 - F.abs(F.dayofyear("day") - 200)) * 0.2 + (q - 25.0) * 0.1 + st * 2.0 - F.abs(hour - 14) * 0.5
    temp = F.when((F.col("l_orderkey") + ln) % 41 != 0, temp)
    accumulates = (ln == 6) & (dc % 2 == 0)
    return held.select(
        "station",
        F.date_from_unix_date(F.floor(at / 24).cast("int")).alias("utc_date"),
        F.pmod(at, F.lit(24)).cast("int").alias("utc_hour"),
        (F.col("l_returnflag") == "R").alias("special"),
        *LINE,
        temp.alias("temp_c"),
        (temp - 6.0 - dc * 0.5).alias("dew_c"),
        (q / 4.4).alias("wind_mps"),
        cloud.cast("double").alias("cloud_pct"),
        F.when(ln.isin(6, 7), F.lit(None).cast("double")).when((e + st) % 4 == 0, dc * 0.2).otherwise(0.0).alias("precip_mm"),
        F.when(accumulates, F.when(tx % 3 == 0, 3).when(tx % 3 == 1, 6).otherwise(12)).alias("acc_period"),
        F.when(accumulates, dc * 0.3).alias("acc_depth"),
        F.when((ln == 7) & (dc >= 7), True).when((ln == 7) & (dc <= 3), False).alias("wx_wet"),
        # the order of the key columns as one number; wide enough up to scale 1, and without ties from scale 0.01 on
        (F.shiftleft(F.col("l_orderkey").cast("long"), 36) + F.shiftleft(ln.cast("long"), 33) + F.shiftleft(F.col("l_partkey").cast("long"), 14) + F.col("l_suppkey")).alias("line_no"),
    ).withColumn("file_year", F.year("utc_date"))


def patchy(rows: DataFrame) -> DataFrame:
    """The reports with gaps, so that years are left out for every reason: station 1 has too few complete hours on most days of all
    years, station 2 no temperature up to 1998 and no cloud after that, station 3 only two whole years, station 4 alternates."""
    st, y, odd = F.col("station"), F.col("file_year"), F.col("utc_hour") % 2 == 1
    no_temp = ((st == 2) & (y <= 1998)) | ((st == 3) & ~y.isin(1996, 1999)) | ((st == 4) & (y % 2 == 0))
    no_cloud = ((st == 1) & odd) | ((st == 2) & (y > 1998)) | ((st == 4) & (y % 2 == 1) & odd)
    return rows.withColumns({"temp_c": F.when(~no_temp, F.col("temp_c")), "dew_c": F.when(~no_temp, F.col("dew_c")), "cloud_pct": F.when(~no_cloud, F.col("cloud_pct"))})


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _triangle(v: str, b: tuple[float, float, float]) -> str:
    low, ideal, high = map(_d, b)
    return f"CASE WHEN {v} <= {low} OR {v} >= {high} THEN 0::DOUBLE WHEN {v} < {ideal} THEN ({v} - {low}) / ({ideal} - {low}) WHEN {v} > {ideal} THEN ({high} - {v}) / ({high} - {ideal}) WHEN {v} IS NOT NULL THEN 1::DOUBLE END"


def _one_side(v: str, b: tuple[float, float]) -> str:
    ideal, most = map(_d, b)
    return f"CASE WHEN {v} >= {most} THEN 0::DOUBLE WHEN {v} <= {ideal} THEN 1::DOUBLE WHEN {v} IS NOT NULL THEN ({most} - {v}) / ({most} - {ideal}) END"


def daylight_sql(lat: str, doy: str) -> tuple[str, str]:
    tilt = f"({_d(math.radians(RULES.tilt))} * sin({_d(2 * math.pi / 365.0)} * ({doy} - {RULES.equinox})))"
    c = f"(-tan(radians({lat})) * tan({tilt}))"
    half = f"(CASE WHEN {c} <= -1 THEN 12::DOUBLE WHEN {c} >= 1 THEN 0::DOUBLE WHEN {c} IS NOT NULL THEN degrees(acos(greatest(-1::DOUBLE, least(1::DOUBLE, {c})))) / 15 END)"
    return f"coalesce(greatest({RULES.day_start}, ceil(12 - {half})::INT), {RULES.day_start})", f"coalesce(least({RULES.day_end}, floor(12 + {half})::INT), {RULES.day_end})"


K = "station, file_year"
_ORDER = "(NOT special), " + ", ".join(LINE)
_START, _END = daylight_sql("lat", "dayofyear(local_date)")
_DAY_LENGTH = float(RULES.day_end - RULES.day_start)
_COVER = ", ".join(f"sum(n_{c})::BIGINT AS n_{c}" for c in CRITERIA)
_WORST = "CASE " + " ".join(f"WHEN coverage_{c} <= least({', '.join(f'coverage_{x}' for x in CRITERIA)}) THEN '{c}'" for c in CRITERIA) + " END"
_LEAST = f"least({', '.join(f'coverage_{x}' for x in CRITERIA)})"


def _streak_sql(name: str, flag: str) -> str:
    return f"""
  {name}_islands AS (SELECT {K}, local_date, (local_date - DATE '1970-01-01') - row_number() OVER (PARTITION BY {K} ORDER BY local_date) AS island FROM own WHERE valid AND {flag}),
  {name}_runs AS (SELECT {K}, min(local_date) AS first_day, count(*) AS days, CASE WHEN count(*) < {RULES.streak_days} THEN 0 ELSE floor((count(*) + 2) / 3)::BIGINT END AS weight FROM {name}_islands GROUP BY {K}, island HAVING count(*) >= {RULES.streak_days}),
  {name}_totals AS (SELECT {K}, sum(weight)::BIGINT AS {name}_weighted, max(days) AS {name}_longest, sum(days)::BIGINT AS {name}_len_sum, count(*) AS {name}_len_count FROM {name}_runs GROUP BY {K})"""


CHAIN = f"""
WITH base AS (
  SELECT l.*, st.station::INT AS station, l_shipdate::DATE AS day, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT AS e, 7 + (l_orderkey * 7 + l_linenumber) % 14 AS h,
    round(l_discount * 100)::INT AS dc, round(l_tax * 100)::INT AS tx FROM lineitem l, (SELECT unnest(range(5)) AS station) st),
  made AS (SELECT *, e * 24 + h - (station * 4 - 8) AS ah FROM base),
  reports AS (
  SELECT station, DATE '1970-01-01' + floor(ah / 24)::INT AS utc_date, (ah % 24)::INT AS utc_hour, l_returnflag = 'R' AS special, {', '.join(LINE)},
    CASE WHEN (l_orderkey + l_linenumber) % 41 <> 0 THEN -8::DOUBLE + (183 - abs(dayofyear(day) - 200)) * 0.2::DOUBLE + (l_quantity - 25) * 0.1::DOUBLE + station * 2::DOUBLE - abs(h - 14) * 0.5::DOUBLE END AS temp_c,
    CASE WHEN (l_orderkey + l_linenumber) % 41 <> 0 THEN -8::DOUBLE + (183 - abs(dayofyear(day) - 200)) * 0.2::DOUBLE + (l_quantity - 25) * 0.1::DOUBLE + station * 2::DOUBLE - abs(h - 14) * 0.5::DOUBLE END - 6::DOUBLE - dc * 0.5::DOUBLE AS dew_c,
    l_quantity / 4.4::DOUBLE AS wind_mps,
    12.5::DOUBLE * greatest(0, least(8, (floor(e / 4)::INT * 5 + station * 3) % 9 + tx % 3 - 1)) AS cloud_pct,
    CASE WHEN l_linenumber IN (6, 7) THEN NULL WHEN (e + station) % 4 = 0 THEN dc * 0.2::DOUBLE ELSE 0 END AS precip_mm,
    CASE WHEN l_linenumber = 6 AND dc % 2 = 0 THEN CASE tx % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END END AS acc_period,
    CASE WHEN l_linenumber = 6 AND dc % 2 = 0 THEN dc * 0.3::DOUBLE END AS acc_depth,
    CASE WHEN l_linenumber = 7 AND dc >= 7 THEN true WHEN l_linenumber = 7 AND dc <= 3 THEN false END AS wx_wet,
    year(DATE '1970-01-01' + floor(ah / 24)::INT)::INT AS file_year FROM made),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY {K}, utc_date, utc_hour ORDER BY {_ORDER}) AS ord FROM reports),
  hours AS (
  SELECT {K}, utc_date, utc_hour, {', '.join(f'arg_max({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('temp_c', 'dew_c', 'wind_mps', 'cloud_pct'))},
    max(precip_mm) AS precip_mm, bool_or(wx_wet) AS wx_wet, arg_max(acc_period, ord) FILTER (WHERE acc_period IS NOT NULL) AS acc_period, arg_max(acc_depth, ord) FILTER (WHERE acc_period IS NOT NULL) AS acc_depth
  FROM ordered GROUP BY {K}, utc_date, utc_hour),
  places AS (SELECT r_regionkey::INT AS station, r_name AS name, (r_regionkey * 15 + 5)::DOUBLE AS lat, (r_regionkey * 60 - 120)::DOUBLE AS lon FROM region),
  shifted AS (SELECT hours.*, lat, greatest(-12, least(12, round_even(lon / 15, 0)::INT)) AS utc_offset FROM hours JOIN places USING (station)),
  timed AS (SELECT *, (utc_date - DATE '1970-01-01')::BIGINT * 24 + utc_hour + utc_offset AS abs_hour FROM shifted),
  localised AS (SELECT *, DATE '1970-01-01' + floor(abs_hour / 24)::INT AS local_date, (abs_hour % 24)::INT AS local_hour FROM timed),
  evidence AS (SELECT {K}, count(*) FILTER (WHERE precip_mm IS NOT NULL OR coalesce(wx_wet, false) OR acc_period IS NOT NULL) AS evidence FROM hours GROUP BY {K}),
  covered AS (SELECT {K}, abs_hour AS end_hour, acc_period AS period, acc_depth AS depth, CASE WHEN acc_depth = 0 THEN 0 ELSE greatest(acc_depth / acc_period, {_d(RULES.wet_mm)}) END AS fill,
    unnest(range(abs_hour - acc_period + 1, abs_hour + 1)) AS abs_hour FROM localised WHERE acc_period <= 6 OR acc_depth = 0),
  slots AS (SELECT {K}, abs_hour, arg_min(fill, r) AS fill FROM (SELECT *, row_number() OVER (PARTITION BY {K}, abs_hour ORDER BY end_hour, period, depth) AS r FROM covered) GROUP BY {K}, abs_hour),
  lit AS (SELECT *, {_START} AS day_start, {_END} AS day_end FROM localised),
  -- materialised, as a limit on it would else turn its joins into a loop over all rows
  effective AS MATERIALIZED (
  SELECT {K}, lat, local_date, local_hour, abs_hour, day_start, day_end, temp_c, dew_c,
    coalesce(precip_mm, CASE WHEN wx_wet THEN {_d(RULES.wet_mm)} WHEN NOT wx_wet AND evidence >= {RULES.evidence_hours} THEN 0 END, fill) AS precip_mm, cloud_pct, wind_mps
  FROM lit JOIN evidence USING ({K}) LEFT JOIN slots USING ({K}, abs_hour) WHERE local_hour >= day_start AND local_hour < day_end),
  factors AS (SELECT *, {_triangle('temp_c', RULES.temp)} AS temp_score, {_triangle('dew_c', RULES.dew)} AS dew_score, {_one_side('precip_mm', RULES.precip)} AS precip_score, {_one_side('cloud_pct', RULES.cloud)} AS cloud_score FROM effective),
  gaps AS (SELECT *, local_hour - lag(local_hour) OVER (PARTITION BY {K}, local_date ORDER BY local_hour) AS gap FROM effective),
  gap_counts AS (SELECT {K}, gap, count(*) AS n, min(abs_hour) AS first FROM gaps WHERE gap IS NOT NULL GROUP BY {K}, gap),
  gap_best AS (SELECT {K}, gap, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, first) AS r FROM gap_counts),
  steps AS (SELECT f.station, f.file_year, (CASE WHEN gap IS NULL THEN 1 ELSE greatest(1, least(6, gap)) END)::INT AS step FROM (SELECT DISTINCT {K} FROM effective) f LEFT JOIN (SELECT * FROM gap_best WHERE r = 1) g USING ({K})),
  scored AS (SELECT *, temp_score + dew_score + precip_score + cloud_score AS hour_score,
    temp_score IS NOT NULL AND dew_score IS NOT NULL AND precip_score IS NOT NULL AND cloud_score IS NOT NULL AS complete,
    coalesce(temp_score > 0 AND dew_score > 0 AND precip_score > 0 AND cloud_score > 0, false) AS good FROM factors JOIN steps USING ({K})),
  linked AS (SELECT *, coalesce(good AND lag(good) OVER w AND local_hour - lag(local_hour) OVER w <= step, false) AS goes_on FROM scored WINDOW w AS (PARTITION BY {K}, local_date ORDER BY local_hour)),
  numbered AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY {K}, local_date ORDER BY local_hour) AS run FROM linked),
  good_runs AS (SELECT {K}, local_date, max(n) AS best_run FROM (SELECT {K}, local_date, run, count(*) FILTER (WHERE good) AS n FROM numbered GROUP BY {K}, local_date, run) GROUP BY {K}, local_date),
  day_sums AS (
  SELECT {K}, local_date, any_value(step) AS step, any_value(day_end - day_start) AS day_len, count(*) AS obs, count(*) FILTER (WHERE complete) AS complete, {', '.join(f'count({c}) AS n_{c}' for c in CRITERIA)},
    list_sort(list(hour_score) FILTER (WHERE complete), 'DESC') AS best, max(temp_c) AS max_temp, max(dew_c) AS max_dew, max(cloud_pct) AS max_cloud, max(wind_mps) AS max_wind, sum(precip_mm) AS sum_precip,
    count(*) FILTER (WHERE cloud_pct > {_d(RULES.gloom_cloud)}) AS cloudy, {', '.join(f'sum({c}) AS sum_{c}' for c in ('temp_c', 'dew_c', 'cloud_pct', 'wind_mps'))}, count(*) FILTER (WHERE precip_mm > 0) AS n_wet
  FROM scored GROUP BY {K}, local_date),
  day_rules AS (
  SELECT *, ceil({float(RULES.top_hours)} / step)::INT AS top, CASE WHEN step = 1 THEN {RULES.perfect_hours} ELSE greatest(2, ceil({float(RULES.perfect_hours)} / step)::INT) END AS need,
    coalesce(max_temp < {_d(RULES.indoor_cold)}, false) OR coalesce(max_temp > {_d(RULES.indoor_hot)}, false) OR coalesce(max_dew > {_d(RULES.indoor_dew)}, false)
      OR coalesce(max_cloud > {_d(RULES.indoor_cloud)} AND sum_precip > {_d(RULES.indoor_precip)}, false) OR coalesce(max_wind > {_d(RULES.indoor_wind)}, false) AS indoor,
    cloudy >= {RULES.gloom_records} AS gloomy FROM day_sums JOIN good_runs USING ({K}, local_date)),
  days AS (
  SELECT *, best_run >= need AS perfect, indoor OR gloomy AS bad, CASE WHEN complete >= top THEN list_sum(list_slice(best, 1, top)) / (top * 4) END AS day_score,
    day_len > 0 AND complete * step >= day_len * {_d(RULES.min_fill)} AND complete >= top AS valid FROM day_rules),
  own AS (SELECT * FROM days WHERE year(local_date) = file_year),
  {_streak_sql('gloom', 'bad').strip()},
  {_streak_sql('pstreak', 'perfect').strip()},
  year_sums AS (
  SELECT {K}, any_value(step) AS step, sum(obs)::BIGINT AS obs, {_COVER}, count(*) FILTER (WHERE valid) AS valid_days, coalesce(sum(day_score) FILTER (WHERE valid), 0) AS score_sum,
    {', '.join(f'count(*) FILTER (WHERE valid AND {c}) AS {c}_count' for c in ('perfect', 'indoor', 'gloomy', 'bad'))}, coalesce(sum(complete) FILTER (WHERE valid), 0)::BIGINT AS samples,
    coalesce(sum(sum_precip * 24::DOUBLE / day_len) FILTER (WHERE valid), 0) AS precip_mm, dayofyear(make_date(file_year, 12, 31)) AS days_in_year FROM own GROUP BY {K}),
  year_cover AS (SELECT *, {', '.join(f'n_{c} / (days_in_year * {_d(_DAY_LENGTH)} / step) AS coverage_{c}' for c in CRITERIA)} FROM year_sums),
  years AS (
  SELECT y.*, {', '.join(f'coalesce({n}_{k}, 0) AS {n}_{k}' for n in ('gloom', 'pstreak') for k in ('weighted', 'longest', 'len_sum', 'len_count'))},
    CASE WHEN {_LEAST} < {_d(RULES.min_fraction)} THEN 'coverage' WHEN valid_days / days_in_year < {_d(RULES.min_fraction)} THEN 'days' END AS excluded_kind,
    CASE WHEN {_LEAST} < {_d(RULES.min_fraction)} THEN {_WORST} END AS excluded_criterion,
    CASE WHEN {_LEAST} < {_d(RULES.min_fraction)} THEN {_LEAST} WHEN valid_days / days_in_year < {_d(RULES.min_fraction)} THEN valid_days / days_in_year END AS excluded_value
  FROM year_cover y LEFT JOIN gloom_totals USING ({K}) LEFT JOIN pstreak_totals USING ({K})),
  months AS (
  SELECT {K}, month(local_date)::INT AS month, count(*) AS days, count(*) FILTER (WHERE perfect) AS perfect, count(*) FILTER (WHERE indoor) AS indoor,
    {', '.join(f'coalesce(sum(sum_{c}), 0) AS {s}_sum, sum(n_{c})::BIGINT AS {s}_n' for s, c in (('temp', 'temp_c'), ('dew', 'dew_c'), ('cloud', 'cloud_pct'), ('wind', 'wind_mps')))},
    sum(n_precip_mm)::BIGINT AS precip_n, sum(n_wet)::BIGINT AS wet_n, count(*) FILTER (WHERE gloomy) AS gloomy FROM own WHERE valid GROUP BY {K}, month(local_date)),
  year_scores AS (
  SELECT *, score_sum / valid_days AS year_score, valid_days / days_in_year AS valid_day_fraction, {', '.join(f'{c} * ({_d(RULES.target_days)} / valid_days) AS {n}' for n, c in (('year_perfect_days', 'perfect_count'), ('year_indoor_days', 'indoor_count'), ('year_precip_mm', 'precip_mm'), ('year_gloomy_days', 'gloomy_count'), ('year_bad_days', 'bad_count'), ('year_gloom_streaks', 'gloom_weighted'), ('year_perfect_streaks', 'pstreak_weighted')))}
  FROM years WHERE excluded_kind IS NULL),
  counted AS (SELECT months.* FROM months SEMI JOIN year_scores USING ({K})),
  rates AS (SELECT station, month, 100::DOUBLE * sum(perfect) / sum(days) AS rate FROM counted GROUP BY station, month),
  seasonal AS (SELECT station, CASE WHEN count(*) >= {RULES.seasonal_months} THEN CASE WHEN avg(rate) = 0 THEN 0 ELSE least(1::DOUBLE, stddev_pop(rate) / avg(rate) / sqrt(greatest(count(*) - 1, 1))) END END AS concentration FROM rates GROUP BY station),
  station_steps AS (SELECT station, step, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, min(file_year)) AS r FROM year_scores GROUP BY station, step),
  station_means AS (
  SELECT station, avg(year_score) AS avg_score, avg(year_perfect_days) AS avg_perfect_days, avg(year_indoor_days) AS avg_indoor_days, avg(year_precip_mm) AS avg_annual_precip_mm, avg(year_gloomy_days) AS avg_gloomy_days,
    avg(year_bad_days) AS avg_bad_days, avg(year_gloom_streaks) AS avg_gloom_streaks, avg(year_perfect_streaks) AS avg_perfect_streaks, max(gloom_longest) AS gloom_longest_run,
    CASE WHEN sum(gloom_len_count) > 0 THEN sum(gloom_len_sum)::DOUBLE / sum(gloom_len_count) END AS gloom_avg_length, max(pstreak_longest) AS perfect_streak_longest_run,
    CASE WHEN sum(pstreak_len_count) > 0 THEN sum(pstreak_len_sum)::DOUBLE / sum(pstreak_len_count) END AS perfect_streak_avg_length, count(*) AS years_included, avg(valid_day_fraction) AS coverage, sum(samples)::BIGINT AS samples
  FROM year_scores GROUP BY station HAVING count(*) >= {RULES.min_years}),
  stations AS (
  SELECT m.*, step, CASE WHEN avg_perfect_days >= {_d(RULES.seasonal_days)} THEN concentration END AS seasonal_concentration,
    CASE WHEN avg_perfect_days + avg_indoor_days = 0 THEN 0 ELSE (avg_perfect_days - avg_indoor_days) / (avg_perfect_days + avg_indoor_days) END AS perfect_indoor_ratio
  FROM station_means m JOIN (SELECT station, step FROM station_steps WHERE r = 1) USING (station) LEFT JOIN seasonal USING (station))
"""


_NO_TEMP = "(station = 2 AND file_year <= 1998) OR (station = 3 AND file_year NOT IN (1996, 1999)) OR (station = 4 AND file_year % 2 = 0)"
_NO_CLOUD = "(station = 1 AND utc_hour % 2 = 1) OR (station = 2 AND file_year > 1998) OR (station = 4 AND file_year % 2 = 1 AND utc_hour % 2 = 1)"
_KEPT = "station, utc_date, utc_hour, special, " + ", ".join(LINE) + ", wind_mps, precip_mm, acc_period, acc_depth, wx_wet, file_year"
#: The same chain over the reports of ``patchy``.
PATCHY_CHAIN = CHAIN.replace("  reports AS (", "  whole_reports AS (").replace(
    "  ordered AS (",
    f"""  reports AS (SELECT {_KEPT}, CASE WHEN {_NO_TEMP} THEN NULL ELSE temp_c END AS temp_c, CASE WHEN {_NO_TEMP} THEN NULL ELSE dew_c END AS dew_c,
    CASE WHEN {_NO_CLOUD} THEN NULL ELSE cloud_pct END AS cloud_pct FROM whole_reports),
  ordered AS (""",
)

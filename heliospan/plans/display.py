"""Queries of the map: scales, filters, colours and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.functions import scalar
from heliospan.operators import compose, hours, spatial
from heliospan.plans.synthetic import read

QUERIES, ORACLES = {}, {}


def _sql(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_sql("metric_stats", lambda s, d: compose.metric_stats(read(s, d, "customer").withColumn("one", F.lit(1.0)), ["c_acctbal", "c_nationkey", "one"]),
     " UNION ALL ".join(f"SELECT '{m}' AS metric, CASE WHEN min({c}) = max({c}) THEN min({c}) - 1 ELSE min({c}) END::DOUBLE AS least, CASE WHEN min({c}) = max({c}) THEN max({c}) + 1 ELSE max({c}) END::DOUBLE AS most, count({c}) AS n FROM customer" for m, c in (("c_acctbal", "c_acctbal"), ("c_nationkey", "c_nationkey"), ("one", "1"))))


def _goodness(s: SparkSession, d: str) -> DataFrame:
    rows = compose.with_bounds(read(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    args = (F.col("c_acctbal"), F.col("__min_c_acctbal"), F.col("__max_c_acctbal"))
    return rows.select("c_custkey", F.round(scalar.goodness(*args), 9).alias("high"), F.round(scalar.goodness(*args, higher_is_better=False), 9).alias("low"))


_R = "((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()))"
_sql("goodness_ratio", _goodness, f"SELECT c_custkey, round({_R}, 9) AS high, round(1 - {_R}, 9) AS low FROM customer")
_sql("range_filter", lambda s, d: read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("v")).where(compose.in_range(F.col("v"), 0.0, 5000.0)), "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS v FROM customer WHERE c_custkey % 9 = 0 OR c_acctbal BETWEEN 0 AND 5000")
_sql("slider_snap", lambda s, d: read(s, d, "customer").select("c_custkey", *(v.alias(n) for n, v in zip(("low", "high"), compose.snapped(F.col("c_acctbal"), (F.col("c_nationkey") * 400 - 1000).cast("double"), F.lit(-900.0), F.lit(8000.0)), strict=True))),
     "SELECT c_custkey, CASE WHEN least(c_acctbal, b) <= -900 + 0.0089::DOUBLE THEN -900 ELSE least(c_acctbal, b) END AS low, CASE WHEN greatest(c_acctbal, b) >= 8000 - 0.0089::DOUBLE THEN 8000 ELSE greatest(c_acctbal, b) END AS high FROM (SELECT *, (c_nationkey * 400 - 1000)::DOUBLE AS b FROM customer)")


def _rgb(stops: Sequence[tuple], x: str, factor: float | None = None) -> str:
    out = []
    for k, name in enumerate(("red", "green", "blue"), 1):
        case = "CASE " + " ".join(f"WHEN x <= {b[0]}::DOUBLE THEN {a[k]} + ({b[k]} - {a[k]}) * ((x - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE))" for a, b in zip(stops, stops[1:], strict=False)) + f" ELSE {stops[-1][k]} END"
        value = f"floor({case} + 0.5::DOUBLE)::INT"
        out.append((f"floor({value} * {factor}::DOUBLE + 0.5::DOUBLE)::INT" if factor else value) + f" AS {name}")
    return f"{', '.join(out)} FROM (SELECT *, greatest({stops[0][0]}::DOUBLE, least({stops[-1][0]}::DOUBLE, {x})) AS x FROM customer)"


def _coloured(x: F.Column, stops: Sequence[tuple], factor: float = 1.0):
    return lambda s, d: read(s, d, "customer").select("c_custkey", *(v.alias(n) for n, v in scalar.ramp_rgb(x, stops, factor).items()))


for _name, _x, _xs, _stops, _factor in (
    ("ratio_rgb", "(c_acctbal + 1000) / 11000.0", "(c_acctbal + 1000) / 11000", scalar.GOODNESS_STOPS, None),
    ("ratio_text_rgb", "(c_acctbal + 1000) / 11000.0", "(c_acctbal + 1000) / 11000", scalar.GOODNESS_STOPS, 0.7),
    ("temp_rgb", "c_acctbal / 150.0 - 20.0", "c_acctbal / 150 - 20", scalar.TEMP_STOPS, None),
    ("ndvi_palette", "(c_custkey % 255) / 254.0", "(c_custkey % 255) / 254", scalar.NDVI_STOPS, None),
):
    _sql(_name, lambda s, d, x=_x, stops=_stops, f=_factor: _coloured(F.expr(x).cast("double"), stops, f or 1.0)(s, d), f"SELECT c_custkey, {_rgb(_stops, _xs, _factor)}")
_sql("nice_step", lambda s, d: read(s, d, "customer").select("c_custkey", F.round(scalar.nice_step(F.abs("c_acctbal"), 3), 9).alias("step")), """
SELECT c_custkey, round(CASE WHEN raw / size <= 1 THEN 1 WHEN raw / size <= 2 THEN 2 WHEN raw / size <= 5 THEN 5 ELSE 10 END * size, 9) AS step FROM (SELECT *, pow(10::DOUBLE, floor(log10(raw))) AS size FROM (SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 1 ELSE abs(c_acctbal) END / 3 AS raw FROM customer))""")
_sql("percent_text", lambda s, d: read(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("v")).select("l_suppkey", scalar.percent_text(F.round("v", 6) * 8).alias("whole"), scalar.percent_text(F.round("v", 6) * 8, 0.4).alias("cut"), scalar.coverage_level(F.round("v", 6) * 8).alias("level")), """
SELECT l_suppkey, floor(v * 100 + 0.5::DOUBLE)::INT || '%' AS whole, CASE WHEN v < 0.4::DOUBLE THEN floor(v * 100)::INT ELSE floor(v * 100 + 0.5::DOUBLE)::INT END || '%' AS cut, CASE WHEN v < 1 / 3 THEN 'lo' WHEN v < 0.667::DOUBLE THEN 'mid' ELSE 'hi' END AS level
FROM (SELECT l_suppkey, round(avg(l_discount), 6) * 8 AS v FROM lineitem GROUP BY l_suppkey)""")
_sql("cadence_label", lambda s, d: read(s, d, "nation").select("n_nationkey", scalar.cadence_label(F.col("n_nationkey") % 6 + 1).alias("label")), "SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'Hourly' ELSE (n_nationkey % 6 + 1) || '-hour' END AS label FROM nation")


def _summary(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(s, d, "customer").select("c_custkey", scalar.data_summary((k % 6 + 1).cast("int"), (k % 16).cast("int"), F.when(k % 5 != 0, k * 977), F.when(k % 3 != 0, k % 64 / 64.0)).alias("text"))


_SPAN = "(c_custkey % 16)::VARCHAR || ' yrs'"
_sql("data_summary", _summary, f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN {_SPAN} || ' of data' ELSE CASE WHEN c_custkey % 6 = 0 THEN 'Hourly' ELSE (c_custkey % 6 + 1) || '-hour' END || ' data points spanning ' || {_SPAN} || ' (' || format('{{:,}}', c_custkey * 977) || ' samples)' END
  || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' &middot; ' || floor((c_custkey % 64) / 64.0::DOUBLE * 100 + 0.5::DOUBLE)::INT || '% of days usable' END AS text FROM customer""")
_sql("escape_html", lambda s, d: read(s, d, "customer").select("c_custkey", scalar.escaped(F.concat(F.lit("<b title=\"x\">"), "c_name", F.lit("&'</b>"))).alias("html")), "SELECT c_custkey, replace(replace(replace(replace(replace('<b title=\"x\">' || c_name || '&''</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM customer")
_sql("unit_conversions", lambda s, d: read(s, d, "supplier").select("s_suppkey", *(F.round(f(F.col("s_acctbal")), 6).alias(n) for n, f in (("c", scalar.fahrenheit_to_celsius), ("f", scalar.celsius_to_fahrenheit), ("mps", scalar.mph_to_mps), ("mph", scalar.mps_to_mph), ("mm", scalar.inches_to_mm)))),
     "SELECT s_suppkey, round((s_acctbal - 32) * 5 / 9, 6) AS c, round(s_acctbal * 9 / 5 + 32, 6) AS f, round(s_acctbal * 0.44704::DOUBLE, 6) AS mps, round(s_acctbal * 2.23694::DOUBLE, 6) AS mph, round(s_acctbal * 25.4::DOUBLE, 6) AS mm FROM supplier")


def _stations(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (k % 90).cast("double").alias("avg_perfect_days"), (k % 40).cast("double").alias("avg_indoor_days"), F.when(k % 3 != 0, (k % 20).cast("double")).alias("avg_gloom_streaks"))


_sql("station_backfill", lambda s, d: compose.backfilled(_stations(s, d)).select("id", "avg_gloom_streaks", "avg_perfect_streaks", "avg_net_days", "avg_perfect_minus_gloom", F.round("perfect_indoor_ratio", 9).alias("perfect_indoor_ratio"), "seasonal_concentration"), """
SELECT id, g AS avg_gloom_streaks, 0::DOUBLE AS avg_perfect_streaks, p - i AS avg_net_days, p - g AS avg_perfect_minus_gloom, round(CASE WHEN p + i = 0 THEN 0 ELSE (p - i) / (p + i) END, 9) AS perfect_indoor_ratio, NULL::DOUBLE AS seasonal_concentration
FROM (SELECT s_suppkey AS id, (s_suppkey % 90)::DOUBLE AS p, (s_suppkey % 40)::DOUBLE AS i, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 20)::DOUBLE ELSE 0 END AS g FROM supplier)""")


def _net(s: SparkSession, d: str) -> DataFrame:
    """Fractional days, so that the digits show."""
    k = F.col("s_suppkey")
    rows = read(s, d, "supplier").select(k.alias("id"), (k * 37 % 9000 / 64.0).alias("avg_perfect_days"), (k * 53 % 7000 / 64.0).alias("avg_indoor_days"), (k * 11 % 500 / 64.0).alias("avg_gloom_streaks"), F.when(k % 3 != 0, k * 7 % 40000 / 8.0).alias("elevation"))
    return compose.published(rows).select("id", "avg_net_days", "avg_perfect_minus_gloom", "avg_perfect_days", "elevation")


_EVEN = "(CASE WHEN abs({0} * {1} - floor({0} * {1})) = 0.5::DOUBLE THEN round_even({0} * {1}, 0) ELSE floor({0} * {1} + 0.5::DOUBLE) END / {1})"
_sql("net_days", _net, f"""SELECT id, {_EVEN.format('(p - i)', 100)} AS avg_net_days, {_EVEN.format('(p - g)', 100)} AS avg_perfect_minus_gloom, {_EVEN.format('p', 100)} AS avg_perfect_days, {_EVEN.format('e', 1)}::BIGINT AS elevation
FROM (SELECT s_suppkey AS id, (s_suppkey * 37 % 9000) / 64.0::DOUBLE AS p, (s_suppkey * 53 % 7000) / 64.0::DOUBLE AS i, (s_suppkey * 11 % 500) / 64.0::DOUBLE AS g, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey * 7 % 40000) / 8.0::DOUBLE END AS e FROM supplier)""")
_sql("streak_weight", lambda s, d: read(s, d, "nation").select("n_nationkey", scalar.streak_weight(F.col("n_nationkey")).alias("w")), "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 0 ELSE floor((n_nationkey + 2) / 3)::BIGINT END AS w FROM nation")
_sql("days_in_year", lambda s, d: read(s, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().select("y", scalar.days_in_year(F.col("y")).alias("n")), "SELECT DISTINCT year(o_orderdate)::INT AS y, dayofyear(make_date(year(o_orderdate), 12, 31))::INT AS n FROM orders")
_sql("colour_bins", lambda s, d: spatial.binned(read(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", -1000.0, 10000.0).select("c_custkey", "bin"), "SELECT c_custkey, greatest(0, least(255, floor((c_acctbal + 1000) / 11000 * 255 + 0.5::DOUBLE)::INT)) AS bin FROM customer")


def _gaps(s: SparkSession, d: str, share: float, opens: int = 0, closes: int = 24) -> DataFrame:
    rows = read(s, d, "events").select("event_id", F.col("user_id").alias("station"), F.year("ts").alias("file_year"), F.hour("ts").alias("local_hour"), F.col("event_id").alias("abs_hour"))
    return hours.masked(rows, share, opens, closes).select("event_id", F.col("local_hour").alias("h"))


_DRAW = "(('0x' || substr(md5(user_id || '|' || year(ts) || '|' || event_id || '|0'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496::DOUBLE"
_sql("gap_mask", lambda s, d: _gaps(s, d, 1.0, 6, 22), "SELECT event_id, hour(ts)::INT AS h FROM events WHERE hour(ts) >= 6 AND hour(ts) < 22")
for _share in (75, 50):
    _sql(f"gap_mask_{_share}", lambda s, d, share=_share / 100: _gaps(s, d, share), f"SELECT event_id, hour(ts)::INT AS h FROM events WHERE {_DRAW} < {_share / 100}::DOUBLE")

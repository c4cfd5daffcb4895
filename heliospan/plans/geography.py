"""Queries over made-up places, rasters and vegetation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.functions import scalar
from heliospan.operators import spatial
from heliospan.plans.synthetic import daylight_sql, read

QUERIES, ORACLES = {}, {}
_LAT, _LON = "((s_suppkey * 37 % 1700) / 10.0::DOUBLE - 85)", "((s_suppkey * 53 % 3600) / 10.0::DOUBLE - 180)"


def points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select("s_suppkey", "s_acctbal", (k * 37 % 1700 / 10.0 - 85).alias("lat"), (k * 53 % 3600 / 10.0 - 180).alias("lon"))


def _sql(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _bounds(s: SparkSession, d: str) -> DataFrame:
    rows = points(s, d).select("s_suppkey", "lat", F.explode(F.sequence(F.lit(1), F.lit(366), F.lit(13))).alias("doy"))
    start, end = scalar.daylight(F.col("half"))
    return rows.withColumn("half", scalar.half_day(F.col("lat"), F.col("doy"))).select("s_suppkey", "doy", start.alias("day_start"), end.alias("day_end"))


_START, _END = daylight_sql("lat", "doy")
_sql("daylight_bounds", _bounds, f"SELECT s_suppkey, doy::INT AS doy, {_START} AS day_start, {_END} AS day_end FROM (SELECT s_suppkey, {_LAT} AS lat, unnest(range(1, 367, 13)) AS doy FROM supplier)")
_sql("utc_offset", lambda s, d: points(s, d).select("s_suppkey", scalar.utc_offset(F.col("lon")).alias("utc_offset")), f"SELECT s_suppkey, greatest(-12, least(12, round_even({_LON} / 15, 0)::INT)) AS utc_offset FROM supplier")
_sql("mercator", lambda s, d: points(s, d).select("s_suppkey", *(F.round(v, 6).alias(n) for n, v in zip(("x", "y"), scalar.mercator(F.col("lat"), F.col("lon")), strict=True))), f"SELECT s_suppkey, round(({_LON} + 180) / 360 * 256, 6) AS x, round((0.5::DOUBLE - ln((1 + sin(radians({_LAT}))) / (1 - sin(radians({_LAT})))) / (4 * pi())) * 256, 6) AS y FROM supplier")

#: A raster of 60 x 120 cells of 3 degrees; the part table fills some of them, a few with no January value.
_ROWS, _COLS, _DEG = 60, 120, 3.0
_CELLS = f"(SELECT p_partkey * 7 % {_ROWS} AS row, p_partkey * 11 % {_COLS} AS col, max(p_partkey) AS k FROM part GROUP BY ALL)"


def _cells(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    held = read(s, d, "part").groupBy((k * 7 % _ROWS).cast("int").alias("row"), (k * 11 % _COLS).cast("int").alias("col")).agg(F.max("p_partkey").alias("k"))
    return held.select("row", "col", (F.col("k") % 31).cast("int").alias("code"), F.array(*(((F.col("k") * (m + 3)) % 4 * ((F.col("k") + 13 * m) % 60)).cast("int") for m in range(12))).alias("m"))


_ROW_SQL = f"greatest(0, least({_ROWS - 1}, floor((90 - {_LAT}) / {_DEG})::INT))"
_sql("class_lookup", lambda s, d: spatial.class_at(points(s, d), _cells(s, d), _DEG, _ROWS, _COLS).select("s_suppkey", "row", "col", "code"),
     f"SELECT s_suppkey, p.row, p.col, coalesce(k % 31, 0)::INT AS code FROM (SELECT s_suppkey, {_ROW_SQL} AS row, greatest(0, least({_COLS - 1}, floor(({_LON} + 180) / {_DEG})::INT)) AS col FROM supplier) p LEFT JOIN {_CELLS} c ON p.row = c.row AND p.col = c.col")


def _ring(s: SparkSession, d: str) -> DataFrame:
    found = spatial.nearest_ring(points(s, d), spatial.tiles(_cells(s, d), _ROWS, _COLS), "s_suppkey", _DEG, _ROWS, _COLS)
    return found.select("s_suppkey", "ring", "cells", *(F.round(F.get("ndvi", F.lit(m)), 9).alias(f"m{m}") for m in (0, 5, 11)))


_MONTH = "(k * ({0} + 3)) % 4 * ((k + 13 * {0}) % 60)"
_sql("raster_ring_lookup", _ring, f"""
WITH p AS (SELECT s_suppkey, {_ROW_SQL} AS r, floor(({_LON} + 180) / {_DEG})::INT % {_COLS} AS c FROM supplier),
a AS (SELECT s_suppkey, r + dr AS row, (c + dc + {_COLS}) % {_COLS} AS col, greatest(abs(dr), abs(dc)) AS ring FROM p, (SELECT unnest(range(-3, 4)) AS dr) x, (SELECT unnest(range(-3, 4)) AS dc) y WHERE r + dr BETWEEN 0 AND {_ROWS - 1}),
f AS (SELECT a.*, k FROM a JOIN {_CELLS} c ON a.row = c.row AND a.col = c.col WHERE {_MONTH.format(0)} <> 0),
b AS (SELECT s_suppkey, ring, count(*) AS cells, {', '.join(f'round((avg({_MONTH.format(m)}) - 1) / 254, 9) AS m{m}' for m in (0, 5, 11))}, row_number() OVER (PARTITION BY s_suppkey ORDER BY ring) AS first FROM f GROUP BY s_suppkey, ring)
SELECT p.s_suppkey, ring::INT AS ring, cells, m0, m5, m11 FROM p LEFT JOIN (SELECT * FROM b WHERE first = 1) b USING (s_suppkey)""")


def _grid(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(s, d, "nation").select("n_nationkey", (k * 7 % 160 - 80).cast("double").alias("lat"), (k * 29 % 360 - 179.5).cast("double").alias("lon"))


_GRID = "(SELECT n_nationkey, (n_nationkey * 7 % 160 - 80)::DOUBLE AS glat, (n_nationkey * 29 % 360 - 179.5)::DOUBLE AS glon FROM nation)"
_R = 2000.0
_NEAR = f"""
WITH st AS (SELECT s_suppkey, s_acctbal AS value, {_LAT} AS lat, {_LON} AS lon FROM supplier),
g AS (SELECT *, greatest(0.05::DOUBLE, cos(radians(glat))) AS c FROM {_GRID}),
w AS (SELECT *, floor((glon - least(180, {_R} / (111.195::DOUBLE * c)) + 180) / 2)::INT AS x0 FROM g),
m AS (SELECT w.*, st.*, CASE WHEN lon - glon > 180 THEN lon - glon - 360 WHEN lon - glon < -180 THEN lon - glon + 360 ELSE lon - glon END AS dl FROM w, st),
dist AS (SELECT n_nationkey, s_suppkey, value, dl * c * 111.195::DOUBLE * (dl * c * 111.195::DOUBLE) + (lat - glat) * 111.195::DOUBLE * ((lat - glat) * 111.195::DOUBLE) AS d2,
  greatest(0, least(90, floor((lat + 90) / 2)::INT)) AS iy, (greatest(0, least(179, floor((lon + 180) / 2)::INT)) - x0 + 360) % 180 AS bc FROM m),
near AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY d2, iy, bc, s_suppkey) AS place FROM dist WHERE d2 <= {_R} * {_R} QUALIFY place <= 8)"""
_sql("nearest_stations", lambda s, d: spatial.nearest_stations(_grid(s, d), points(s, d), "n_nationkey", "s_suppkey", "s_acctbal", radius_km=_R).select("n_nationkey", "s_suppkey", F.round("d2", 3).alias("d2"), F.col("place").cast("long").alias("place")), f"{_NEAR} SELECT n_nationkey, s_suppkey, round(d2, 3) AS d2, place FROM near")
_sql("idw_surface", lambda s, d: spatial.surface(_grid(s, d), points(s, d), "n_nationkey", "s_suppkey", "s_acctbal", radius_km=_R).select("n_nationkey", "used", *(F.round(c, 5).alias(c) for c in ("estimate", "km", "fade"))),
     f"{_NEAR} SELECT n_nationkey, count(*) AS used, round(sum(value / (d2 + 225)) / sum(1 / (d2 + 225)), 5) AS estimate, round(sqrt(min(d2)), 5) AS km, round(greatest(0, least(1, ({_R} - sqrt(min(d2))) / {_R / 2})), 5) AS fade FROM near GROUP BY n_nationkey")


def _land(s: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    x, y = (k * 60 - 150).cast("double"), (k * 20 - 60).cast("double")
    return read(s, d, "region").select(k.alias("ring"), F.array(x, x + 50.0, x + 40.0, x + 5.0).alias("x"), F.array(y, y + 4.0, y + 35.0, y + 28.0).alias("y"))


_sql("land_mask", lambda s, d: spatial.inside(points(s, d), _land(s, d), "s_suppkey"), f"""
WITH v AS (SELECT r_regionkey AS k, unnest([0, 50, 40, 5]) + r_regionkey * 60 - 150 AS x1, unnest([0, 4, 35, 28]) + r_regionkey * 20 - 60 AS y1, unnest([50, 40, 5, 0]) + r_regionkey * 60 - 150 AS x2, unnest([4, 35, 28, 0]) + r_regionkey * 20 - 60 AS y2 FROM region),
p AS (SELECT s_suppkey, {_LAT} AS lat, {_LON} AS lon FROM supplier)
SELECT s_suppkey FROM p, v WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1)::DOUBLE * (lat - y1) / (y2 - y1) + x1 GROUP BY s_suppkey HAVING count(*) % 2 = 1""")


def _climatology(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = read(s, d, "part").select((2000 + k % 3).alias("year"), (1 + k % 11).cast("int").alias("month"), (k * 7 % 40).alias("row"), (k * 3 % 80).alias("col"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 64.0).alias("value"))
    return spatial.climatology(cells, 10).select("row", "col", F.array_join(F.transform("m", lambda v: v.cast("string")), ",").alias("codes"))


_sql("ndvi_climatology", _climatology, """
WITH c AS (SELECT 2000 + p_partkey % 3 AS y, 1 + p_partkey % 11 AS mo, floor((p_partkey * 7 % 40) / 10)::INT AS row, floor((p_partkey * 3 % 80) / 10)::INT AS col, CASE WHEN p_size % 4 <> 0 THEN p_size / 64.0::DOUBLE END AS v FROM part),
b AS (SELECT mo, row, col, avg(CASE WHEN v IS NOT NULL THEN greatest(0, least(1, v)) END) AS v, count(v) / count(*) AS land FROM c GROUP BY ALL), m AS (SELECT row, col, mo, (1 + round_even(254 * v, 0))::INT AS code FROM b WHERE land > 0.02),
f AS (SELECT row, col, round_even(avg(code), 0)::INT AS mean FROM m GROUP BY ALL)
SELECT f.row, f.col, string_agg(coalesce(code, mean)::VARCHAR, ',' ORDER BY t.mo) AS codes
FROM f CROSS JOIN (SELECT unnest(range(1, 13)) AS mo) t LEFT JOIN m ON m.row = f.row AND m.col = f.col AND m.mo = t.mo GROUP BY f.row, f.col""")


def _vegetation(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ndvi = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: ((k * 17 + m * (k % 13) * 3) % 80) / 100.0)
    temp = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.when((k + m) % 9 != 0, ((k + m * 4) % 30).cast("double")))
    rows = read(s, d, "customer").select("c_custkey", ndvi.alias("ndvi"), temp.alias("temp"))
    made = scalar.vegetation(F.col("ndvi"), F.col("temp"))
    return rows.select("c_custkey", F.round(made["vegetation"], 9).alias("vegetation"), made["lush_months"].alias("lush_months"), F.round(made["mean_ndvi"], 9).alias("mean_ndvi"))


_sql("vegetation_score", _vegetation, """
WITH r AS (SELECT c_custkey AS k, list_transform(range(12), lambda m: CASE WHEN (c_custkey + m) % 9 <> 0 AND (c_custkey + m * 4) % 30 < 5 THEN 0 ELSE ((c_custkey * 17 + m * (c_custkey % 13) * 3) % 80) / 100.0::DOUBLE END) AS a FROM customer),
x AS (SELECT k, a, unnest(range(24)) AS i FROM r), f AS (SELECT k, a, i, a[i % 12 + 1] >= 0.45::DOUBLE AS lush FROM x),
g AS (SELECT k, i - row_number() OVER (PARTITION BY k ORDER BY i) AS island FROM f WHERE lush), l AS (SELECT k, max(n) AS n FROM (SELECT k, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY k),
s AS (SELECT r.k, least(coalesce(n, 0), 12)::INT AS run, list_sum(a) / 12 AS mean FROM r LEFT JOIN l USING (k)),
t AS (SELECT *, CASE WHEN run <= 3 OR run >= 9 THEN 0 WHEN run <= 6 THEN (run - 3) / 3 ELSE (9 - run) / 3 END AS relief, greatest(0, least(1, (mean - 0.1::DOUBLE) / (0.7::DOUBLE - 0.1::DOUBLE))) AS base FROM s)
SELECT k AS c_custkey, round(1 - (1 - base) * (1 - 0.5::DOUBLE * relief), 9) AS vegetation, run AS lush_months, round(mean, 9) AS mean_ndvi FROM t""")
_sql("vegetation_from_rain", lambda s, d: read(s, d, "customer").select("c_custkey", F.round(scalar.vegetation_from_rain(F.col("c_acctbal") / 5.0), 9).alias("v")), "SELECT c_custkey, round(greatest(0, least(1, (c_acctbal / 5 - 125) / 875)), 9) AS v FROM customer")
_sql("season_relief", lambda s, d: read(s, d, "nation").select("n_nationkey", F.round(scalar.season_relief(F.col("n_nationkey") % 13), 9).alias("relief")), "SELECT n_nationkey, round(CASE WHEN n_nationkey % 13 <= 3 OR n_nationkey % 13 >= 9 THEN 0 WHEN n_nationkey % 13 <= 6 THEN (n_nationkey % 13 - 3) / 3 ELSE (9 - n_nationkey % 13) / 3 END, 9) AS relief FROM nation")

"""Queries over raw report lines and dimension rows, spelled from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan.functions import reports
from heliospan.operators import compose, hours
from heliospan.plans.synthetic import read
from heliospan.sources import files, outputs

#: Tokens of the made-up remarks.
WEATHER = ("-RA", "TSRA", "VCSH", "BLSN", "+FZRA", "SHRASN", "BR", "HZ")
SKY = ("CLR", "CAVOK", "VV002", "BKN010CB", "FEW020 OVC080", "SCT030", "///", "NSC1")


def _rounded(x: Column) -> Column:
    """x to the nearest whole number, halves away from 0, as ``round`` gives it by way of decimal text."""
    whole = x.cast("int")
    return whole + F.when(x - whole >= 0.5, 1).when(x - whole <= -0.5, -1).otherwise(0)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw line for each lineitem: no (its key columns), station, file_year, line."""
    percent = lambda c: _rounded(F.col(c) * 100)
    items = read(spark, sf_dir, "lineitem").withColumns({"dc": percent("l_discount"), "tx": percent("l_tax"), "whole": F.col("l_quantity").cast("int")})
    ok, ln, q, dc, tx = (F.col(c) for c in ("l_orderkey", "l_linenumber", "whole", "dc", "tx"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    signed = lambda c: F.concat(F.when(c < 0, "-").otherwise("+"), pad(F.abs(c), 4))
    temp = (q - 20) * 10
    kind = F.when(F.col("l_returnflag") == "R", "FM-16").when(F.col("l_returnflag") == "A", "FM-15").otherwise(F.when(ln == 1, "SOD  ").otherwise("FM-12"))
    head = F.concat(
        pad(ok, 15), F.date_format("l_shipdate", "yyyyMMdd"), pad((ok * 7 + ln) % 24, 2), F.lit("00"), F.lit("0" * 14), kind, F.lit("0" * 19), F.when(ln == 3, "9999").otherwise(pad(q * 10, 4)),
        F.lit("0" * 18), F.when(ln == 5, "+9999").otherwise(signed(temp)), F.lit("1"), F.when(ln == 6, "+9999").otherwise(signed(temp - 50 - dc * 10)), F.lit("1"), F.lit("0" * 6),
    )
    rain = F.when(ln % 2 == 0, F.concat(F.lit("AA101"), pad(dc * 3, 4), F.lit("91"))).otherwise("")
    more = F.when(ln % 3 == 0, F.concat(F.lit("AA206"), pad(dc * 7, 4), F.lit("91AA303"), F.when(tx == 0, "9999").otherwise(pad(tx * 5, 4)), F.lit("91"))).otherwise("")
    sky = F.when(ln % 4 == 1, F.concat(F.lit("GA1"), pad(tx + dc % 3, 2), F.lit("1+003001061GA2"), pad(dc, 2), F.lit("1+006001061"))).otherwise("")
    now = F.when(ln % 5 == 2, F.concat(F.lit("MW1"), pad(dc * 9, 2), F.lit("1"))).when(ln % 5 == 4, F.concat(F.lit("AW1"), pad(dc * 6, 2), F.lit("1"))).otherwise("")
    at = (ok % 8).cast("int")
    report = F.when(ok % 3 != 0, F.concat(F.when(ok % 2 == 0, "METAR KAAA ").otherwise("SPECI KAAA "), F.get(F.array(*map(F.lit, WEATHER)), at), F.lit(" "), F.get(F.array(*map(F.lit, SKY)), ((ok + ln) % 8).cast("int")), F.lit(" RMK AO2 RA OVC001"))).otherwise("SYN042")
    remarks = F.concat(F.lit("REMMET050"), report)
    line = F.concat(F.col("front"), F.when(ln == 7, F.lit("")).otherwise(remarks))
    files.bounded_methods(spark)
    made = F.when(ln == 4, F.substring(line, 1, 100)).otherwise(line)
    # the front is a column of its own, as both branches spelled it and their fused method was larger than the JVM compiles
    fronts = items.withColumn("front", F.concat(head, rain, more, sky, now))
    held = fronts.select(ok.alias("no"), ln.alias("sub"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.array(made).alias("made"))
    # exploded, as a filter on a projected line would be pushed below it and spell the line anew for each of its conditions;
    # from a column of its own, as an unfused explode interprets what it is given; outer, as no filter on its size is made then
    return held.select("no", "sub", "part", "supp", F.explode_outer("made").alias("line"))


def _pad(x: str, n: int) -> str:
    return f"lpad(({x})::VARCHAR, {n}, '0')"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '+' END || {_pad(f'abs({x})', 4)})"


_T = "((floor(l_quantity)::INT - 20) * 10)"
_TOKENS = ["[" + ", ".join(f"'{x}'" for x in words) + "]" for words in (WEATHER, SKY)]
LINES_SQL = f"""
WITH n AS (SELECT *, round(l_discount * 100)::INT AS dc, round(l_tax * 100)::INT AS tx, l_linenumber AS ln, l_orderkey AS ok FROM lineitem),
made AS (SELECT ok AS no, ln AS sub, l_partkey AS part, l_suppkey AS supp, {_pad('ok', 15)} || strftime(l_shipdate, '%Y%m%d') || {_pad('(ok * 7 + ln) % 24', 2)} || '00' || '{"0" * 14}'
  || CASE WHEN l_returnflag = 'R' THEN 'FM-16' WHEN l_returnflag = 'A' THEN 'FM-15' WHEN ln = 1 THEN 'SOD  ' ELSE 'FM-12' END || '{"0" * 19}' || CASE WHEN ln = 3 THEN '9999' ELSE {_pad('floor(l_quantity)::INT * 10', 4)} END
  || '{"0" * 18}' || CASE WHEN ln = 5 THEN '+9999' ELSE {_signed(_T)} END || '1' || CASE WHEN ln = 6 THEN '+9999' ELSE {_signed(f'({_T} - 50 - dc * 10)')} END || '1' || '{"0" * 6}'
  || CASE WHEN ln % 2 = 0 THEN 'AA101' || {_pad('dc * 3', 4)} || '91' ELSE '' END
  || CASE WHEN ln % 3 = 0 THEN 'AA206' || {_pad('dc * 7', 4)} || '91AA303' || CASE WHEN tx = 0 THEN '9999' ELSE {_pad('tx * 5', 4)} END || '91' ELSE '' END
  || CASE WHEN ln % 4 = 1 THEN 'GA1' || {_pad('tx + dc % 3', 2)} || '1+003001061GA2' || {_pad('dc', 2)} || '1+006001061' ELSE '' END
  || CASE WHEN ln % 5 = 2 THEN 'MW1' || {_pad('dc * 9', 2)} || '1' WHEN ln % 5 = 4 THEN 'AW1' || {_pad('dc * 6', 2)} || '1' ELSE '' END
  || CASE WHEN ln = 7 THEN '' ELSE 'REMMET050' || CASE WHEN ok % 3 <> 0 THEN CASE WHEN ok % 2 = 0 THEN 'METAR KAAA ' ELSE 'SPECI KAAA ' END || {_TOKENS[0]}[ok % 8 + 1] || ' ' || {_TOKENS[1]}[(ok + ln) % 8 + 1] || ' RMK AO2 RA OVC001' ELSE 'SYN042' END END AS whole FROM n),
lines AS (SELECT no, sub, part, supp, CASE WHEN sub = 4 THEN substr(whole, 1, 100) ELSE whole END AS line FROM made),
kept AS (SELECT * FROM lines WHERE length(line) >= 105 AND trim(substr(line, 42, 5)) NOT IN ('SOD', 'SOM', 'SOY')),
cut AS (SELECT *, CASE WHEN instr(substr(line, 106), 'REM') > 0 THEN substr(line, 106, instr(substr(line, 106), 'REM') - 1) ELSE substr(line, 106) END AS g,
  CASE WHEN instr(substr(line, 106), 'REM') > 0 THEN substr(line, 105 + instr(substr(line, 106), 'REM')) ELSE '' END AS rem FROM kept),
bodies AS (SELECT *, CASE WHEN instr(rem, 'METAR ') > 0 THEN substr(rem, instr(rem, 'METAR ') + 6) WHEN instr(rem, 'SPECI ') > 0 THEN substr(rem, instr(rem, 'SPECI ') + 6) END AS b0 FROM cut),
parts AS (SELECT *, CASE WHEN instr(b0, ' RMK') > 0 THEN substr(b0, 1, instr(b0, ' RMK') - 1) ELSE b0 END AS body,
  list_zip(regexp_extract_all(g, 'AA\\d(\\d{{2}})(\\d{{4}})\\d\\d', 1), regexp_extract_all(g, 'AA\\d(\\d{{2}})(\\d{{4}})\\d\\d', 2)) AS aa FROM bodies),
tokens AS (SELECT *, string_split_regex(body, '\\s+') AS tok, list_filter(aa, lambda p: p[2] <> '9999') AS known, list_transform(regexp_extract_all(g, 'MW\\d(\\d{{2}})\\d', 1), lambda c: c::INT) AS mw,
  list_transform(regexp_extract_all(g, 'AW\\d(\\d{{2}})\\d', 1), lambda c: c::INT) AS aw, list_filter(list_transform(regexp_extract_all(g, 'GA\\d(\\d{{2}})\\d[+-]\\d{{5}}\\d\\d{{2}}\\d', 1), lambda c: c::INT), lambda c: c NOT IN (99, 10)) AS ga FROM parts),
facts AS (SELECT *, list_max(list_transform(ga, lambda c: CASE WHEN c = 9 THEN 100 ELSE c / 8 * 100 END)) AS ga_cloud,
  CASE WHEN len(list_filter(mw, lambda c: c >= 50)) + len(list_filter(aw, lambda c: c >= 40)) > 0 THEN true
    WHEN len(list_filter(mw, lambda c: c < 20 OR c = 28 OR (c >= 30 AND c < 50))) + len(list_filter(aw, lambda c: c < 20 OR c = 28 OR (c >= 30 AND c < 40))) > 0 THEN false END AS codes,
  len(list_filter(tok, lambda t: regexp_full_match(t, '[+-]?(SH|TS|FZ)*(DZ|RA|SN|SG|IC|PL|GR|GS|UP)+'))) > 0 AS wet,
  list_max(list_transform(tok, lambda t: CASE WHEN regexp_matches(t, '^VV\\d{{3}}') THEN 100 WHEN t IN ('CLR', 'SKC', 'NSC', 'NCD', 'CAVOK') THEN 0 WHEN regexp_matches(t, '^FEW\\d{{3}}') THEN 25 WHEN regexp_matches(t, '^SCT\\d{{3}}') THEN 50
    WHEN regexp_matches(t, '^BKN\\d{{3}}') THEN 75 WHEN regexp_matches(t, '^OVC\\d{{3}}') THEN 100 END)) AS metar_cloud,
  list_sort(list_transform(list_filter(known, lambda p: p[1] IN ('03', '06', '12', '24')), lambda p: p[1] || p[2])) AS longer FROM tokens),
parsed AS (SELECT no, sub, part, supp, strptime(substr(line, 16, 8), '%Y%m%d')::DATE AS utc_date, substr(line, 24, 2)::INT AS utc_hour, trim(substr(line, 42, 5)) AS report_type,
  nullif(substr(line, 66, 4), '9999')::INT / 10 AS wind_mps, nullif(substr(line, 88, 5), '+9999')::INT / 10 AS temp_c, nullif(substr(line, 94, 5), '+9999')::INT / 10 AS dew_c,
  list_filter(known, lambda p: p[1] = '01')[-1][2]::INT / 10 AS precip_mm, substr(longer[1], 1, 2)::INT AS acc_period, substr(longer[1], 3)::INT / 10 AS acc_depth, codes, wet, ga_cloud::DOUBLE AS ga_cloud, metar_cloud::DOUBLE AS metar_cloud, body,
  coalesce(ga_cloud, metar_cloud)::DOUBLE AS cloud_pct, CASE WHEN codes THEN true WHEN wet THEN true WHEN codes IS NOT NULL THEN codes WHEN wet IS NOT NULL THEN false END AS wx_wet FROM facts)
"""

_KEY = ("no", "sub", "part", "supp")
QUERIES, ORACLES = {}, {}


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return files.parse(lines(s, d))


def _from(make, columns: str):
    names = columns.split()

    def run(s: SparkSession, d: str) -> DataFrame:
        kept = lines(s, d).where(F.length("line") >= reports.MANDATORY)
        kept = kept.where(~F.trim(reports.field(F.col("line"), 41, 46)).isin(*reports.SUMMARIES))
        return make(kept).select(*_KEY, *names)

    return run


def _parts(**made):
    """Columns over the sections of a line."""
    return lambda df: reports.with_sections(df).withColumns({n: f(F.col(f"__{c}")) for n, (c, f) in made.items()}).withColumnsRenamed({f"__{c}": c for c in ("body", "codes", "wet")})


for _name, _make, _columns in (
    ("parse_lines", reports.parsed, "utc_date utc_hour report_type wind_mps temp_c dew_c precip_mm acc_period acc_depth cloud_pct wx_wet"),
    ("parse_mandatory", lambda df: df.withColumns(reports.mandatory(F.col("line"))), "utc_date utc_hour report_type wind_mps temp_c dew_c"),
    ("parse_precip_groups", lambda df: reports.with_sections(df).withColumns(reports.precipitation()), "precip_mm acc_period acc_depth"),
    ("parse_cloud_groups", _parts(ga_cloud=("sky", reports.sky_cover)), "ga_cloud"),
    ("present_weather", _parts(), "codes"),
    ("metar_body", _parts(), "body"),
    ("wet_tokens", _parts(), "wet"),
    ("metar_cloud", _parts(metar_cloud=("body", reports.metar_cloud)), "metar_cloud"),
):
    QUERIES[_name] = _from(_make, _columns)
    ORACLES[_name] = f"{LINES_SQL} SELECT no, sub, part, supp, {', '.join(_columns.split())} FROM parsed"


def _sql(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _file_names(s: SparkSession, d: str) -> DataFrame:
    """Paths of made-up station-year files; some names do not match."""
    name = F.concat(F.lpad((F.col("o_custkey") % 40).cast("string"), 6, "0"), F.lit("-"), F.lpad((F.col("o_custkey") % 3).cast("string"), 5, "0"), F.lit("-"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 11 == 0, ".txt").otherwise(".gz"))
    return read(s, d, "orders").select(F.concat(F.lit("isd-raw/"), F.year("o_orderdate").cast("string"), F.lit("/"), name).alias("path")).distinct()


def _index(s: SparkSession, d: str) -> DataFrame:
    found = files.station_index(_file_names(s, d).withColumns(files.name_parts(F.col("path"))).where("known"))
    return found.select("station", F.array_join(F.transform("files", lambda x: x["file_year"].cast("string")), ",").alias("years"), F.size("files").cast("long").alias("n"))


_sql("station_index", _index, r"""
WITH f AS (SELECT DISTINCT lpad((o_custkey % 40)::VARCHAR, 6, '0') || '-' || lpad((o_custkey % 3)::VARCHAR, 5, '0') || '-' || year(o_orderdate) || CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.gz' END AS name FROM orders),
p AS (SELECT regexp_extract(name, '^(\d{6}-\d{5})-(\d{4})\.gz$', 1) AS station, regexp_extract(name, '^(\d{6}-\d{5})-(\d{4})\.gz$', 2)::INT AS y FROM f WHERE regexp_matches(name, '^\d{6}-\d{5}-\d{4}\.gz$'))
SELECT station, string_agg(y::VARCHAR, ',' ORDER BY y) AS years, count(*) AS n FROM p GROUP BY station""")


def _manifest_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(
        F.lpad((k % 60).cast("string"), 6, "0").alias("usaf"), F.lit("99999").alias("wban"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("name"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("ctry"),
        F.when(k % 7 == 0, "").when(k % 5 == 0, "+00.000").otherwise(F.concat((k % 90).cast("string"), F.lit(".500"))).alias("lat"), F.when(k % 5 == 0, "+000.000").otherwise(F.concat(F.lit("-"), (k % 180).cast("string"), F.lit(".250"))).alias("lon"),
        F.when(k % 4 == 0, "-0999.0").when(k % 9 == 0, "x").otherwise((k % 3000).cast("string")).alias("elev"), k.alias("row_no"),
    )


_MANIFEST = """WITH r AS (SELECT lpad((s_suppkey % 60)::VARCHAR, 6, '0') || '-99999' AS id, trim(s_name) AS name, 'C' || s_nationkey AS country, s_suppkey AS k,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 90 + 0.5 END::DOUBLE AS lat, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE -(s_suppkey % 180 + 0.25) END::DOUBLE AS lon,
  CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 3000 END::DOUBLE AS elevation FROM supplier)
SELECT id, arg_max(name, k) AS name, arg_max(country, k) AS country, arg_max(lat, k) AS lat, arg_max(lon, k) AS lon, arg_max(elevation, CASE WHEN elevation IS NOT NULL OR true THEN k END) FILTER (WHERE k = top) AS elevation
FROM (SELECT *, max(k) OVER (PARTITION BY id) AS top FROM r WHERE lat IS NOT NULL {0}) WHERE k = top GROUP BY id"""
_sql("manifest", lambda s, d: files.manifest(_manifest_rows(s, d)), _MANIFEST.format("AND NOT (lat = 0 AND lon = 0)"))
_sql("scoring_coordinates", lambda s, d: files.manifest(_manifest_rows(s, d), drop_origin=False).select("id", "lat", "lon"), f"SELECT id, lat, lon FROM ({_MANIFEST.format('')})")


def _countries(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.upper("n_name"), F.when(F.col("n_nationkey") % 3 == 0, " AND THE ISLE OF D'OR").when(F.col("n_nationkey") % 3 == 1, "-LES-BAINS (THE)").otherwise(""))
    return files.country_names(read(s, d, "nation").select(F.concat(F.rpad(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), 12, " "), name).alias("line")))


_sql("country_names", _countries, r"""
WITH n AS (SELECT 'N' || n_nationkey AS code, upper(n_name) || CASE n_nationkey % 3 WHEN 0 THEN ' AND THE ISLE OF D''OR' WHEN 1 THEN '-LES-BAINS (THE)' ELSE '' END AS name FROM nation),
w AS (SELECT code, list_transform(string_split(name, ' '), lambda x: list_reduce(list_concat([''], list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(x, i - 1, 1), '[A-Za-z]') THEN substr(x, i, 1) ELSE lower(substr(x, i, 1)) END)), lambda a, b: a || b)) AS ws FROM n)
SELECT code, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i > 1 AND x IN ('And', 'Of', 'The', 'On', 'Da', 'De') THEN lower(x) ELSE x END), ' ') AS country_name FROM w""")
_sql("cadence_by_user", lambda s, d: hours.cadence(read(s, d, "events").select(F.col("event_type").alias("station"), F.year("ts").alias("file_year"))).select("station", "lines", "days", F.round("obs_per_day", 9).alias("obs_per_day"), "accepted"),
     "SELECT event_type AS station, count(*) AS lines, 366::BIGINT AS days, round(count(*) / 366.0::DOUBLE, 9) AS obs_per_day, count(*) / 366.0::DOUBLE >= 7 AS accepted FROM events GROUP BY event_type")
_sql("incremental_anti", lambda s, d: outputs.to_process(read(s, d, "orders").select(F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("file_year")).distinct(), read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("file_year"))),
     "SELECT DISTINCT o_custkey AS station, year(o_orderdate)::INT AS file_year FROM orders EXCEPT SELECT o_custkey, year(o_orderdate)::INT FROM orders WHERE o_orderstatus = 'F'")
_sql("excluded_anti", lambda s, d: compose.without(read(s, d, "customer").select("c_custkey", "c_name"), read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]), "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_sql("published_semi", lambda s, d: compose.matched(read(s, d, "customer"), read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_nationkey"), "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_sql("union_years", lambda s, d: compose.merged_years(*(read(s, d, "orders").where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("y")) for x in ("F", "O"))), "SELECT DISTINCT o_custkey AS station, year(o_orderdate)::INT AS y FROM orders WHERE o_orderstatus IN ('F', 'O')")
_sql("run_counters", lambda s, d: compose.counters(read(s, d, "orders"), "o_orderstatus", "o_orderpriority"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
_sql("seeded_sample", lambda s, d: compose.sample(read(s, d, "customer").select("c_custkey"), "c_custkey", 50), "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || '|42'), c_custkey LIMIT 50)")
_sql("line_estimate", lambda s, d: read(s, d, "part").select("p_partkey", files.line_estimate((F.col("p_partkey") % 7).cast("double"), (F.col("p_size") % 5).cast("double"), F.col("p_retailprice")).alias("lines")), "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_size % 5 = 0 THEN 0 ELSE (p_size % 5)::DOUBLE / (p_partkey % 7) * p_retailprice END AS lines FROM part")
_sql("malformed_lines", lambda s, d: files.malformed(lines(s, d).withColumn("line", F.when(F.col("no") % 50 == 0, F.concat(F.substring("line", 1, 87), F.lit("+0x12"), F.substr("line", F.lit(93)))).otherwise(F.col("line")))).select("no", "sub", "part", "supp"), f"{LINES_SQL} SELECT no, sub, part, supp FROM lines WHERE length(line) >= 105 AND no % 50 = 0")


def _ndvi_names(s: SparkSession, d: str) -> DataFrame:
    """Names of made-up vegetation files; some do not match."""
    k = F.col("p_partkey")
    stamp = F.concat((1981 + k % 40).cast("string"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("01"))
    return read(s, d, "part").select(F.concat(F.when(k % 7 == 0, "x").otherwise(""), F.lit("veg_ndvi_avhrr.mod09ga_p90_5km_s0..0cm_"), stamp, F.lit(".."), stamp, F.lit("_v1.0.tif")).alias("name")).distinct()


_sql("ndvi_files", lambda s, d: files.ndvi_files(_ndvi_names(s, d), range(1990, 2011), range(4, 10)), """
SELECT DISTINCT 'veg_ndvi_avhrr.mod09ga_p90_5km_s0..0cm_' || t || '..' || t || '_v1.0.tif' AS name, y::INT AS year, m::INT AS month
FROM (SELECT *, y || lpad(m::VARCHAR, 2, '0') || '01' AS t FROM (SELECT 1981 + p_partkey % 40 AS y, 1 + p_partkey % 12 AS m FROM part WHERE p_partkey % 7 <> 0)) WHERE y BETWEEN 1990 AND 2010 AND m BETWEEN 4 AND 9""")


def _with_files(s: SparkSession, d: str) -> DataFrame:
    index = files.station_index(read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("file_year"), F.lit("x").alias("path")).distinct())
    return files.with_files(read(s, d, "customer").select(F.col("c_custkey").alias("station")), index).select("station", F.size("files").alias("n"))


_sql("ids_with_files", _with_files, "SELECT c_custkey AS station, coalesce(n, 0)::INT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON o_custkey = c_custkey")


def _misses(s: SparkSession, d: str) -> DataFrame:
    ids = read(s, d, "customer").select(F.col("c_custkey").alias("station"))
    derived = read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("station"))
    return outputs.publish_misses(ids, derived, read(s, d, "supplier").select(F.col("s_suppkey").alias("id")))


_sql("publish_misses", _misses, """
SELECT CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'without derived data' WHEN c_custkey NOT IN (SELECT s_suppkey FROM supplier) THEN 'without manifest match' ELSE 'published' END AS outcome, count(*) AS n
FROM customer GROUP BY 1""")

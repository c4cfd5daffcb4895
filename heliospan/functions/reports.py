"""Fields of a raw report line, as built-in column expressions over one string column.

The mandatory section has fixed positions (105 characters); coded groups follow, then remarks after ``REM``. Decode bytes
as ISO-8859-1 first, so that every byte is one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANDATORY = 105
#: Report kinds that are summaries, and the kind that is a routine synoptic special.
SUMMARIES = ("SOD", "SOM", "SOY")
SPECIAL = "FM-16"
#: The weather phenomena of a wet token, and what may stand before them.
_PHENOMENA = "DZ|RA|SN|SG|IC|PL|GR|GS|UP"
#: A whole token of the body: nothing but blanks around it.
_TOKEN = r"(?<!\S){0}(?!\S)"
WET_TOKEN = _TOKEN.format(rf"[+-]?(?:SH|TS|FZ)*(?:{_PHENOMENA})+")
CLEAR_TOKENS = ("CLR", "SKC", "NSC", "NCD", "CAVOK")
#: Oktas of METAR cover codes.
COVER = {"FEW": 2, "SCT": 4, "BKN": 6, "OVC": 8}
#: Hours of the accumulations that count.
PERIODS = (3, 6, 12, 24)


def field(line: Column, start: int, end: int) -> Column:
    """Characters start to end, counted from 0."""
    return F.substring(line, start + 1, end - start)


def tenths(text: Column, missing: str, strict: bool = False) -> Column:
    """A scaled number; null for the missing mark. Strict: other text that is no number fails the query, else null."""
    value = F.nullif(F.trim(text), F.lit(missing))
    return (value.cast("int") if strict else value.try_cast("int")) / 10.0


def spans(line: Column) -> dict[str, Column]:
    """The parts of the mandatory section that hold fields: a field's place is counted from the start of its text, so short texts are cut from once."""
    return {"__stamp": field(line, 15, 25), "__kind": field(line, 41, 46), "__values": field(line, 65, 98)}


def mandatory(line: Column, strict: bool = False) -> dict[str, Column]:
    return _fields(*spans(line).values(), strict)


def _fields(stamp: Column, kind: Column, values: Column, strict: bool) -> dict[str, Column]:
    """The mandatory fields from the columns of ``spans``."""
    hour = field(stamp, 8, 10)
    return {
        "utc_date": _date(stamp, strict),
        "utc_hour": hour.cast("int") if strict else hour.try_cast("int"),
        "report_type": F.trim(kind),
        "wind_mps": tenths(field(values, 0, 4), "9999", strict),
        "temp_c": tenths(field(values, 22, 27), "+9999", strict),
        "dew_c": tenths(field(values, 28, 33), "+9999", strict),
    }


def sections(line: Column) -> tuple[Column, Column]:
    """The coded groups and the remarks, split at the first REM after the mandatory section."""
    coded = F.substr(line, F.lit(MANDATORY + 1))
    groups = F.substring_index(coded, "REM", 1)  # all of it where there is no mark
    return groups, F.substr(coded, F.length(groups) + 1)


def _date(stamp: Column, strict: bool) -> Column:
    text = F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    return text.cast("date") if strict else text.try_cast("date")


def depths(groups: Column) -> Column:
    """Period and depth of every precipitation group whose depth is known, in their order: ' 010012 030000'; '' if there is none.

    One pattern for all periods: groups are AA and nine digits, so no two of them overlap.
    """
    found = F.regexp_extract_all(groups, F.lit(r"AA\d(\d\d(?!9999)\d{4})\d\d"), F.lit(1))
    return F.when(F.contains(groups, F.lit("AA")), F.concat(F.lit(" "), F.array_join(found, " "))).otherwise("")


def precipitation() -> dict[str, Column]:
    """precip_mm of the last one-hour group; acc_period and acc_depth of the shortest longer one. From ``depths`` in __depths."""
    known, number = F.col("__depths"), lambda text: F.substring(text, 1, 4).cast("int") / 10.0
    has = lambda n: F.contains(known, F.lit(f" {n:02d}"))
    first = lambda n: number(F.substr(known, F.locate(f" {n:02d}", known) + 3))
    return {
        "precip_mm": F.when(has(1), number(F.substring_index(known, " 01", -1))),
        "acc_period": F.coalesce(*(F.when(has(n), n) for n in PERIODS)),
        "acc_depth": F.coalesce(*(F.when(has(n), first(n)) for n in PERIODS)),
    }


def sky_code(groups: Column) -> Column:
    """The greatest code of the sky groups; codes 99 and 10 say nothing."""
    codes = F.regexp_extract_all(groups, F.lit(r"GA\d(\d{2})\d[+-]\d{5}\d\d{2}\d"), F.lit(1))
    # two digits each, so the greatest text is the greatest code, and a greater code is no less cover
    most = F.array_max(F.array_except(codes, F.array(F.lit("99"), F.lit("10")))).cast("int")
    return F.when(F.contains(groups, F.lit("GA")), most)


def sky_cover(code: Column) -> Column:
    """The cover of a sky code, in percent; 9 is all of the sky."""
    return F.when(code == 9, 100.0).otherwise(code / 8.0 * 100.0)


def weather_codes(groups: Column) -> Column:
    """True for a wet code (MW from 50, AW from 40), false for a dry one, null if the codes prove nothing (20 to 27 and 29)."""
    wet = groups.rlike(r"MW\d[5-9]\d\d|AW\d[4-9]\d\d")
    dry = groups.rlike(r"(?:MW\d(?:[01]\d|28|[34]\d)|AW\d(?:[01]\d|28|3\d))\d")
    return F.when(F.contains(groups, F.lit("MW")) | F.contains(groups, F.lit("AW")), F.when(wet, True).when(dry, False))


def metar_body(remarks: Column) -> Column:
    """What follows the first METAR, else SPECI mark in the remarks, up to its own remarks; null if there is none."""
    metar, speci = F.locate("METAR ", remarks), F.locate("SPECI ", remarks)
    body = F.when(metar > 0, F.substr(remarks, metar + 6)).when(speci > 0, F.substr(remarks, speci + 6))
    # up to the first mark of remarks, all of the rest where there is none
    return F.substring_index(body, " RMK", 1)


def metar_wet(body: Column) -> Column:
    return body.rlike(WET_TOKEN)


def metar_cloud(body: Column) -> Column:
    """The greatest cover of the body's tokens, in percent; 0 for a clear-sky token, null if no token says. A pattern runs only where its code stands."""
    has = lambda code: F.contains(body, F.lit(code))
    out = F.when((has("OVC") | has("VV")) & body.rlike(r"(?<!\S)(?:OVC|VV)\d{3}"), 100.0)
    for code in ("BKN", "SCT", "FEW"):
        out = out.when(has(code) & body.rlike(rf"(?<!\S){code}\d{{3}}"), COVER[code] / 8.0 * 100.0)
    return out.when(body.rlike(_TOKEN.format("(?:" + "|".join(CLEAR_TOKENS) + ")")), 0.0)


def with_sections(df: DataFrame, line: str = "line") -> DataFrame:
    """df with __groups, __body, __codes, __wet, __depths and __sky. Projected step by step: each is read more than once later, so the optimizer keeps the steps apart."""
    groups, remarks = sections(F.col(line))
    out = df.withColumns({"__groups": groups, "__remarks": remarks}).withColumn("__body", metar_body(F.col("__remarks"))).drop("__remarks")
    held = F.col("__groups")
    return out.withColumns({"__codes": weather_codes(held), "__wet": metar_wet(F.col("__body")), "__depths": depths(held), "__sky": sky_code(held)})


def parsed(df: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """df with all fields of the line; the METAR in the remarks fills what the groups leave open."""
    held = with_sections(df.withColumns(spans(F.col(line))), line)
    codes, wet = F.col("__codes"), F.col("__wet")
    return held.withColumns(
        {
            **_fields(F.col("__stamp"), F.col("__kind"), F.col("__values"), strict),
            **precipitation(),
            "cloud_pct": F.coalesce(sky_cover(F.col("__sky")), metar_cloud(F.col("__body"))),
            "wx_wet": F.when(codes, True).when(wet, True).when(codes.isNotNull(), codes).when(wet.isNotNull(), False),
        }
    ).drop("__groups", "__body", "__codes", "__wet", "__depths", "__sky", "__stamp", "__kind", "__values")

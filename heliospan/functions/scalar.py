"""Scalar column functions: scores, solar time, daylight, vegetation, display values. All are built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospan.functions.rules import CRITERIA, RULES, Rules


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def celsius_to_fahrenheit(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def mph_to_mps(v: Column) -> Column:
    return v * 0.44704


def mps_to_mph(v: Column) -> Column:
    return v * 2.23694


def inches_to_mm(v: Column) -> Column:
    return v * 25.4


def triangular(v: Column, bounds: tuple[float, float, float]) -> Column:
    """1 at the ideal, linear to 0 at both bounds, null for null."""
    low, ideal, high = bounds
    return F.when((v <= low) | (v >= high), 0.0).when(v < ideal, (v - low) / (ideal - low)).when(v > ideal, (high - v) / (high - ideal)).when(v.isNotNull(), 1.0)


def one_sided(v: Column, bounds: tuple[float, float]) -> Column:
    """1 up to the ideal, linear to 0 at the bound, null for null."""
    ideal, most = bounds
    return F.when(v >= most, 0.0).when(v <= ideal, 1.0).when(v.isNotNull(), (most - v) / (most - ideal))


def factor_scores(temp: Column, dew: Column, precip: Column, cloud: Column, rules: Rules = RULES) -> dict[str, Column]:
    return {"temp_score": triangular(temp, rules.temp), "dew_score": triangular(dew, rules.dew), "precip_score": one_sided(precip, rules.precip), "cloud_score": one_sided(cloud, rules.cloud)}


def utc_offset(lon: Column) -> Column:
    """Whole hours of local solar time: lon / 15, half to even, within 12; 0 where unknown."""
    # least and greatest skip nulls, so an unknown longitude is sorted out before
    known = lon.isNotNull() & ~F.isnan(lon)
    return F.when(known, F.greatest(F.lit(-12), F.least(F.lit(12), F.rint(lon / 15.0).cast("int")))).otherwise(0)


def abs_hour(day: Column, hour: Column, offset: Column) -> Column:
    return F.unix_date(day).cast("long") * 24 + hour + offset


def local_day(hours: Column) -> Column:
    return F.date_from_unix_date(F.floor(hours / 24).cast("int"))


def local_hour(hours: Column) -> Column:
    return F.pmod(hours, F.lit(24)).cast("int")


def half_day(lat: Column, day_of_year: Column, rules: Rules = RULES) -> Column:
    """Hours from sunrise to noon, 0 to 12; null where the latitude is unknown."""
    tilt = F.lit(math.radians(rules.tilt)) * F.sin(F.lit(2 * math.pi / 365.0) * (day_of_year - rules.equinox))
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(tilt)))
    return F.when(lat.isNotNull() & day_of_year.isNotNull(), F.degrees(F.acos(c)) / 15.0)


def daylight(half: Column, rules: Rules = RULES) -> tuple[Column, Column]:
    """First whole hour and end hour of daylight inside the civil window; the window itself where the latitude is unknown.
    half: ``half_day``, as a column of its own, as it is used twice."""
    start = F.coalesce(F.greatest(F.lit(rules.day_start), F.ceil(12 - half).cast("int")), F.lit(rules.day_start))
    return start, F.coalesce(F.least(F.lit(rules.day_end), F.floor(12 + half).cast("int")), F.lit(rules.day_end))


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def streak_weight(n: Column, rules: Rules = RULES) -> Column:
    return F.when(n < rules.streak_days, 0).when(n.isNotNull(), F.floor((n + 2) / 3)).cast("long")


def perfect_indoor_ratio(perfect: Column, indoor: Column) -> Column:
    return F.when(perfect + indoor == 0, 0.0).otherwise(F.try_divide(perfect - indoor, perfect + indoor))


def _ramp(v: Column, zero: float, full: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - zero) / (full - zero))))


def vegetation_from_rain(mm: Column, rules: Rules = RULES) -> Column:
    return F.when(mm.isNotNull(), _ramp(mm, rules.rain_zero, rules.rain_full))


def season_relief(run: Column, rules: Rules = RULES) -> Column:
    least, peak, most = rules.lush_run
    return F.when((run <= least) | (run >= most), 0.0).when(run <= peak, (run - least) / float(peak - least)).otherwise((most - run) / float(most - peak))


def longest_lush_run(ndvi: Column, rules: Rules = RULES) -> Column:
    """Longest run of lush months, around the year's end."""
    run = F.aggregate(
        F.concat(ndvi, ndvi),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, v: F.struct(
            F.when(v >= rules.ndvi_lush, s["run"] + 1).otherwise(0).alias("run"),
            F.greatest(s["best"], F.when(v >= rules.ndvi_lush, s["run"] + 1).otherwise(0)).alias("best"),
        ),
        lambda s: s["best"],
    )
    return F.when(F.forall(ndvi, lambda v: v >= rules.ndvi_lush), F.size(ndvi)).otherwise(run)


def vegetation(ndvi: Column, temp: Column | None = None, rules: Rules = RULES) -> dict[str, Column]:
    """Score, lush run and mean of 12 monthly values; months colder than the bound count as bare."""
    warm = ndvi if temp is None else F.zip_with(ndvi, temp, lambda v, t: F.when(t < rules.lush_temp, 0.0).otherwise(v))
    mean = F.aggregate(warm, F.lit(0.0), lambda a, v: a + v) / F.size(warm)
    run = longest_lush_run(warm, rules)
    bare = 1.0 - _ramp(mean, rules.ndvi_zero, rules.ndvi_full)
    return {"vegetation": 1.0 - bare * (1.0 - rules.relief * season_relief(run, rules)), "lush_months": run, "mean_ndvi": mean}


def least_coverage(coverage: dict[str, Column]) -> Column:
    """struct(value, rank, criterion) of the least covered criterion; ties in the order of CRITERIA."""
    return F.least(*(F.struct(coverage[c].alias("value"), F.lit(i).alias("rank"), F.lit(c).alias("criterion")) for i, c in enumerate(CRITERIA)))


def exclusion(coverage: dict[str, Column], valid_days: Column, days: Column, rules: Rules = RULES) -> dict[str, Column]:
    """kind, criterion, value and text of why a year is left out; all null if it counts."""
    worst, share = least_coverage(coverage), valid_days / days
    by_cover, by_days = worst["value"] < rules.min_fraction, share < rules.min_fraction
    percent = _formatted(F.when(by_cover, worst["value"]).otherwise(share) * 100, "#0")
    return {
        "excluded_kind": F.when(by_cover, "coverage").when(by_days, "days"),
        "excluded_criterion": F.when(by_cover, worst["criterion"]),
        "excluded_value": F.when(by_cover, worst["value"]).when(by_days, share),
        "excluded_reason": F.when(by_cover, F.concat(worst["criterion"], F.lit(" present for only "), percent, F.lit("% of observations"))).when(by_days, F.concat(F.lit("only "), percent, F.lit("% of days valid"))),
    }


def _formatted(v: Column, pattern: str) -> Column:
    return F.call_function("format_number", v, F.lit(pattern))


def rounded(v: Column, digits: int) -> Column:
    """Rounds the exact binary value half to even, as the published files do."""
    return _formatted(v, "#0." + "0" * digits if digits else "#0").cast("double")


def goodness(v: Column, least: Column, most: Column, higher_is_better: bool = True) -> Column:
    """Place of a value between the bounds, 0 to 1; null for null."""
    ratio = (v - least) / (most - least)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio if higher_is_better else 1 - ratio)))


def widened(least: Column, most: Column) -> tuple[Column, Column]:
    """Bounds of a scale; equal ones are moved apart by 1 each."""
    same = least == most
    return F.when(same, least - 1.0).otherwise(least), F.when(same, most + 1.0).otherwise(most)


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


#: Colour stops as (position, red, green, blue).
GOODNESS_STOPS = ((0.0, 217, 48, 37), (0.5, 251, 188, 5), (1.0, 0, 137, 190))
TEMP_STOPS = ((-20.0, 63, 81, 181), (0.0, 66, 165, 245), (12.0, 38, 198, 160), (22.0, 253, 216, 53), (30.0, 251, 140, 0), (40.0, 229, 57, 53))
NDVI_STOPS = ((0.0, 222, 200, 160), (0.1, 214, 190, 140), (0.3, 198, 208, 120), (0.5, 120, 180, 80), (0.7, 40, 140, 50), (0.9, 10, 95, 40))


def ramp_rgb(v: Column, stops: Sequence[tuple[float, int, int, int]], factor: float = 1.0) -> dict[str, Column]:
    """red, green, blue by linear interpolation between stops, clamped; factor darkens the rounded values."""
    x = F.greatest(F.lit(stops[0][0]), F.least(F.lit(stops[-1][0]), v))
    out = {}
    for k, name in enumerate(("red", "green", "blue"), 1):
        value = F.lit(float(stops[-1][k]))
        for lower, upper in reversed(list(zip(stops, stops[1:], strict=False))):
            value = F.when(x <= upper[0], lower[k] + (upper[k] - lower[k]) * ((x - lower[0]) / (upper[0] - lower[0]))).otherwise(value)
        out[name] = half_up(half_up(value) * factor) if factor != 1.0 else half_up(value)
    return out


def nice_step(width: Column, ticks: int) -> Column:
    """A tick step of 1, 2 or 5 times a power of ten for about so many divisions."""
    raw = F.when(width == 0, 1.0).otherwise(width) / float(ticks)
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / size
    return F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0) * size


def percent_text(share: Column, cutoff: float | None = None) -> Column:
    """Whole percent; shares under the cutoff are rounded down."""
    whole = half_up(share * 100)
    if cutoff is not None:
        whole = F.when(share < cutoff, F.floor(share * 100).cast("int")).otherwise(whole)
    return F.concat(whole.cast("string"), F.lit("%"))


def coverage_level(share: Column, least: float = RULES.min_fraction) -> Column:
    return F.when(share < least, "lo").when(share < 0.667, "mid").otherwise("hi")


def cadence_label(step: Column) -> Column:
    return F.when(step == 1, "Hourly").otherwise(F.concat(step.cast("string"), F.lit("-hour")))


def data_summary(step: Column, years: Column, samples: Column, coverage: Column) -> Column:
    """What a station's numbers rest on, as shown; parts that are unknown are left out."""
    spanned = F.concat(years.cast("string"), F.lit(" yrs"))
    text = F.when(samples.isNull(), F.concat(spanned, F.lit(" of data"))).otherwise(F.concat(cadence_label(step), F.lit(" data points spanning "), spanned, F.lit(" ("), F.format_number(samples, 0), F.lit(" samples)")))
    return F.when(coverage.isNull(), text).otherwise(F.concat(text, F.lit(" &middot; "), half_up(coverage * 100).cast("string"), F.lit("% of days usable")))


def mercator(lat: Column, lon: Column, size: Column | float = 256.0) -> tuple[Column, Column]:
    """World pixel coordinates of the web map projection."""
    s = F.sin(F.radians(lat))
    size = F.lit(size) if not isinstance(size, Column) else size
    return (lon + 180.0) / 360.0 * size, (0.5 - F.log((1.0 + s) / (1.0 - s)) / (4.0 * math.pi)) * size


def escaped(text: Column) -> Column:
    """HTML text with its five special characters escaped."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


#: Words that stay lower-case inside a country's name.
SMALL_WORDS = ("And", "Of", "The", "On", "Da", "De")


def title_name(name: Column) -> Column:
    """Capitals after every character that is no letter; small words lower-case unless first."""
    letters = F.split(F.lower(F.trim(name)), "")
    marked = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(True).alias("new")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(s["new"], F.upper(c)).otherwise(c)).alias("out"), (~c.rlike("[\\p{L}]")).alias("new")),
        lambda s: s["out"],
    )
    words = F.filter(F.split(marked, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), F.lower(w)).otherwise(w)), " ")


def grid_cell(lat: Column, lon: Column, degrees: float, rows: int, columns: int) -> tuple[Column, Column]:
    """Row from the north (clamped) and column from 180 W (wrapped) of a raster cell."""
    row = F.greatest(F.lit(0), F.least(F.lit(rows - 1), ((90.0 - lat) / degrees).cast("int")))
    return row, F.pmod(((lon + 180.0) / degrees).cast("int"), F.lit(columns))

"""Every number of the scoring rules in one place. Fixed values; pass another Rules to change them."""

from __future__ import annotations

from dataclasses import dataclass


def _f(fahrenheit: float) -> float:
    return (fahrenheit - 32) * 5 / 9


@dataclass(frozen=True)
class Rules:
    day_start: int = 7
    day_end: int = 21
    top_hours: int = 6
    perfect_hours: int = 4
    min_fill: float = 0.7
    min_fraction: float = 1 / 3
    min_years: int = 3
    target_days: float = 365.0
    wet_mm: float = 0.5
    evidence_hours: int = 12
    temp: tuple[float, float, float] = (_f(65), _f(75), _f(82))
    dew: tuple[float, float, float] = (_f(30), _f(50), _f(60))
    precip: tuple[float, float] = (0.0, 0.1)
    cloud: tuple[float, float] = (0.0, 50.0)
    indoor_cold: float = _f(20)
    indoor_hot: float = _f(95)
    indoor_dew: float = _f(68)
    indoor_cloud: float = 85.0
    indoor_precip: float = 0.2 * 25.4
    indoor_wind: float = 25 * 0.44704
    gloom_cloud: float = 80.0
    gloom_records: int = 6
    streak_days: int = 3
    ndvi_zero: float = 0.10
    ndvi_full: float = 0.70
    ndvi_lush: float = 0.45
    relief: float = 0.5
    lush_run: tuple[int, int, int] = (3, 6, 9)
    lush_temp: float = 5.0
    rain_zero: float = 125.0
    rain_full: float = 1000.0
    seasonal_months: int = 6
    seasonal_days: float = 10.0
    vegetation_weight: float = 0.5
    min_obs_per_day: float = 7.0
    tilt: float = 23.44
    equinox: int = 81


RULES = Rules()
#: The order in which ties between criteria are broken.
CRITERIA = ("temp_c", "dew_c", "precip_mm", "cloud_pct", "wind_mps")

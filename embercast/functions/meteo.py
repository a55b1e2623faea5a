"""Meteorological expressions (F7-F12). Division uses ``try_divide`` so that a
zero denominator gives NULL instead of an ANSI error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drought_index(precip) -> Column:
    """1 / (p + 1)."""
    return F.try_divide(F.lit(1.0), _c(precip) + 1)


def heat_index(temp, humidity) -> Column:
    """F8: t * (1 - h/100)."""
    return _c(temp) * (1 - _c(humidity) / 100)


def saturation_vapour_pressure(temp) -> Column:
    """es = 0.6108 * exp(17.27 t / (t + 237.3)), kPa."""
    t = _c(temp)
    return F.lit(0.6108) * F.exp(F.try_divide(F.lit(17.27) * t, t + 237.3))


def vapour_pressure_deficit(temp, humidity) -> Column:
    """es - es * h / 100."""
    es = saturation_vapour_pressure(temp)
    return es - es * (_c(humidity) / 100)


def thermal_amplitude(tmax, tmin) -> Column:
    """max - min."""
    return _c(tmax) - _c(tmin)


def wind_humidity_ratio(wind, humidity) -> Column:
    """v / (h + 1)."""
    return F.try_divide(_c(wind), _c(humidity) + 1)

"""Distances, winds and other small geophysical expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid.constants import EARTH_RADIUS_KM, YEAR_DAYS


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km."""
    dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    dlon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_from_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows from, degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def _vapour_pressure(celsius: Column) -> Column:
    return F.lit(6.112) * F.exp(F.lit(17.67) * celsius / (celsius + F.lit(243.5)))


def relative_humidity(temperature_k: Column, dewpoint_k: Column) -> Column:
    """Relative humidity (%) from temperature and dewpoint in kelvin."""
    zero_c = F.lit(273.15)
    return _vapour_pressure(dewpoint_k - zero_c) / _vapour_pressure(temperature_k - zero_c) * F.lit(100.0)


def cyclic_day(date: Column) -> tuple[Column, Column]:
    """(sine, cosine) of the day of year over a 365.25-day circle."""
    angle = F.lit(2.0) * F.pi() * F.dayofyear(date).cast("double") / F.lit(YEAR_DAYS)
    return F.sin(angle), F.cos(angle)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, the value otherwise."""
    d = c.cast("double")
    bad = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(~bad, c)


def portable_hash(key: Column, seed: str, digits: int = 8) -> Column:
    """Seeded non-negative BIGINT from the leading hex digits of an MD5.

    Any SQL engine can reproduce it, and it does not depend on partitioning.
    """
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")

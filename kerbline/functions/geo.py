"""Column functions on coordinates in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.vocab import EARTH_M, METRES_PER_DEGREE


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance, in the unit of the radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def metres_to_lat(metres: float) -> float:
    return metres / METRES_PER_DEGREE


def metres_to_lon(metres: float, at_lat: Column, floor: float = 0.1) -> Column:
    return F.lit(metres) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(at_lat)), F.lit(floor)))


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    sign = F.when(F.upper(hemisphere).isin("S", "W"), -1).otherwise(1)
    return sign * (degrees + minutes / 60 + seconds / 3600)

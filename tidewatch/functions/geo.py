"""Spherical geometry as Catalyst expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_NM = 1.852
FEATURE_KM_PER_DEGREE = 111.19


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres between two points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def implied_speed_kn(km: Column, seconds: Column) -> Column:
    """Knots needed for km in seconds; 0 where no time has passed."""
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(km / F.lit(KM_PER_NM) / (seconds / 3600.0))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a ring of (lat, lon) vertices, unrolled to one test an edge behind a box test."""
    if len(ring) < 3:
        return F.lit(False)
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    crossings = F.lit(0)
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if a != c:  # an edge along a parallel is never crossed
            crosses = ((F.lit(a) > lat) != (F.lit(c) > lat)) & (lon < F.lit(d - b) * (lat - a) / F.lit(c - a) + b)
            crossings = crossings + crosses.cast("int")
    return lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons)) & (crossings % 2 == 1)


def heading_delta(left: Column, right: Column) -> Column:
    """Degrees between two headings, 0 to 180."""
    return F.abs(F.pmod(left - right + 180, F.lit(360.0)) - 180)


def short_way(degrees: Column) -> Column:
    """A difference of longitudes taken the short way around, -180 to 180."""
    return F.when(degrees > 180, degrees - 360).when(degrees < -180, degrees + 360).otherwise(degrees)


def to_180(lon: Column) -> Column:
    """A longitude that may lie beyond the 180th meridian, brought back."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)

"""The zone registry: few fixed rings, unrolled into expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.geo import in_ring


def _box(south: float, north: float, west: float, east: float) -> list[tuple[float, float]]:
    return [(south, west), (south, east), (north, east), (north, west)]


# zone_id, kind, sensitive, ring of (lat, lon), name, in registry order.
ZONES = [
    ("singapore-strait", "chokepoint", True, _box(1.10, 1.30, 103.55, 104.10), "Singapore Strait"),
    ("malacca-strait", "chokepoint", True, [(1.20, 102.20), (1.20, 103.60), (3.20, 100.60), (3.20, 101.90)], "Strait of Malacca (approaches)"),
    ("singapore-anchorages", "port", False, _box(1.18, 1.28, 103.70, 104.00), "Singapore Port Anchorages"),
    ("phillip-channel", "chokepoint", True, _box(1.13, 1.22, 103.72, 103.92), "Phillip Channel"),
    ("south-china-sea", "protected", True, _box(4.0, 16.0, 109.0, 118.0), "South China Sea (central)"),
    ("us-la-longbeach", "port", False, _box(33.55, 33.80, -118.35, -118.05), "Los Angeles / Long Beach Approaches"),
    ("us-gulf-lease", "protected", True, _box(27.0, 29.5, -94.0, -89.0), "Gulf of Mexico (offshore lease blocks)"),
]
PRIORITY = sorted(range(len(ZONES)), key=lambda k: (not ZONES[k][2], k))


def zone_of(lat: Column, lon: Column, sensitive_only: bool = False) -> Column:
    """The first zone that holds a point: sensitive ones first, then registry order."""
    found = [F.when(in_ring(lat, lon, ZONES[k][3]), F.lit(ZONES[k][0])) for k in PRIORITY if ZONES[k][2] or not sensitive_only]
    return F.coalesce(*found)


def zones_of(lat: Column, lon: Column) -> Column:
    """All zones that hold a point, in registry order."""
    return F.array_compact(F.array(*[F.when(in_ring(lat, lon, z[3]), F.lit(z[0])) for z in ZONES]))


def in_kind(lat: Column, lon: Column, kind: str) -> Column:
    out = F.lit(False)
    for z in ZONES:
        if z[1] == kind:
            out = out | in_ring(lat, lon, z[3])
    return out


def holds_box(south: Column, north: Column, west: Column, east: Column, kind: str) -> Column:
    """Whether a box lies wholly within one zone of a kind that is itself a box; the mean of points in it then does, too."""
    out = F.lit(False)
    for z in ZONES:
        lats, lons = sorted({y for y, _ in z[3]}), sorted({x for _, x in z[3]})
        if z[1] == kind and len(z[3]) == 4 and len(lats) == len(lons) == 2 and len(set(z[3])) == 4:
            out = out | ((south > lats[0] + 1e-9) & (north < lats[1] - 1e-9) & (west > lons[0] + 1e-9) & (east < lons[1] - 1e-9))
    return out


def name_of(zone_id: Column) -> Column:
    """A zone's readable name; null outside the registry."""
    return F.try_element_at(F.create_map(*[F.lit(x) for z in ZONES for x in (z[0], z[4])]), zone_id)


def is_sensitive(zone_id: Column) -> Column:
    return F.coalesce(zone_id.isin([z[0] for z in ZONES if z[2]]), F.lit(False))


def table(spark: SparkSession) -> DataFrame:
    rows = [(z[0], z[4], z[1], int(z[2]), [list(p) for p in z[3]]) for z in ZONES]
    return spark.createDataFrame(rows, "zone_id string, name string, kind string, sensitive int, polygon array<array<double>>")

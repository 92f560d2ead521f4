"""Geometry on plain columns: lon and lat doubles, rings as arrays of [x, y]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlon, dlat = F.radians(lon2) - F.radians(lon1), F.radians(lat2) - F.radians(lat1)
    t = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(EARTH_KM * 2) * F.atan2(F.sqrt(t), F.sqrt(1 - t))


def in_bbox(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inclusive on all edges; plain comparisons, so that they reach the Parquet scan."""
    return lon.between(west, east) & lat.between(south, north)


def in_ring(lon: Column, lat: Column, ring: Column, inclusive: bool = False) -> Column:
    """Even-odd ray cast; rings under three points hold nothing. ``inclusive`` counts a point on a crossing."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))

    def crosses(a, b):
        run = F.when(b[1] - a[1] == 0, F.lit(1e-12)).otherwise(b[1] - a[1])
        x = (b[0] - a[0]) * (lat - a[1]) / run + a[0]
        return F.when(((a[1] > lat) != (b[1] > lat)) & ((lon <= x) if inclusive else (lon < x)), 1).otherwise(0)

    odd = F.aggregate(F.zip_with(before, ring, crosses), F.lit(0), lambda s, c: s + c) % 2 == 1
    return F.when(F.size(ring) >= 3, odd).otherwise(False)


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and in no other."""
    hole = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: in_ring(lon, lat, r))
    return F.when(F.size(rings) > 0, in_ring(lon, lat, F.get(rings, F.lit(0))) & ~hole).otherwise(False)


def in_multipolygon(lon: Column, lat: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda p: in_polygon(lon, lat, p))


def valid_point(lat: Column, lon: Column) -> Column:
    """[lon, lat] of lenient inputs, null out of range."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    return F.when(y.between(-90, 90) & x.between(-180, 180), F.array(x, y))


def wkt_number(v: Column) -> Column:
    """At most 12 significant digits, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", v), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), wkt_number(lon), F.lit(" "), wkt_number(lat), F.lit(")"))


def _rings_wkt(rings: Column) -> Column:
    """The rings of one polygon in brackets; null where none holds a point."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", wkt_number(p[0]), wkt_number(p[1]))), ", "), F.lit(")"))
    some = F.filter(rings, lambda r: F.size(r) > 0)
    return F.when(F.size(some) > 0, F.concat(F.lit("("), F.array_join(F.transform(some, ring), ", "), F.lit(")")))


def polygon_wkt(rings: Column) -> Column:
    return F.concat(F.lit("POLYGON "), _rings_wkt(rings))


def multipolygon_wkt(polygons: Column) -> Column:
    parts = F.array_compact(F.transform(polygons, _rings_wkt))
    return F.when(F.size(parts) > 0, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")")))


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    radius = 6378137.0
    return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - F.pi() / 2)


def coordinate(value: Column) -> Column:
    """Micro-degrees become degrees."""
    v = value.try_cast("double")
    return F.when(F.abs(v) > 1000, v / 1_000_000).otherwise(v)


def bbox_overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])

"""Planar and great-circle geometry on lat/lon columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in degrees, in [0, 360)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlon = F.radians(lon2 - lon1)
    x = F.sin(dlon) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(x, y)) + F.lit(360.0), F.lit(360.0))


def planar_length(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line length in degrees (used for pacing, not distance)."""
    return F.hypot(lat2 - lat1, lon2 - lon1)


def interpolate(a: Column, b: Column, t: Column) -> Column:
    """a + (b - a) * t."""
    return a + (b - a) * t


def covering_circle(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Centre and radius (nm) of a circle enclosing a lat/lon box.

    Radius is half the diagonal (1 degree = 60 nm, longitude scaled by the
    cosine of the centre latitude), truncated, plus 100, capped at 3000. A
    box covering the globe maps to (0, 0, 10000).
    """
    c_lat = (min_lat + max_lat) / F.lit(2.0)
    c_lon = (min_lon + max_lon) / F.lit(2.0)
    dlat = (max_lat - min_lat) / F.lit(2.0) * F.lit(60.0)
    dlon = (max_lon - min_lon) / F.lit(2.0) * F.lit(60.0) * F.cos(F.radians(c_lat))
    radius = F.least(F.floor(F.hypot(dlat, dlon)).cast("int") + F.lit(100), F.lit(3000))
    is_global = (min_lat <= -89) & (max_lat >= 89) & (min_lon <= -179) & (max_lon >= 179)
    return F.when(
        is_global,
        F.struct(F.lit(0.0).alias("center_lat"), F.lit(0.0).alias("center_lon"), F.lit(10000).alias("radius_nm")),
    ).otherwise(F.struct(c_lat.alias("center_lat"), c_lon.alias("center_lon"), radius.alias("radius_nm")))

"""Geodesy as column expressions: no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the sine term is clamped so that antipodes stay finite."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def turn(x: Column, full: float = 360.0) -> Column:
    """x modulo a full turn, never negative (the same formula in every engine)."""
    return x - full * F.floor(x / full)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return turn(F.degrees(F.atan2(y, x)))


def angle_between(a: Column, b: Column) -> Column:
    """Absolute difference of two directions, folded to [0, 180]."""
    return F.abs(turn(a - b + 180.0) - 180.0)


def within_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Closed box; boxes do not cross the antimeridian."""
    return lon.between(west, east) & lat.between(south, north)


def within_window(t: Column, start=None, end=None) -> Column:
    """Half-open [start, end); an end that is None is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (t >= F.lit(start))
    if end is not None:
        out = out & (t < F.lit(end))
    return out

"""Distances, time gaps, presentation grids and outlines as column maths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_METRES = 6_371_008.8
HEAT_CELL_DEGREES = 0.001
RING_SEGMENTS = 64


def valid_coordinate(latitude: Column, longitude: Column) -> Column:
    """Finite and in range; NaN and NULL are invalid (Spark orders NaN above every number)."""
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180), F.lit(False))


def haversine_metres(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance; NULL when a coordinate is missing or out of range."""
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat_a)) * F.cos(
        F.radians(lat_b)
    ) * F.sin(half_lon) * F.sin(half_lon)
    metres = 2 * EARTH_RADIUS_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    return F.when(valid_coordinate(lat_a, lon_a) & valid_coordinate(lat_b, lon_b), metres)


def temporal_gap_seconds(first: Column, second: Column) -> Column:
    return F.abs(F.unix_micros(first) - F.unix_micros(second)) / F.lit(1e6)


def within_time_window(first: Column, second: Column, max_days: float) -> Column:
    if not math.isfinite(max_days) or max_days <= 0:
        raise ValueError("max_days must be positive and finite")
    return temporal_gap_seconds(first, second) <= max_days * 86400


def quantize_cell(coordinate: Column) -> Column:
    """South-west corner of the heat cell, three decimals, never negative zero."""
    cell = F.round(F.floor(coordinate / HEAT_CELL_DEGREES) * F.lit(HEAT_CELL_DEGREES), 3)
    return F.when(cell == 0, F.lit(0.0)).otherwise(cell)


def radius_ring(latitude: Column, longitude: Column, radius: Column) -> Column:
    """ARRAY<STRUCT<lon, lat>>: one point for radius 0, else a closed 65-vertex circle, else NULL."""
    d = radius / F.lit(EARTH_RADIUS_METRES)
    phi, lam = F.radians(latitude), F.radians(longitude)

    def vertex(i: Column) -> Column:
        bearing = i / F.lit(float(RING_SEGMENTS)) * F.lit(2 * math.pi)
        lat = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(bearing))
        lon = lam + F.atan2(
            F.sin(bearing) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(lat)
        )
        return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))

    finite = (
        (F.abs(latitude) < math.inf)
        & (F.abs(longitude) < math.inf)
        & (radius < math.inf)
        & (radius >= 0)
    )
    point = F.array(F.struct(longitude.alias("lon"), latitude.alias("lat")))
    ring = F.transform(F.sequence(F.lit(0), F.lit(RING_SEGMENTS)), vertex)
    return F.when(finite, F.when(radius == 0, point).otherwise(ring))


def evidence_projection(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """STRUCT<xa, ya, xb, yb>: the pair scaled into a neutral 18..82 box."""
    lat_min, lon_min = F.least(lat_a, lat_b), F.least(lon_a, lon_b)
    lat_range = F.greatest(lat_a, lat_b) - lat_min
    lon_range = F.greatest(lon_a, lon_b) - lon_min
    same = (lat_range == 0) & (lon_range == 0)
    unit = lambda r: F.when(r == 0, F.lit(1.0)).otherwise(r)
    x = lambda lon: 18 + (lon - lon_min) / unit(lon_range) * 64
    y = lambda lat: 82 - (lat - lat_min) / unit(lat_range) * 64
    return F.struct(
        F.when(same, F.lit(28.0)).otherwise(x(lon_a)).alias("xa"),
        F.when(same, F.lit(50.0)).otherwise(y(lat_a)).alias("ya"),
        F.when(same, F.lit(72.0)).otherwise(x(lon_b)).alias("xb"),
        F.when(same, F.lit(50.0)).otherwise(y(lat_b)).alias("yb"),
    )

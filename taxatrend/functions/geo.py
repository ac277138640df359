"""Closed-form geodesy as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the Australian Albers equal-area projection (EPSG:3577).
A = 6378137.0
GRS80_F = 1 / 298.257222101
WGS84_F = 1 / 298.257223563
PARALLELS = (-18.0, -36.0)
ORIGIN = (0.0, 132.0)
METRES_PER_DEGREE = 111320


def _q(sin_phi: float, e: float) -> float:
    es = e * sin_phi
    return (1 - e * e) * (sin_phi / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * e))


def albers_constants() -> dict[str, float]:
    """Cone constant, C and origin radius of the projection (Snyder 1987, eqs 14-1 to 14-6)."""
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)
    s = [math.sin(math.radians(p)) for p in PARALLELS]
    m2 = [(1 - v * v) / (1 - e2 * v * v) for v in s]
    q = [_q(v, e) for v in s]
    n = (m2[0] - m2[1]) / (q[1] - q[0])
    c = m2[0] + n * q[0]
    return {"e": e, "e2": e2, "n": n, "c": c, "rho0": A * math.sqrt(c - n * _q(math.sin(math.radians(ORIGIN[0])), e)) / n}


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Projected x and y in metres."""
    k = albers_constants()
    e, n = F.lit(k["e"]), F.lit(k["n"])
    s = F.sin(F.radians(lat))
    es = e * s
    q = F.lit(1 - k["e2"]) * (s / (1 - es * es) - F.ln((1 - es) / (1 + es)) / F.lit(2 * k["e"]))
    rho = F.lit(A) * F.sqrt(F.lit(k["c"]) - n * q) / n
    theta = n * F.radians(lon - F.lit(ORIGIN[1]))
    return rho * F.sin(theta), F.lit(k["rho0"]) - rho * F.cos(theta)


def grid_square(lon: Column, lat: Column, size_m: int) -> Column:
    """Equal-area grid square as a struct, usable as one distinct key."""
    x, y = albers(lon, lat)
    return F.struct(
        F.floor(x / F.lit(float(size_m))).alias("gx"),
        F.floor(y / F.lit(float(size_m))).alias("gy"),
    )


def tenth_degree(x: Column) -> Column:
    """0.1 degree cell label as an exact decimal, halves away from zero."""
    return F.round(x.cast("decimal(18,10)"), 1).cast("decimal(4,1)")


def geodesic_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on WGS84 by the Andoyer-Lambert formula (first order in flattening)."""
    ra, rb = (F.atan(F.lit(1 - WGS84_F) * F.tan(F.radians(p))) for p in (lat1, lat2))
    half_dphi, half_dlam = (rb - ra) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dphi), 2) + F.cos(ra) * F.cos(rb) * F.pow(F.sin(half_dlam), 2)
    h = F.least(h, F.lit(1.0))
    sigma = 2 * F.asin(F.sqrt(h))
    p = F.pow(F.sin((ra + rb) / 2), 2) * F.pow(F.cos(half_dphi), 2)
    q = F.pow(F.cos((ra + rb) / 2), 2) * F.pow(F.sin(half_dphi), 2)
    # Both corrections vanish with the distance; the guards only avoid 0/0.
    x = F.try_divide((sigma - F.sin(sigma)) * p, F.pow(F.cos(sigma / 2), 2))
    y = F.try_divide((sigma + F.sin(sigma)) * q, F.pow(F.sin(sigma / 2), 2))
    d = sigma - F.lit(WGS84_F / 2) * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.when((lon1 == lon2) & (lat1 == lat2), F.lit(0.0)).otherwise(F.lit(A / 1000) * d)


def public_coordinates(lat: Column, lon: Column, digits: int = 2) -> Column:
    """Coordinates reduced for publication, with what was done to them."""
    k = 10**digits
    both = lat.isNotNull() & lon.isNotNull()
    reduced = [F.when(both, F.floor(c * k + F.lit(0.5)) / F.lit(float(k))) for c in (lat, lon)]
    return F.struct(
        reduced[0].alias("latitude"),
        reduced[1].alias("longitude"),
        both.alias("fuzzed"),
        F.when(both, F.lit(int(METRES_PER_DEGREE / k + 0.5))).alias("approx_metres"),
    )

"""Scalar expressions on columns: physics, units, geography."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth's rotation rate (1/s) and radius (km), the linear equation of state and gravity (km/s^2).
OMEGA, EARTH_KM = 7.2921e-5, 6371.0
ALPHA, BETA, RHO0, GRAVITY = 2e-4, 7.4e-4, 1025.0, 0.0098
KM_PER_DEGREE = 111.0


def coriolis(lat: Column) -> Column:
    return F.lit(2 * OMEGA) * F.sin(F.radians(lat))


def by_coriolis(value: Column, lat: Column, absolute: bool = False, null_on_equator: bool = True) -> Column:
    """value / f, or / |f|; on the equator null, or infinite (NaN for no value of any size)."""
    f = coriolis(lat)
    got = F.when(f != 0, value / (F.abs(f) if absolute else f))
    return got if null_on_equator else got.otherwise(value * F.lit(float("inf")))


def rossby(value: Column, lat: Column, lat_min: float = 5.0, f_min: float = 1e-5, absolute: bool = False) -> Column:
    """value / f (or |f|), null near the equator."""
    f = coriolis(lat)
    return F.when((F.abs(lat) >= lat_min) & (F.abs(f) >= f_min), value / (F.abs(f) if absolute else f))


def normalised(value: Column, lat: Column, absolute: bool = False) -> Column:
    """value / f, or / |f|; on the equator the value as it is."""
    return F.coalesce(by_coriolis(value, lat, absolute), value)


def is_land(*properties: str) -> Column:
    """Whether all properties of a cell are missing."""
    return reduce(and_, [F.col(c).isNull() | F.isnan(c) for c in properties])


def is_ocean(*squared: str) -> Column:
    """Whether all squared gradients of a cell are there and above 0."""
    return reduce(and_, [F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False)) for c in squared])


def turner_angle(b2: Column, s2: Column, t2: Column, r2: Column) -> Column:
    """Horizontal Turner angle in degrees from squared gradients; null where density has none."""
    return F.when(r2 > 0, F.degrees(F.atan(F.lit(RHO0) * (F.lit(BETA**2) * s2 - F.lit(ALPHA**2) * t2) / (-r2 / RHO0))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def to_counts(kelvin: Column, scale: float = 0.01, offset: float = 268.15, most: int = 10000) -> Column:
    """Kelvin as whole counts; null (the fill) where that is not above 0 or beyond the range."""
    n = F.bround((kelvin - offset) / scale, 0).cast("int")
    return F.when((n > 0) & (n <= most), n)


def from_counts(counts: Column, scale: float = 0.01, offset: float = 268.15, celsius: bool = True, fill: int = -32768) -> Column:
    """Whole counts as Celsius, or as Kelvin; null for the fill."""
    return F.when(counts != fill, counts * scale + (offset - (273.15 if celsius else 0.0)))


def solar_zenith(day: Column, hour: Column, minute: Column, lat: Column, lon: Column) -> Column:
    """Sun's zenith angle in whole degrees; above 90 is night."""
    turn = F.lit(2 * math.pi) * (day - 1 + (hour - 12) / 24) / 365
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(turn) - 0.032077 * F.sin(turn) - 0.014615 * F.cos(2 * turn) - 0.040849 * F.sin(2 * turn))
    decl = 0.006918 - 0.399912 * F.cos(turn) + 0.070257 * F.sin(turn) - 0.006758 * F.cos(2 * turn) + 0.000907 * F.sin(2 * turn)
    angle = F.radians((hour * 60 + minute + equation + 4 * lon) / 4 - 180)
    cosine = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(angle)
    return F.floor(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))).cast("int")


def density(temperature: Column, salinity: Column) -> Column:
    """Linear equation of state around 10 degrees and 35 psu."""
    return RHO0 * (1 - ALPHA * (temperature - 10) + BETA * (salinity - 35))


def buoyancy(rho: Column) -> Column:
    return F.lit(GRAVITY) * rho / RHO0


def flow_curvature(u: Column, v: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Radius of curvature of a streamline."""
    bend = u * u * vx - v * v * uy + u * v * (vy - ux)
    return F.when(bend != 0, F.pow(u * u + v * v, F.lit(1.5)) / bend)


def curvature_number(speed: Column, f: Column, radius: Column) -> Column:
    return F.when((f != 0) & (radius != -1), 2 * speed / f / (radius + 1))


def flow_measures(u: Column, v: Column, ux: Column, uy: Column, vx: Column, vy: Column, lat: Column, equator: float = 6.0) -> dict[str, Column]:
    """Of a velocity in m/s and its gradients per metre: radius of curvature (m), curvature per km, curvature number, kinetic energy,
    beta of the curvature, and vorticity and Rossby number; the number, vorticity and Rossby number are null within `equator` degrees."""
    speed, f, radius = F.hypot(u, v), coriolis(lat), flow_curvature(u, v, ux, uy, vx, vy)
    off = lambda c: F.when((lat < -equator) | (lat > equator), c)
    vorticity = vx - uy
    return {
        "radius": radius, "kappa": 1000 / F.nullif(radius, F.lit(0.0)), "curvature_number": off(curvature_number(speed, f, radius)), "kinetic_energy": (u * u + v * v) / 2,
        "beta_c": speed / F.nullif(radius * radius, F.lit(0.0)), "vorticity": off(vorticity), "rossby": off(vorticity / F.nullif(f, F.lit(0.0))),
    }

"""Map projections and their inverses as column functions: Mercator on the sphere and the ellipsoid, transverse Mercator.

Published series: conformal latitude by powers of the eccentricity, transverse Mercator by its expansion in the third
flattening n (to n^6, far below a millimetre within a zone). Coordinates are degrees and metres on WGS 84.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening of the ellipsoid. Fixed values.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
THIRD = FLATTENING / (2 - FLATTENING)
#: Scale on the central meridian, and false easting and northing of a zone of 6 degrees. Fixed values.
SCALE, EASTING, SOUTHERN = 0.9996, 500_000.0, 10_000_000.0
#: Codes of reference systems: longitude and latitude, spherical and ellipsoidal Mercator, zones from 1 north and south.
DEGREES, WEB_MERCATOR, WORLD_MERCATOR, NORTH, SOUTH = 4326, 3857, 3395, 32600, 32700

#: Coefficients of n, n^2, ... n^6 in the series of the transverse Mercator projection, forward and inverse. Fixed values.
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
_ALPHA, _BETA = ([sum(c * THIRD ** (i + 1) for i, c in enumerate(row)) for row in table] for table in (FORWARD, INVERSE))
#: Radius of the sphere whose meridian is as long as the ellipsoid's.
RECTIFYING = AXIS / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64 + THIRD**6 / 256)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def _conformal_tangent(sin: Column) -> Column:
    """Tangent of the conformal latitude from the sine of the geodetic one."""
    return F.sinh(_atanh(sin) - ECCENTRICITY * _atanh(ECCENTRICITY * sin))


def _latitude(tangent: Column) -> Column:
    """Geodetic latitude from the tangent of the conformal one, by Newton steps on the tangent."""

    def step(t: Column, _: Column) -> Column:
        def better(sigma: Column) -> Column:
            own = t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)
            slope = (F.sqrt((1 + own * own) * (1 + t * t))) * (1 - ECCENTRICITY**2) / (1 + (1 - ECCENTRICITY**2) * t * t)
            return t + (tangent - own) / slope

        return _let(F.sinh(ECCENTRICITY * _atanh(ECCENTRICITY * t / F.sqrt(1 + t * t))), better)

    start = tangent / (1 - ECCENTRICITY**2)
    return F.atan(F.aggregate(F.array(*[F.lit(i) for i in range(5)]), start, step))


def to_mercator(lon: Column, lat: Column, ellipsoid: bool = False) -> tuple[Column, Column]:
    phi = F.radians(lat)
    y = F.asinh(_conformal_tangent(F.sin(phi)) if ellipsoid else F.tan(phi))
    return AXIS * F.radians(lon), AXIS * y


def from_mercator(x: Column, y: Column, ellipsoid: bool = False) -> tuple[Column, Column]:
    tangent = F.sinh(y / AXIS)
    return F.degrees(x / AXIS), F.degrees(_latitude(tangent) if ellipsoid else F.atan(tangent))


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _series(at: Column, table: list[float], sign: int) -> Column:
    """(x, y) moved by the series of sines and hyperbolic sines of its multiples."""

    def moved(p: Column) -> Column:
        dx = sum((c * F.sin(2 * j * p["x"]) * F.cosh(2 * j * p["y"]) for j, c in enumerate(table, 1)), F.lit(0.0))
        dy = sum((c * F.cos(2 * j * p["x"]) * F.sinh(2 * j * p["y"]) for j, c in enumerate(table, 1)), F.lit(0.0))
        return _pair(p["x"] + sign * dx, p["y"] + sign * dy)

    return _let(at, moved)


def zone_of(lon: Column) -> Column:
    """Number of the zone of 6 degrees, 1 from 180 degrees west."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def to_zone(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone's transverse Mercator projection."""
    away = F.radians(lon) - F.radians(zone * 6.0 - 183)
    on_sphere = _let(_conformal_tangent(F.sin(F.radians(lat))), lambda t: _pair(F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))))
    plane = _series(on_sphere, _ALPHA, 1)
    return EASTING + SCALE * RECTIFYING * plane["y"], F.when(south, SOUTHERN).otherwise(0.0) + SCALE * RECTIFYING * plane["x"]


def from_zone(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    plane = _pair((y - F.when(south, SOUTHERN).otherwise(0.0)) / (SCALE * RECTIFYING), (x - EASTING) / (SCALE * RECTIFYING))

    def degrees(p: Column) -> Column:
        tangent = F.sin(p["x"]) / F.sqrt(F.sinh(p["y"]) * F.sinh(p["y"]) + F.cos(p["x"]) * F.cos(p["x"]))
        return _pair(zone * 6.0 - 183 + F.degrees(F.atan2(F.sinh(p["y"]), F.cos(p["x"]))), F.degrees(_latitude(tangent)))

    place = _let(_series(plane, _BETA, -1), degrees)
    return place["x"], place["y"]


def known(system: Column) -> Column:
    """Whether ``to_degrees`` has an inverse for a reference system's code; 0 stands for undefined degrees."""
    return system.isin(0, DEGREES, WEB_MERCATOR, WORLD_MERCATOR) | system.between(NORTH + 1, NORTH + 60) | system.between(SOUTH + 1, SOUTH + 60)


def to_degrees(x: Column, y: Column, system: Column) -> Column:
    """(x, y) as longitude and latitude, by the code of their reference system; null for a system that isn't known."""

    south = system > SOUTH
    return (
        F.when(system.isin(0, DEGREES), _pair(x, y))
        .when(system == WEB_MERCATOR, _pair(*from_mercator(x, y)))
        .when(system == WORLD_MERCATOR, _pair(*from_mercator(x, y, ellipsoid=True)))
        .when(known(system), _pair(*from_zone(x, y, (system - F.when(south, SOUTH).otherwise(NORTH)).cast("int"), south)))
    )


def rings_to_degrees(rings: Column, system: Column) -> Column:
    """Polygons' rings in longitude and latitude."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: to_degrees(p["x"], p["y"], system)))

"""Map projections of the WGS84 ellipsoid as column expressions: degrees, UTM zones, web Mercator.

Transverse Mercator goes by the series in the third flattening up to its fourth power, which is right to some micrometres
inside a zone and its neighbours, with closed forms in both directions, so nothing iterates and nothing leaves the JVM.
Other reference systems, and other datums, raise: their coordinates have to be projected before ingest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .geometry import FLATTENING, MAJOR

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Scale, false easting and false northing of UTM.
SCALE, EAST, SOUTH = 0.9996, 5e5, 1e7
#: Radius of the sphere that has a meridian of the ellipsoid's length.
_RADIUS = MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _powers(*rows: tuple[float, ...]) -> tuple[float, ...]:
    """Each row's polynomial in the third flattening; row j begins with its power j."""
    return tuple(sum(c * _N ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1))


#: The published series of the projection, of its inverse, and from conformal to geodetic latitude.
FORWARD = _powers((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
INVERSE = _powers((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
LATITUDE = _powers((2.0, -2 / 3, -2.0, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _series(terms: tuple[float, ...], xi: Column, eta: Column) -> tuple[Column, Column]:
    along = sum((F.lit(c) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, c in enumerate(terms, 1)), F.lit(0.0))
    across = sum((F.lit(c) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, c in enumerate(terms, 1)), F.lit(0.0))
    return along, across


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees."""
    away, s = F.radians(lon - F.lit(6.0 * zone - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.hypot(t, F.cos(away)))
    along, across = _series(FORWARD, xi, eta)
    return F.lit(EAST) + F.lit(SCALE * _RADIUS) * (eta + across), F.lit(SOUTH if south else 0.0) + F.lit(SCALE * _RADIUS) * (xi + along)


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Degrees of easting and northing."""
    xi, eta = (y - F.lit(SOUTH if south else 0.0)) / F.lit(SCALE * _RADIUS), (x - F.lit(EAST)) / F.lit(SCALE * _RADIUS)
    along, across = _series(INVERSE, xi, eta)
    xi, eta = xi - along, eta - across
    chi = F.atan2(F.sin(xi), F.hypot(F.sinh(eta), F.cos(xi)))
    phi = chi + sum((F.lit(c) * F.sin(chi * (2 * j)) for j, c in enumerate(LATITUDE, 1)), F.lit(0.0))
    return F.lit(6.0 * zone - 183) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def _zone(crs: str) -> tuple[int, bool] | None:
    code = crs.upper().removeprefix("EPSG:")
    if code.isdecimal() and len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return int(code[3:]), code[:3] == "327"
    return None


def reproject(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one reference system in another, x being east or longitude: EPSG:4326, 3857, 32601-32660, 32701-32760.

    Equal systems give the columns as they are; a null coordinate gives null.
    """
    if source.upper() == target.upper():
        return x, y
    for crs in (source, target):
        if crs.upper() not in ("EPSG:4326", "EPSG:3857") and not _zone(crs):
            raise ValueError(f"{crs} has to be projected before ingest")
    if zone := _zone(source):
        x, y = from_utm(x, y, *zone)
    elif source.upper() == "EPSG:3857":
        x, y = F.degrees(x / F.lit(MAJOR)), F.degrees(F.atan(F.sinh(y / F.lit(MAJOR))))
    if zone := _zone(target):
        return utm(x, y, *zone)
    if target.upper() == "EPSG:3857":
        return F.lit(MAJOR) * F.radians(x), F.lit(MAJOR) * F.asinh(F.tan(F.radians(y)))
    return x, y

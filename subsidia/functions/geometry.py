"""Cells of a grid: places, centres, areas on the ellipsoid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Axes of the WGS84 ellipsoid in metres.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


@dataclass(frozen=True)
class Grid:
    """Size, affine transform and reference system of a raster; rasters of equal grids may be joined by row and column."""

    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]
    crs: str


def same_grid(*grids: Grid) -> bool:
    return len(set(grids)) <= 1


def cell_of(flat: Column, width: Column, block_row: Column, block_col: Column) -> tuple[Column, Column]:
    """Row and column of a flat index in a block."""
    return block_row + F.floor(flat / width).cast("long"), block_col + flat % width


def cell_centre(row: Column, col: Column, origin: tuple[float, float], step: tuple[float, float], shear: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    i, j = row + F.lit(0.5), col + F.lit(0.5)
    x = F.lit(origin[0]) + j * F.lit(step[0]) + i * F.lit(shear[0])
    y = F.lit(origin[1]) + i * F.lit(step[1]) + j * F.lit(shear[1])
    return x, y


def cell_area(row: Column, top: float, dlat: float, dlon: float) -> Column:
    """Square metres of a cell of a grid in degrees whose first row begins at latitude top, rows going south by dlat.

    Three-point Gauss-Legendre quadrature of dlon * b^2 cos(p) / (1 - e^2 sin(p)^2)^2 over the row's latitudes.
    """
    e2 = FLATTENING * (2 - FLATTENING)
    minor = MAJOR * (1 - FLATTENING)
    half = F.lit(math.radians(dlat) / 2)
    middle = F.radians(F.lit(top) - (row + F.lit(0.5)) * F.lit(dlat))
    nodes = ((-math.sqrt(0.6), 5 / 9), (0.0, 8 / 9), (math.sqrt(0.6), 5 / 9))

    def strip(p: Column) -> Column:
        s = F.sin(p)
        d = F.lit(1.0) - F.lit(e2) * s * s
        return F.cos(p) / (d * d)

    parts = [strip(middle + half * F.lit(x)) * F.lit(w) for x, w in nodes]
    return F.abs(F.lit(minor**2 * math.radians(dlon)) * half * (parts[0] + parts[1] + parts[2]))


_NODES = ((-math.sqrt(0.6), 5 / 9), (0.0, 8 / 9), (math.sqrt(0.6), 5 / 9))


def _strip(p: Column) -> Column:
    """Square metres for a unit of longitude and latitude (radians), less the square of the minor axis."""
    e2, c = FLATTENING * (2 - FLATTENING), F.cos(p)
    d = F.lit(1 - e2) + F.lit(e2) * c * c
    return c / (d * d)


def affine_cell_area(row: Column, col: Column, transform: tuple[float, float, float, float, float, float]) -> Column:
    """Square metres of a cell of an affine grid in degrees, which may be turned and sheared, by 3 x 3 points of quadrature."""
    a, b, _, d, e, f = transform
    total = None
    for u, w in _NODES:
        for v, x in _NODES:
            p = F.radians(F.lit(d) * (col + F.lit(0.5 + u / 2)) + F.lit(e) * (row + F.lit(0.5 + v / 2)) + F.lit(f))
            part = _strip(p) * F.lit(w * x / 4)
            total = part if total is None else total + part
    return F.abs(total) * F.lit(abs(a * e - b * d) * math.radians(1) ** 2 * (MAJOR * (1 - FLATTENING)) ** 2)


#: Barycentric places and weights of seven points that integrate polynomials of degree five over a triangle.
_NEAR, _FAR = (6 - math.sqrt(15)) / 21, (6 + math.sqrt(15)) / 21
_TRIANGLE = [((1 / 3, 1 / 3, 1 / 3), 9 / 40)] + [((q, x, x)[-k:] + (q, x, x)[:-k], (155 + sign * math.sqrt(15)) / 1200) for x, q, sign in ((_NEAR, 1 - 2 * _NEAR, -1), (_FAR, 1 - 2 * _FAR, 1)) for k in (1, 2, 3)]


def polygon_area(ring: Sequence[tuple[Column, Column]]) -> Column:
    """Square metres on the ellipsoid inside a ring of (longitude, latitude) corners in degrees, either way round.

    Edges are straight in degrees, which for cells differs from geodesics by a third order of their length. The ring is
    cut into triangles from its first corner, with signs, so it needn't be convex; each is integrated by seven points,
    which is exact to the sixth order of its height: cut polygons of many degrees of latitude first.
    """
    (x0, y0), total = ring[0], None
    for (x1, y1), (x2, y2) in zip(ring[1:-1], ring[2:], strict=True):
        twice = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
        parts = None
        for (a, b, c), w in _TRIANGLE:
            part = _strip(F.radians(y0 * F.lit(a) + y1 * F.lit(b) + y2 * F.lit(c))) * F.lit(w)
            parts = part if parts is None else parts + part
        total = twice * parts if total is None else total + twice * parts
    return F.abs(total) * F.lit(0.5 * math.radians(1) ** 2 * (MAJOR * (1 - FLATTENING)) ** 2)


def cell_ring(row: Column, col: Column, transform: tuple[float, float, float, float, float, float]) -> list[tuple[Column, Column]]:
    """The corners of a cell of an affine grid, which may be rotated or sheared: x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = map(F.lit, transform)
    return [(a * j + b * i + c, d * j + e * i + f) for i, j in ((row, col), (row, col + 1), (row + 1, col + 1), (row + 1, col))]

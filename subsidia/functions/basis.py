"""Gaussian radial bases and their linear transform."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

#: With more centres the unrolled expressions would outgrow a compiled method; rbf_array() has no such limit.
UNROLLED = 64


@dataclass(frozen=True)
class Design:
    """Centres in projected metres, their common width, and a transform with a row for each centre (None: none)."""

    centers: tuple[tuple[float, float], ...]
    sigma: float
    transform: tuple[tuple[float, ...], ...] | None = None

    def weights(self, gamma: Sequence[float]) -> list[float]:
        """transform @ gamma: with it no transformed basis need be built to evaluate a predictor."""
        if self.transform is None:
            return list(gamma)
        return [math.fsum(t * g for t, g in zip(row, gamma, strict=True)) for row in self.transform]

    @property
    def size(self) -> int:
        return len(self.transform[0]) if self.transform else len(self.centers)


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def gaussian(x: Column, y: Column, design: Design) -> list[Column]:
    """One column for each centre: exp(-|p - c|^2 / 2 sigma^2)."""
    if len(design.centers) > UNROLLED:
        raise ValueError(f"more than {UNROLLED} centres: use rbf_array()")
    scale = F.lit(-0.5 / design.sigma**2)
    return [F.exp(((x - F.lit(cx)) * (x - F.lit(cx)) + (y - F.lit(cy)) * (y - F.lit(cy))) * scale) for cx, cy in design.centers]


def transformed(raw: Sequence[Column], design: Design) -> list[Column]:
    if design.transform is None:
        return list(raw)
    return [total([r * F.lit(row[j]) for r, row in zip(raw, design.transform, strict=True)]) for j in range(design.size)]


def row_norm(columns: Sequence[Column]) -> Column:
    return F.sqrt(total([c * c for c in columns]))


def rbf_array(x: Column, y: Column, centers: Sequence[tuple[float, float]], sigma: float) -> Column:
    """An array with a value for each centre, for any number of them: no join, no shuffle, small code."""
    points = F.array(*(F.struct(F.lit(cx).alias("cx"), F.lit(cy).alias("cy")) for cx, cy in centers))
    scale = F.lit(-0.5 / sigma**2)
    return F.transform(points, lambda c: F.exp(((x - c["cx"]) * (x - c["cx"]) + (y - c["cy"]) * (y - c["cy"])) * scale))


def weighted_total(values: Column, weights: Sequence[float]) -> Column:
    """The sum of an array's values by weights."""
    products = F.zip_with(values, F.array(*(F.lit(float(w)) for w in weights)), lambda v, w: v * w)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

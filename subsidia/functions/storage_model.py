"""The bounded storage model: a coefficient between two bounds, driven by a spatial predictor."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

from .basis import Design, total
from .harmonics import PERIOD, delayed

#: Bounds of the logarithm of the unconfined coefficient while fitting.
LOG_CU = (-40.0, 20.0)


@dataclass(frozen=True)
class StorageModel:
    """Parameters: eta0, gamma, log_cu and lag_c are fitted, the others are given."""

    eta0: float
    gamma: tuple[float, ...]
    log_cu: float
    lag_c: float
    lag_u: float = 10.0
    low: float = 1e-8
    high: float = 0.05
    ridge: float = 30.0
    sigma: float = 5.0
    period: float = field(default=PERIOD)

    @property
    def theta(self) -> list[float]:
        return [self.eta0, *self.gamma, self.log_cu, self.lag_c]

    def with_theta(self, theta: Sequence[float]) -> StorageModel:
        if len(theta) != len(self.gamma) + 3:
            raise ValueError(f"{len(self.gamma) + 3} parameters are needed, not {len(theta)}")
        return replace(self, eta0=float(theta[0]), gamma=tuple(map(float, theta[1:-2])), log_cu=float(theta[-2]), lag_c=float(theta[-1]))

    @property
    def gamma_norm(self) -> float:
        return math.sqrt(math.fsum(g * g for g in self.gamma))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without loss far to the left."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def bounded(eta: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * sigmoid(eta)


def bounded_slope(eta: Column, low: float, high: float) -> Column:
    s = sigmoid(eta)
    return F.lit(high - low) * s * (F.lit(1.0) - s)


def predictor(raw: Sequence[Column], model: StorageModel, design: Design) -> Column:
    """eta0 + gamma . basis, with the transform folded into the coefficients."""
    return F.lit(model.eta0) + total([r * F.lit(w) for r, w in zip(raw, design.weights(model.gamma), strict=True)])


def prediction(ske: Column, cu: Column | float, confined: tuple[Column, Column], unconfined: tuple[Column, Column]) -> tuple[Column, Column]:
    """Displacement in millimetres from already delayed heads in metres."""
    cu = cu if isinstance(cu, Column) else F.lit(cu)
    return tuple(F.lit(1000.0) * (ske * c + cu * u) for c, u in zip(confined, unconfined, strict=True))


def heads(model: StorageModel) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    c, u = (tuple(F.col(f"{h}_{k}") for k in ("sin", "cos")) for h in ("hc", "hu"))
    return delayed(*c, model.lag_c, model.period), delayed(*u, model.lag_u, model.period)

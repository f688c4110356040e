"""Fitting: objective and gradient as one aggregation, a bounded quasi-Newton loop on the driver, stages."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.basis import Design, gaussian
from ..functions.harmonics import delay_slope
from ..functions.storage_model import LOG_CU, StorageModel, bounded, bounded_slope, heads, predictor


@dataclass
class Evaluation:
    n_coef: int
    total: float
    data: float
    prior: float
    gradient: np.ndarray


def _sums(pixels: DataFrame, models: Sequence[StorageModel], design: Design) -> DataFrame:
    """One row of the sums of each model; the bases, which cost most, are computed once for all."""
    raw = gaussian(F.col("x"), F.col("y"), design)
    rows, asked, thousand = pixels.withColumns({f"raw{k}": r for k, r in enumerate(raw)}), [F.count("*").alias("n")], F.lit(1000.0)
    for i, model in enumerate(models):
        own = "" if len(models) == 1 else f"_{i}"
        log_cu = min(max(model.log_cu, LOG_CU[0]), LOG_CU[1])
        cu = math.exp(log_cu)
        eta, ske, slope, e_sin, e_cos, q = (f"{c}{own}" for c in ("eta", "ske", "slope", "e_sin", "e_cos", "q"))
        rows = rows.withColumn(eta, predictor([F.col(f"raw{k}") for k in range(len(raw))], model, design))
        rows = rows.withColumns({ske: bounded(F.col(eta), model.low, model.high), slope: bounded_slope(F.col(eta), model.low, model.high)})
        confined, unconfined = heads(model)
        later = delay_slope(F.col("hc_sin"), F.col("hc_cos"), model.lag_c, model.period)
        rows = rows.withColumns({e: F.col(f"obs_{k}") - thousand * (F.col(ske) * c + F.lit(cu) * u) for e, k, c, u in zip((e_sin, e_cos), ("sin", "cos"), confined, unconfined, strict=True)})
        dot = lambda v, s=e_sin, c=e_cos: F.col(s) * v[0] + F.col(c) * v[1]
        rows = rows.withColumn(q, -thousand * F.col(slope) * dot(confined))
        total = lambda x, name, own=own: F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{name}{own}")
        asked += [
            total(F.col(e_sin) * F.col(e_sin) + F.col(e_cos) * F.col(e_cos), "sse"),
            total(F.col(q), "g_eta0"),
            *(total(F.col(q) * F.col(f"raw{k}"), f"g_raw{k}") for k in range(len(raw))),
            total(-thousand * F.lit(cu if log_cu == model.log_cu else 0.0) * dot(unconfined), "g_log_cu"),
            total(-thousand * F.col(ske) * dot(later), "g_lag_c"),
        ]
    return rows.agg(*asked)


def objective_sums(pixels: DataFrame, model: StorageModel, design: Design) -> DataFrame:
    """One row of sums: rows, squared residuals, and what the gradient needs (a sum for each centre, not each basis)."""
    return _sums(pixels, [model], design)


def evaluate(pixels: DataFrame, model: StorageModel, design: Design) -> Evaluation:
    """Objective and gradient over usable pixels, both divided by the number of coefficients, the ridge too."""
    return evaluate_many(pixels, [model], design)[0]


def evaluate_many(pixels: DataFrame, models: Sequence[StorageModel], design: Design) -> list[Evaluation]:
    """evaluate() of several models in one scan."""
    row, out = _sums(pixels, models, design).first().asDict(), []
    for i, model in enumerate(models):
        own = "" if len(models) == 1 else f"_{i}"
        n, k = 2 * row["n"], len(design.centers)
        size, s2, gamma = max(n, 1), model.sigma**2, np.array(model.gamma)
        raw = np.array([row[f"g_raw{j}{own}"] for j in range(k)])
        basis = raw if design.transform is None else np.array(design.transform).T @ raw
        g = np.r_[row[f"g_eta0{own}"] / s2, basis / s2 + model.ridge * gamma, row[f"g_log_cu{own}"] / s2, row[f"g_lag_c{own}"] / s2] / size
        data, prior = 0.5 * row[f"sse{own}"] / s2 / size, 0.5 * model.ridge * float(gamma @ gamma) / size
        out.append(Evaluation(n, data + prior, data, prior, g))
    return out


def toy_objective(rows: DataFrame, ridge: float, gamma: Sequence[float], low: float, high: float) -> DataFrame:
    """Half the squared distance of rows(eta, target) plus the ridge, for tests of the pattern."""
    d = bounded(F.col("eta"), low, high) - F.col("target")
    return rows.agg((F.lit(0.5) * F.sum(d * d) + F.lit(0.5 * ridge * math.fsum(g * g for g in gamma))).alias("f_total"))


@dataclass
class Fit:
    theta: np.ndarray
    value: float
    gradient: np.ndarray
    iterations: int
    status: str
    history: list[dict] = field(default_factory=list)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, scale: np.ndarray | None = None, memory: int = 10, f_tol: float = 1e-12, g_tol: float = 1e-8, tries: int = 20) -> Fit:
    """Projected limited-memory BFGS with bounds: coordinates that a bound holds rest for a step, backtracking by Armijo.

    scale: typical sizes of the coordinates; the loop works on theta / scale and reports theta.
    """
    scale = np.ones_like(start) if scale is None else scale
    lo, hi = low / scale, high / scale
    x = np.clip(start / scale, lo, hi)

    def at(y: np.ndarray) -> tuple[float, np.ndarray]:
        value, g = f(y * scale)
        return value, g * scale

    value, g = at(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    history, status = [], "stopped at the iteration limit"
    projected = lambda x, g: np.clip(x - g, lo, hi) - x
    for k in range(most):
        if np.abs(projected(x, g)).max(initial=0) <= g_tol:
            status = "converged: gradient"
            break
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        d, back = np.where(free, g, 0), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            back.append(a)
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        d = np.where(free, -d, 0)
        if d @ g >= 0:
            d, steps = np.where(free, -g, 0), []
        size = 1.0 if steps else min(1.0, 1 / max(np.abs(d).max(), 1e-30))
        for _ in range(tries):
            new = np.clip(x + size * d, lo, hi)
            new_value, new_g = at(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * (g @ (new - x)):
                break
            size /= 2
        else:
            status = "stopped: no descent"
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-memory:]
        moved, drop = np.linalg.norm(s) / max(np.linalg.norm(x), 1), (value - new_value) / max(abs(value), abs(new_value), 1e-30)
        x, value, g = new, new_value, new_g
        history.append({"iteration": k + 1, "objective": value, "relative_step": float(moved), "gradient_rms": float(np.sqrt(np.mean((g / scale) ** 2)))})
        if drop <= f_tol:
            status = "converged: objective"
            break
    return Fit(x * scale, value, g / scale, len(history), status, history)


def fit(pixels: DataFrame, model: StorageModel, design: Design, budgets: tuple[int, int, int] = (100, 200, 500), wolfe: bool = False) -> tuple[StorageModel, dict]:
    """Three stages over persisted usable pixels: eta0, log_cu and lag_c; gamma, begun anew from zero; all.

    Without a positive budget the parameters are evaluated and returned as they are. With wolfe the search is that of
    bounded.py, which evaluates several steps in a scan. The summary counts scans.
    """
    from .bounded import minimise_bounded

    scans = 0
    k = len(model.gamma)
    low, high = np.r_[np.full(k + 1, -np.inf), LOG_CU[0], 0.0], np.r_[np.full(k + 1, np.inf), LOG_CU[1], model.period]
    scale = np.r_[np.ones(k + 2), 50.0]
    pixels = pixels.persist()
    try:
        theta = np.array(model.theta)
        first = evaluate(pixels, model, design)
        summary: dict = {"initial_objective": first.total, "history": [], "stages": [], "iterations": 0, "status": "evaluated only"}
        last = Fit(theta, first.total, first.gradient, 0, "evaluated only")
        if max(budgets) > 0:
            outer = np.r_[True, np.zeros(k, bool), True, True]
            for name, free, most in (("global", outer, budgets[0]), ("gamma", ~outer, budgets[1]), ("all", np.ones(k + 3, bool), budgets[2])):
                if name == "gamma":
                    theta[1:-2] = 0.0

                def parts(points: Sequence[np.ndarray], theta=theta, free=free) -> list[tuple[float, np.ndarray]]:
                    nonlocal scans
                    scans += 1
                    models = []
                    for y in points:
                        whole = theta.copy()
                        whole[free] = y
                        models.append(model.with_theta(whole))
                    return [(e.total, e.gradient[free]) for e in evaluate_many(pixels, models, design)]

                if wolfe:
                    last = minimise_bounded(parts, theta[free], low[free], high[free], most, scale[free])
                else:
                    last = minimise(lambda y, parts=parts: parts([y])[0], theta[free], low[free], high[free], most, scale[free])
                theta = theta.copy()
                theta[free] = last.theta
                summary["history"] += [{"stage": name, **h} for h in last.history]
                summary["stages"].append({"stage": name, "status": last.status, "iterations": last.iterations})
                summary["iterations"] += last.iterations
            summary["status"] = last.status
        fitted = model.with_theta(theta)
        final = evaluate(pixels, fitted, design)
        summary |= {"scans": scans, "final_objective": final.total, "relative_reduction": (first.total - final.total) / max(abs(first.total), 1e-30), "theta": theta.tolist(), "gradient_norm": float(np.linalg.norm(final.gradient))}
        return fitted, summary
    finally:
        pixels.unpersist()

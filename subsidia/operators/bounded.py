"""Limited-memory BFGS with bounds: generalised Cauchy point, subspace step, and a search for strong Wolfe steps.

What costs is a scan of the pixels, not the algebra of some dozens of parameters. So the function that is minimised
takes several points at once, and every round of the line search asks for several step sizes in one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .fit import Fit

#: Sufficient decrease and curvature of the strong Wolfe conditions.
DECREASE, CURVATURE = 1e-4, 0.9
#: Step sizes of a first round, as shares of the step to the model's minimum.
STEPS = (1.0, 0.5, 0.2, 2.0)

Points = Callable[[Sequence[np.ndarray]], list[tuple[float, np.ndarray]]]


class Curvature:
    """The matrix theta I - W M W' of the last steps and changes of the gradient."""

    def __init__(self, n: int, memory: int):
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.memory, self.theta, self.w, self.m = memory, 1.0, np.zeros((n, 0)), np.zeros((0, 0))

    def add(self, s: np.ndarray, y: np.ndarray) -> None:
        if s @ y <= 2.2e-16 * (y @ y):
            return
        self.pairs = [*self.pairs, (s, y)][-self.memory :]
        steps, changes = (np.stack([p[i] for p in self.pairs], axis=1) for i in (0, 1))
        self.theta = float(y @ y / (s @ y))
        products = steps.T @ changes
        lower = np.tril(products, -1)
        self.w = np.hstack([changes, self.theta * steps])
        self.m = np.linalg.inv(np.block([[-np.diag(np.diag(products)), lower.T], [lower, self.theta * steps.T @ steps]]))

    def clear(self) -> None:
        self.__init__(len(self.w), self.memory)


def cauchy_point(x: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray, b: Curvature) -> tuple[np.ndarray, np.ndarray]:
    """The first minimum of the quadratic model along the projected gradient's path, and W' of the way there."""
    with np.errstate(divide="ignore", invalid="ignore"):
        breaks = np.where(g < 0, (x - high) / g, np.where(g > 0, (x - low) / g, np.inf))
    point, d = x.copy(), np.where(breaks > 0, -g, 0.0)
    p, c = b.w.T @ d, np.zeros(b.w.shape[1])
    slope = -(d @ d)
    bend = -b.theta * slope - p @ b.m @ p
    if slope == 0:
        return point, c
    best, gone = -slope / bend, 0.0
    for i in np.argsort(breaks, kind="stable"):
        if not 0 < breaks[i] < np.inf:
            continue
        way = breaks[i] - gone
        if best < way:
            break
        point[i] = high[i] if d[i] > 0 else low[i]
        c = c + way * p
        row = b.w[i]
        slope += way * bend + g[i] ** 2 + b.theta * g[i] * (point[i] - x[i]) - g[i] * (row @ b.m @ c)
        bend += -b.theta * g[i] ** 2 - 2 * g[i] * (row @ b.m @ p) - g[i] ** 2 * (row @ b.m @ row)
        p, d[i], gone = p + g[i] * row, 0.0, breaks[i]
        best = -slope / bend if bend > 0 else 0.0
        if not d.any():
            best = 0.0
            break
    best = max(best, 0.0)
    return np.where(d != 0, x + (gone + best) * d, point), c + best * p


def subspace_point(x: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray, b: Curvature, point: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The model's minimum over the coordinates that the Cauchy point leaves free, cut back into the bounds."""
    free = (point > low) & (point < high)
    if not free.any():
        return point
    rest = (g + b.theta * (point - x) - b.w @ (b.m @ c))[free]
    w = b.w[free]
    step = -rest / b.theta
    if b.w.shape[1]:
        v = b.m @ (w.T @ rest)
        v = np.linalg.solve(np.eye(len(v)) - b.m @ (w.T @ w) / b.theta, v)
        step = step - w @ v / b.theta**2
    room = np.where(step > 0, high[free] - point[free], np.where(step < 0, low[free] - point[free], np.inf))
    share = min(1.0, float(np.min(np.divide(room, step, out=np.full(len(step), np.inf), where=step != 0), initial=np.inf)))
    out = point.copy()
    out[free] += share * step
    return np.clip(out, low, high)


def _search(f: Points, x: np.ndarray, value: float, g: np.ndarray, d: np.ndarray, most: float, first: Sequence[float], rounds: int) -> tuple[float, float, np.ndarray] | None:
    """(step, value, gradient) of a step that meets the strong Wolfe conditions, or of the best with enough decrease."""
    slope, low, high = g @ d, (0.0, value), None
    asked, fallback = [min(s, most) for s in first], None
    for _ in range(rounds):
        asked = sorted({s for s in asked if s > 0})
        if not asked:
            break
        found = [(s, *z) for s, z in zip(asked, f([x + s * d for s in asked]), strict=True)]
        able = [z for z in found if np.isfinite(z[1]) and z[1] <= value + DECREASE * z[0] * slope]
        good = [z for z in able if abs(z[2] @ d) <= -CURVATURE * slope or z[0] >= most]
        if good:
            return min(good, key=lambda z: z[1])
        if able:
            fallback = min([*able, *([fallback] if fallback else [])], key=lambda z: z[1])
        for z in found:  # in the order of steps: where a minimum must lie
            if not np.isfinite(z[1]) or z[1] > value + DECREASE * z[0] * slope or z[1] >= low[1] and low[0] > 0 or z[2] @ d >= 0:
                high = z[0] if high is None else min(high, z[0])
                break
            if high is None or z[0] < high:
                low = (z[0], z[1]) if z[0] > low[0] else low
        if high is None:
            asked = [min(low[0] * k, most) for k in (2, 4, 8, 16)]
        else:
            asked = [low[0] + (high - low[0]) * k for k in (0.1, 0.3, 0.5, 0.75)]
    return fallback


def minimise_bounded(f: Points, start: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, scale: np.ndarray | None = None, memory: int = 10, f_tol: float = 1e-12, g_tol: float = 1e-8, rounds: int = 6, steps: Sequence[float] = STEPS) -> Fit:
    """Minimise f within bounds; f takes points and gives (value, gradient) of each.

    scale: typical sizes of the coordinates; the loop works on theta / scale and reports theta.
    """
    scale = np.ones_like(start) if scale is None else scale
    lo, hi = low / scale, high / scale
    x = np.clip(start / scale, lo, hi)

    def at(points: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        return [(v, g * scale) for v, g in f([np.clip(p, lo, hi) * scale for p in points])]

    ((value, g),) = at([x])
    b, history, status = Curvature(len(x), memory), [], "stopped at the iteration limit"
    for k in range(most):
        if np.abs(np.clip(x - g, lo, hi) - x).max(initial=0) <= g_tol:
            status = "converged: gradient"
            break
        point, c = cauchy_point(x, g, lo, hi, b)
        d = subspace_point(x, g, lo, hi, b, point, c) - x
        if d @ g >= 0:
            b.clear()
            d = cauchy_point(x, g, lo, hi, b)[0] - x
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(d > 0, (hi - x) / d, np.where(d < 0, (lo - x) / d, np.inf))
        begin = 1.0 if b.pairs else min(1.0, 1 / max(np.abs(d).max(), 1e-30))
        found = _search(at, x, value, g, d, float(np.min(room, initial=np.inf)), [begin * s for s in steps], rounds)
        if found is None:
            if not b.pairs:
                status = "stopped: no descent"
                break
            b.clear()
            continue
        size, new_value, new_g = found
        new = np.clip(x + size * d, lo, hi)
        b.add(new - x, new_g - g)
        moved, drop = np.linalg.norm(new - x) / max(np.linalg.norm(x), 1), (value - new_value) / max(abs(value), abs(new_value), 1e-30)
        x, value, g = new, new_value, new_g
        history.append({"iteration": k + 1, "objective": value, "relative_step": float(moved), "gradient_rms": float(np.sqrt(np.mean((g / scale) ** 2)))})
        if drop <= f_tol:
            status = "converged: objective"
            break
    return Fit(x * scale, value, g / scale, len(history), status, history)

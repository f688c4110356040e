import math
from dataclasses import replace

import numpy as np
import pytest

from subsidia.operators import fit
from subsidia.operators.bounded import minimise_bounded
from subsidia.operators.fit import minimise
from subsidia.plans import queries as plans


def counted(f):
    scans = []

    def many(points):
        scans.append(len(points))
        return [f(p) for p in points]

    return many, scans


def rosenbrock(x):
    a, b = x[1:] - x[:-1] ** 2, 1 - x[:-1]
    g = np.zeros_like(x)
    g[:-1] = -400 * x[:-1] * a - 2 * b
    g[1:] += 200 * a
    return float(100 * a @ a + b @ b), g


def stationary(x, g, low, high):
    return np.abs(np.clip(x - g, low, high) - x).max()


@pytest.mark.parametrize("n", [2, 5, 20])
def test_rosenbrock_free_and_bounded(n):
    free = np.full(n, np.inf)
    f, scans = counted(rosenbrock)
    found = minimise_bounded(f, np.full(n, -1.2), -free, free, 500, f_tol=0)
    assert found.value < 1e-10 and np.abs(found.theta - 1).max() < 1e-4
    low, high = np.full(n, -0.5), np.r_[np.full(n - 1, 0.6), 0.3]
    f, _ = counted(rosenbrock)
    found = minimise_bounded(f, np.full(n, -1.2), low, high, 500, f_tol=0)
    assert stationary(found.theta, found.gradient, low, high) < 1e-5 and (found.theta >= low).all() and (found.theta <= high).all()


def test_quadratics_with_active_bounds():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        a = rng.normal(size=(n, n))
        a = a @ a.T + 0.1 * np.eye(n)
        b = rng.normal(size=n)
        low, high = -rng.random(n) * rng.integers(0, 2, n), rng.random(n)
        f, _ = counted(lambda x, a=a, b=b: (float(0.5 * x @ a @ x - b @ x), a @ x - b))
        found = minimise_bounded(f, rng.normal(size=n), low, high, 300, f_tol=0)
        assert stationary(found.theta, found.gradient, low, high) < 1e-6


def test_fewer_scans_than_backtracking():
    low, high = np.full(8, -np.inf), np.full(8, np.inf)
    calls = []
    slow = minimise(lambda x: (calls.append(1), rosenbrock(x))[1], np.full(8, -1.0), low, high, 500, f_tol=1e-14)
    f, scans = counted(rosenbrock)
    fast = minimise_bounded(f, np.full(8, -1.0), low, high, 500, f_tol=1e-14)
    assert fast.value <= slow.value + 1e-9 and len(scans) < len(calls)


def test_no_descent_and_no_budget():
    f, scans = counted(lambda x: (float("nan") if (x != 0).any() else 0.0, np.ones(2)))
    assert minimise_bounded(f, np.zeros(2), np.full(2, -1.0), np.ones(2), 5).status == "stopped: no descent"
    assert minimise_bounded(counted(rosenbrock)[0], np.zeros(2), np.full(2, -1.0), np.ones(2), 0).iterations == 0


def test_fit_reaches_the_same_optimum_in_fewer_scans(spark, sf_dir):
    pixels = plans.usable(plans.masked_pixels(spark, sf_dir))
    start = replace(plans.MODEL, eta0=-3.0, log_cu=math.log(1e-3), lag_c=40.0)
    (_, slow), (model, fast) = (fit.fit(pixels, start, plans.DESIGN, wolfe=w) for w in (False, True))
    assert fast["final_objective"] == pytest.approx(slow["final_objective"], rel=1e-6)
    assert fast["scans"] < slow["scans"] and 0 <= model.lag_c <= model.period


def test_several_models_in_one_scan(spark, sf_dir):
    pixels = plans.usable(plans.masked_pixels(spark, sf_dir))
    models = [replace(plans.MODEL, eta0=x, log_cu=y) for x, y in ((-3.0, -7.0), (-4.0, -50.0), (-2.0, 1.0))]
    for one, of_many in zip((fit.evaluate(pixels, m, plans.DESIGN) for m in models), fit.evaluate_many(pixels, models, plans.DESIGN), strict=True):
        assert of_many.total == pytest.approx(one.total) and of_many.gradient == pytest.approx(one.gradient)

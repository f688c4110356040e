"""DuckDB SQL of the fixture and of the model, written from the formulas and not from the Spark plans."""

from __future__ import annotations

import math

from ..functions.geometry import FLATTENING, MAJOR
from ..functions.harmonics import PERIOD
from ..functions.projection import EAST, FORWARD, SCALE
from ..sources.pixels import DESIGN, MODEL, STEP, TOP


def num(x: float) -> str:
    """A constant that both engines read as a double."""
    return f"({x:.17e})"


W = 2 * math.pi / PERIOD

PX = f"""px AS (SELECT o_orderkey AS pixel_id, CAST(floor(o_orderkey / 125) AS BIGINT) AS row, o_orderkey % 125 AS col, CAST(floor(o_orderkey / 1250) AS BIGINT) AS block_id,
 CAST(floor(o_orderkey / 50) AS BIGINT) % 5 AS fold_id, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS mask,
 o_totalprice / {num(5e4)} * sin({num(W)} * d) AS obs_sin, o_totalprice / {num(5e4)} * cos({num(W)} * d) AS obs_cos,
 ({num(1)} + (o_custkey % 97) / {num(97)}) * sin({num(W)} * (d - 40)) AS hc_sin, ({num(1)} + (o_custkey % 97) / {num(97)}) * cos({num(W)} * (d - 40)) AS hc_cos,
 (o_orderkey % 89) / {num(89)} AS hu_sin, (o_orderkey % 83) / {num(83)} AS hu_cos, {num(0.01)} + {num(0.001)} * (o_orderkey % 7) AS ske_ref,
 CAST(o_orderkey % 125 AS DOUBLE) AS x, floor(o_orderkey / 125) AS y
 FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders))"""

BAD = f"""bad AS (SELECT * REPLACE (CASE WHEN pixel_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE obs_sin END AS obs_sin, CASE WHEN pixel_id % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE hc_cos END AS hc_cos,
 CASE WHEN pixel_id % 17 = 0 THEN CAST('-inf' AS DOUBLE) ELSE hu_sin END AS hu_sin, CASE WHEN pixel_id % 19 = 0 THEN NULL ELSE obs_cos END AS obs_cos) FROM px)"""


UNDEFINED = "uf AS (SELECT * REPLACE (CASE WHEN pixel_id % 23 = 0 THEN NULL WHEN pixel_id % 29 = 0 THEN 9 ELSE fold_id END AS fold_id) FROM px)"

REPEATED = "rp AS (SELECT * FROM px UNION ALL SELECT * REPLACE ((fold_id + 1) % 5 AS fold_id) FROM px WHERE pixel_id % 31 = 0)"


def rotated(s: str, c: str, lag: float) -> tuple[str, str]:
    a = W * lag
    return f"({s} * {num(math.cos(a))} + {c} * {num(math.sin(a))})", f"({c} * {num(math.cos(a))} - {s} * {num(math.sin(a))})"


def raw(k: int) -> str:
    cx, cy = DESIGN.centers[k]
    return f"exp({num(-0.5 / DESIGN.sigma**2)} * (power(x - {num(cx)}, 2) + power(y - {num(cy)}, 2)))"


def model(source: str = "px", where: str = "mask = 1", m=MODEL) -> str:
    """CTEs up to mf: pixels with eta, ske, prediction and residual."""
    weights = [sum(t * g for t, g in zip(row, m.gamma, strict=True)) for row in DESIGN.transform]
    hc, hu = rotated("hc_sin", "hc_cos", m.lag_c), rotated("hu_sin", "hu_cos", m.lag_u)
    cu = math.exp(m.log_cu)
    return f"""m0 AS (SELECT *, {', '.join(f'{raw(k)} AS k{k}' for k in range(4))} FROM {source} WHERE {where}),
m1 AS (SELECT *, {num(m.eta0)} + {' + '.join(f'{num(w)} * k{k}' for k, w in enumerate(weights))} AS eta FROM m0),
m2 AS (SELECT *, {num(m.low)} + {num(m.high - m.low)} / (1 + exp(-eta)) AS ske FROM m1),
m3 AS (SELECT *, {num(1000)} * (ske * {hc[0]} + {num(cu)} * {hu[0]}) AS pred_sin, {num(1000)} * (ske * {hc[1]} + {num(cu)} * {hu[1]}) AS pred_cos FROM m2),
mf AS (SELECT *, obs_sin - pred_sin AS res_sin, obs_cos - pred_cos AS res_cos FROM m3)"""


def metrics(by: str, source: str = "mf", where: str = "TRUE") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}count(*) AS pixel_count, 2 * count(*) AS observation_count, CAST(0 AS BIGINT) AS nonfinite_count,
 round(sqrt(sum(res_sin * res_sin + res_cos * res_cos) / (2 * count(*))), 6) AS rmse, round(sum(abs(res_sin) + abs(res_cos)) / (2 * count(*)), 6) AS mae,
 round(min(ske), 9) AS ske_min, round(quantile_cont(ske, 0.5), 9) AS ske_p50, round(max(ske), 9) AS ske_max,
 round(quantile_cont(greatest(abs(pred_sin), abs(pred_cos)), 0.99), 6) AS pred_abs_p99, round(sum(CASE WHEN {num(MODEL.high)} - ske <= {num(1e-6)} THEN 1.0e0 ELSE 0.0e0 END) / count(*), 9) AS upper_bound_fraction
 FROM {source} WHERE {where}{f' GROUP BY {by}' if by else ''}"""


def damaged_metrics(by: str, source: str = "mf") -> str:
    """metrics() where some predictions or residuals are not finite: counted, but in no sum."""
    good = "coalesce(isfinite(pred_sin) AND isfinite(pred_cos) AND isfinite(res_sin) AND isfinite(res_cos), FALSE)"
    own = lambda x: f"CASE WHEN good THEN {x} END"
    return f"""SELECT {by}, count(*) AS pixel_count, 2 * count_if(good) AS observation_count, count_if(NOT good) AS nonfinite_count,
 round(sqrt(coalesce(sum({own('res_sin * res_sin + res_cos * res_cos')}), 0) / greatest(2 * count_if(good), 1)), 6) AS rmse, round(coalesce(sum({own('abs(res_sin) + abs(res_cos)')}), 0) / greatest(2 * count_if(good), 1), 6) AS mae,
 round(min({own('ske')}), 9) AS ske_min, round(quantile_cont({own('ske')}, 0.5), 9) AS ske_p50, round(max({own('ske')}), 9) AS ske_max,
 round(quantile_cont({own('greatest(abs(pred_sin), abs(pred_cos))')}, 0.99), 6) AS pred_abs_p99, round(count_if(good AND {num(MODEL.high)} - ske <= {num(1e-6)}) / count(*), 9) AS upper_bound_fraction
 FROM (SELECT *, {good} AS good FROM {source}) GROUP BY {by}"""


def gates(exprs: dict[str, str], source: str, *keys: str) -> str:
    """A row for each gate and row of the source."""
    names, tests = ", ".join(f"'{k}'" for k in exprs), ", ".join(f"coalesce({v}, FALSE)" for v in exprs.values())
    return f"SELECT {''.join(f'{k}, ' for k in keys)}unnest([{names}]) AS gate, unnest([{tests}]) AS passed FROM {source}"


def near(a: str, b: str, tol: float) -> str:
    return f"(abs({a} - {b}) <= {num(tol)} AND isfinite({a}) AND isfinite({b}))"


def phase(s: str, c: str) -> str:
    """atan2 in days, in [0, PERIOD)."""
    a = f"(atan2({s}, {c}) * {num(PERIOD / (2 * math.pi))})"
    return f"(CASE WHEN {a} < 0 THEN {a} + {num(PERIOD)} ELSE {a} END)"


def circular(a: str, b: str) -> str:
    d = f"({b} - {a} - {num(PERIOD)} * floor(({b} - {a}) / {num(PERIOD)}))"
    return f"(CASE WHEN {d} > {num(PERIOD / 2)} THEN {d} - {num(PERIOD)} ELSE {d} END)"


def area(row: str) -> str:
    """Square metres of the cells of a row."""
    e2, minor = FLATTENING * (2 - FLATTENING), MAJOR * (1 - FLATTENING)
    middle, half = f"radians({num(TOP)} - ({row} + {num(0.5)}) * {num(STEP)})", math.radians(STEP) / 2
    parts = [f"{num(w)} * cos({middle} + {num(half * x)}) / power(1 - {num(e2)} * power(sin({middle} + {num(half * x)}), 2), 2)" for x, w in ((-math.sqrt(0.6), 5 / 9), (0.0, 8 / 9), (math.sqrt(0.6), 5 / 9))]
    return f"abs({num(minor**2 * math.radians(STEP) * half)} * ({' + '.join(parts)}))"


def utm(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """Easting and northing north of the equator, by the atanh form of the projection."""
    n, e = FLATTENING / (2 - FLATTENING), math.sqrt(FLATTENING * (2 - FLATTENING))
    size = SCALE * MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    away, s = f"radians({lon} - {num(6 * zone - 183)})", f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {num(e)} * atanh({num(e)} * {s}))"
    xi, eta = f"atan({t} / cos({away}))", f"atanh(sin({away}) / sqrt(1 + power({t}, 2)))"
    x = " + ".join(f"{num(c)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(FORWARD, 1))
    y = " + ".join(f"{num(c)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(FORWARD, 1))
    return f"{num(EAST)} + {num(size)} * ({eta} + {x})", f"{num(size)} * ({xi} + {y})"

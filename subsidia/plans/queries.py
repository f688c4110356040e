"""The query catalogue of the pixel engine, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import basis, geometry, guards, harmonics, projection, storage_model
from ..functions.geometry import MAJOR
from ..operators import fit, folds, gates, history, metrics, percentiles, release, storage
from ..operators.model_frame import fold_model_frame, model_frame, split_filter, usable
from ..sources.pixels import DESIGN, MODEL, STEP, TOP, damaged_pixels, masked_pixels, order_pixels, read_table, repeated_pixels, undefined_folds
from ..streaming.metrics import running_metrics
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DECIMALS = {"rmse": 6, "mae": 6, "pred_abs_p99": 6, "ske_min": 9, "ske_p50": 9, "ske_max": 9, "upper_bound_fraction": 9}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, **decimals: int) -> DataFrame:
    own = DECIMALS | decimals
    return df.select(*(F.round(c, own[c]).alias(c) if c in own else F.col(c) for c in df.columns))


def r(x: Column, n: int, name: str) -> Column:
    return F.round(x, n).alias(name)


def frame(spark: SparkSession, d: str) -> DataFrame:
    return model_frame(usable(masked_pixels(spark, d)), MODEL, DESIGN)


MF = f"WITH {S.PX}, {S.model()} "


@query(MF + S.metrics("fold_id"))
def q01_fold_metrics(spark, d):
    return rounded(metrics.metrics(frame(spark, d), MODEL.high, ["fold_id"]))


@query(MF + S.metrics(""))
def q02_final_metrics(spark, d):
    return rounded(metrics.metrics(frame(spark, d), MODEL.high))


_SHORT = f"SELECT fold_id, pixel_count, rmse, mae FROM ({S.metrics('fold_id', where='fold_id <> 0')})"


@query(MF + _SHORT)
def q03_validation_split(spark, d):
    rows = frame(spark, d).where("fold_id <> 0")
    return rounded(metrics.metrics(rows, MODEL.high, ["fold_id"]).select("fold_id", "pixel_count", "rmse", "mae"))


@query(f"WITH {S.PX}, {S.UNDEFINED}, {S.model('uf')}, t AS (SELECT mf.* REPLACE (k AS fold_id) FROM mf JOIN (VALUES (CAST(1 AS BIGINT)), (2), (3), (4)) v(k) ON fold_id IS DISTINCT FROM k) SELECT fold_id, pixel_count, rmse, mae FROM ({S.metrics('fold_id', 't')})")
def q04_training_split(spark, d):
    rows = model_frame(usable(undefined_folds(masked_pixels(spark, d))), MODEL, DESIGN)
    return rounded(metrics.training_errors(rows, folds.FOLDS))


@query(f"WITH {S.PX}, {S.UNDEFINED} SELECT CASE WHEN fold_id IN (0, 1, 2, 3, 4) THEN fold_id ELSE -1 END AS fold_id, count(*) AS n FROM uf WHERE mask = 1 GROUP BY ALL")
def q05_fold_histogram(spark, d):
    return folds.fold_histogram(undefined_folds(masked_pixels(spark, d)))


@query(f"WITH {S.PX}, {S.UNDEFINED}, c AS (SELECT * FROM uf WHERE mask = 1), k AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS fold_id) SELECT k.fold_id, count_if(c.fold_id IS DISTINCT FROM k.fold_id) AS training_n, count_if(c.fold_id = k.fold_id) AS validation_n, CAST(0 AS BIGINT) AS intersection_n, count(*) AS union_n, TRUE AS passed FROM c, k GROUP BY k.fold_id")
def q06_partition_audit(spark, d):
    return folds.partition_audit(undefined_folds(masked_pixels(spark, d)))


_ROT = S.rotated("hc_sin", "hc_cos", MODEL.lag_c)


@query(f"WITH {S.PX} SELECT pixel_id, round({_ROT[0]}, 9) AS rot_sin, round({_ROT[1]}, 9) AS rot_cos FROM px")
def q07_rotate(spark, d):
    s, c = harmonics.delayed(F.col("hc_sin"), F.col("hc_cos"), MODEL.lag_c)
    return order_pixels(spark, d).select("pixel_id", r(s, 9, "rot_sin"), r(c, 9, "rot_cos"))


@query(f"WITH {S.PX} SELECT pixel_id, round({S.phase('obs_sin', 'obs_cos')}, 6) AS phase_days FROM px")
def q08_phase_days(spark, d):
    return order_pixels(spark, d).select("pixel_id", r(harmonics.phase_days(F.col("obs_sin"), F.col("obs_cos")), 6, "phase_days"))


@query(f"WITH {S.PX} SELECT pixel_id, round(obs_sin * sin({S.num(S.W)} * (pixel_id % 366)) + obs_cos * cos({S.num(S.W)} * (pixel_id % 366)), 9) AS value FROM px")
def q09_harmonic_value(spark, d):
    return order_pixels(spark, d).select("pixel_id", r(harmonics.harmonic_value(F.col("obs_sin"), F.col("obs_cos"), F.col("pixel_id") % 366), 9, "value"))


@query(f"WITH {S.PX} SELECT pixel_id, round({S.circular(S.phase('obs_sin', 'obs_cos'), S.phase('hc_sin', 'hc_cos'))}, 6) AS shift_days FROM px")
def q10_circular_difference(spark, d):
    a, b = (harmonics.phase_days(F.col(f"{v}_sin"), F.col(f"{v}_cos")) for v in ("obs", "hc"))
    return order_pixels(spark, d).select("pixel_id", r(harmonics.circular_difference(a, b), 6, "shift_days"))


_ETA = f"(pixel_id % 2001 - 1000) / {S.num(20)}"


@query(f"WITH {S.PX}, a AS (SELECT pixel_id, 1 / (1 + exp(-{_ETA})) AS s FROM px) SELECT pixel_id, round(s, 12) AS sigmoid, round({S.num(MODEL.low)} + {S.num(MODEL.high - MODEL.low)} * s, 12) AS ske, round({S.num(MODEL.high - MODEL.low)} * s * (1 - s), 12) AS slope FROM a")
def q11_sigmoid_ske(spark, d):
    eta = (F.col("pixel_id") % 2001 - 1000) / F.lit(20.0)
    return order_pixels(spark, d).select("pixel_id", r(storage_model.sigmoid(eta), 12, "sigmoid"), r(storage_model.bounded(eta, MODEL.low, MODEL.high), 12, "ske"), r(storage_model.bounded_slope(eta, MODEL.low, MODEL.high), 12, "slope"))


@query(MF + "SELECT pixel_id, round(pred_sin, 8) AS pred_sin, round(pred_cos, 8) AS pred_cos, round(res_sin, 8) AS res_sin, round(res_cos, 8) AS res_cos FROM mf")
def q12_prediction(spark, d):
    return rounded(frame(spark, d).select("pixel_id", "pred_sin", "pred_cos", "res_sin", "res_cos"), pred_sin=8, pred_cos=8, res_sin=8, res_cos=8)


_RBF = f"WITH {S.PX} SELECT pixel_id, {', '.join(f'round({S.raw(k)}, 9) AS b{k}' for k in range(4))} FROM px"


@query(_RBF)
def q13_rbf_basis(spark, d):
    return order_pixels(spark, d).select("pixel_id", *(r(b, 9, f"b{k}") for k, b in enumerate(basis.gaussian(F.col("x"), F.col("y"), DESIGN))))


@query(_RBF)
def q14_rbf_join(spark, d):
    rows = order_pixels(spark, d).withColumn("b", basis.rbf_array(F.col("x"), F.col("y"), DESIGN.centers, DESIGN.sigma))
    return rows.select("pixel_id", *(r(F.col("b")[k], 9, f"b{k}") for k in range(4)))


_T = [" + ".join(f"{S.num(row[j])} * {S.raw(k)}" for k, row in enumerate(DESIGN.transform)) for j in range(4)]


@query(f"WITH {S.PX} SELECT pixel_id, {', '.join(f'round({t}, 9) AS t{j}' for j, t in enumerate(_T))} FROM px")
def q15_basis_transform(spark, d):
    found = basis.transformed(basis.gaussian(F.col("x"), F.col("y"), DESIGN), DESIGN)
    return order_pixels(spark, d).select("pixel_id", *(r(t, 9, f"t{j}") for j, t in enumerate(found)))


@query(f"WITH {S.PX} SELECT pixel_id, round(sqrt({' + '.join(f'power({S.raw(k)}, 2)' for k in range(4))}), 9) AS row_norm FROM px")
def q16_row_norm(spark, d):
    return order_pixels(spark, d).select("pixel_id", r(basis.row_norm(basis.gaussian(F.col("x"), F.col("y"), DESIGN)), 9, "row_norm"))


_PRIOR = 0.5 * MODEL.ridge * MODEL.gamma_norm**2
_SSE = f"sum(res_sin * res_sin + res_cos * res_cos) * {S.num(0.5 / MODEL.sigma**2)}"


@query(MF + f"SELECT 2 * count(*) AS n_coef, round(({_SSE} + {S.num(_PRIOR)}) / (2 * count(*)), 10) AS f_total, round({_SSE} / (2 * count(*)), 10) AS f_data, round({S.num(_PRIOR)} / (2 * count(*)), 10) AS f_prior FROM mf")
def q17_objective(spark, d):
    n, s = F.lit(2) * F.col("n"), F.col("sse") * F.lit(0.5 / MODEL.sigma**2)
    sums = fit.objective_sums(usable(masked_pixels(spark, d)), MODEL, DESIGN)
    prior = F.lit(_PRIOR)
    return sums.select(n.alias("n_coef"), r(guards.ratio(s + prior, n), 10, "f_total"), r(guards.ratio(s, n), 10, "f_data"), r(guards.ratio(prior, n), 10, "f_prior"))


def _gradient_sql() -> str:
    hc, hu = S.rotated("hc_sin", "hc_cos", MODEL.lag_c), S.rotated("hu_sin", "hu_cos", MODEL.lag_u)
    a = S.W * MODEL.lag_c
    ds = f"{S.num(S.W)} * (hc_cos * {S.num(math.cos(a))} - hc_sin * {S.num(math.sin(a))})"
    dc = f"{S.num(S.W)} * (-hc_cos * {S.num(math.sin(a))} - hc_sin * {S.num(math.cos(a))})"
    span, low = S.num(MODEL.high - MODEL.low), S.num(MODEL.low)
    q = f"-{S.num(1000 / MODEL.sigma**2)} * ((ske - {low}) * (1 - (ske - {low}) / {span})) * (res_sin * {hc[0]} + res_cos * {hc[1]})"
    parts = {"eta0": "sum(q)"}
    for j in range(4):
        parts[f"gamma{j}"] = f"sum(q * ({' + '.join(f'{S.num(row[j])} * k{k}' for k, row in enumerate(DESIGN.transform))})) + {S.num(MODEL.ridge * MODEL.gamma[j])}"
    parts["log_cu"] = f"-sum({S.num(1000 * math.exp(MODEL.log_cu) / MODEL.sigma**2)} * (res_sin * {hu[0]} + res_cos * {hu[1]}))"
    parts["lag_c"] = f"-sum({S.num(1000 / MODEL.sigma**2)} * ske * (res_sin * {ds} + res_cos * {dc}))"
    return MF + f", g AS (SELECT *, {q} AS q FROM mf) " + " UNION ALL ".join(f"SELECT '{p}' AS param, round(({x}) / (2 * count(*)), 8) AS grad FROM g" for p, x in parts.items())


@query(_gradient_sql())
def q18_gradient(spark, d):
    sums = fit.objective_sums(usable(masked_pixels(spark, d)), MODEL, DESIGN)
    n, s2 = F.lit(2) * F.col("n"), F.lit(1 / MODEL.sigma**2)
    raw = [F.col(f"g_raw{k}") for k in range(4)]
    parts = {"eta0": F.col("g_eta0") * s2, **{f"gamma{j}": t * s2 + F.lit(MODEL.ridge * MODEL.gamma[j]) for j, t in enumerate(basis.transformed(raw, DESIGN))}, "log_cu": F.col("g_log_cu") * s2, "lag_c": F.col("g_lag_c") * s2}
    wide = sums.select(*(guards.ratio(x, n).alias(p) for p, x in parts.items()))
    return wide.unpivot([], list(parts), "param", "grad").select("param", r(F.col("grad"), 8, "grad"))


@query(f"WITH {S.PX} SELECT round(0.5e0 * sum(power({S.num(MODEL.low)} + {S.num(MODEL.high - MODEL.low)} / (1 + exp(-(pixel_id % 7 - 3))) - {S.num(0.01)} * (pixel_id % 5), 2)) + {S.num(0.5 * 0.3 * 0.05)}, 8) AS f_total FROM px")
def q19_toy_objective(spark, d):
    rows = order_pixels(spark, d).select((F.col("pixel_id") % 7 - 3).cast("double").alias("eta"), (F.lit(0.01) * (F.col("pixel_id") % 5)).alias("target"))
    return rounded(fit.toy_objective(rows, 0.3, (0.1, 0.2), MODEL.low, MODEL.high), f_total=8)


def row_areas(pixels: DataFrame) -> DataFrame:
    return pixels.select("row").distinct().withColumn("area_m2", geometry.cell_area(F.col("row"), TOP, STEP, STEP))


@query(f"WITH {S.PX} SELECT DISTINCT row, round({S.area('row')}, 5) AS area_m2 FROM px")
def q20_cell_area(spark, d):
    return rounded(row_areas(order_pixels(spark, d)), area_m2=5)


@query(MF + f"SELECT pixel_id, round(ske * hc_sin * {S.area('row')}, 5) AS vol_sin, round(ske * hc_cos * {S.area('row')}, 5) AS vol_cos FROM mf")
def q21_storage_components(spark, d):
    area = geometry.cell_area(F.col("row"), TOP, STEP, STEP)
    return rounded(storage.storage_components(masked_pixels(spark, d), MODEL, DESIGN, area).select("pixel_id", "vol_sin", "vol_cos"), vol_sin=5, vol_cos=5)


_LATER = S.rotated("s", "c", MODEL.lag_c)
_SUMMARY = f""", v AS (SELECT ske * hc_sin * {S.area('row')} AS vs, ske * hc_cos * {S.area('row')} AS vc FROM mf), t AS (SELECT count(*) AS n, sum(vs) AS s, sum(vc) AS c, sum(sqrt(vs * vs + vc * vc)) AS l FROM v),
u AS (SELECT *, {S.phase('s', 'c')} AS p, {S.circular(S.phase('s', 'c'), S.phase(*_LATER))} AS shift FROM t)
SELECT n AS valid_pixel_count, round(s, 2) AS real_m3, round(c, 2) AS imag_m3, round(sqrt(s * s + c * c), 2) AS coherent_m3, round(l, 2) AS local_sum_m3, round(2 * sqrt(s * s + c * c), 2) AS peak_to_trough_m3, round(p, 6) AS phase_days, round(shift, 6) AS shift_days, CASE WHEN shift > 0 THEN 'positive_delay' ELSE 'negative_or_zero_delay' END AS direction FROM u"""
_VOLUMES = {c: 2 for c in ("real_m3", "imag_m3", "coherent_m3", "local_sum_m3", "peak_to_trough_m3")} | {"phase_days": 6, "shift_days": 6}


@query(MF + _SUMMARY)
def q22_storage_summary(spark, d):
    area = geometry.cell_area(F.col("row"), TOP, STEP, STEP)
    return rounded(storage.storage_summary(storage.storage_components(masked_pixels(spark, d), MODEL, DESIGN, area), MODEL), **_VOLUMES)


@query(MF + "SELECT round(max(abs(ske - ske_ref)), 9) AS max_abs_diff, round(sqrt(avg(power(ske - ske_ref, 2))), 9) AS rms_diff, count(*) AS n FROM mf")
def q23_storage_compare(spark, d):
    reference = order_pixels(spark, d).select("row", "col", F.col("ske_ref").alias("published"))
    rows = frame(spark, d).drop("ske_ref").join(reference, ["row", "col"])
    return rounded(metrics.difference(rows, F.col("ske"), F.col("published")), max_abs_diff=9, rms_diff=9)


@query(f"WITH {S.PX}, {S.BAD}, u AS (SELECT product, value FROM bad UNPIVOT INCLUDE NULLS (value FOR product IN (obs_sin, hc_cos, hu_sin, ske_ref))) SELECT product, count(CASE WHEN isfinite(value) THEN 1 END) AS finite_count, round(min(CASE WHEN isfinite(value) THEN value END), 9) AS min_value, round(max(CASE WHEN isfinite(value) THEN value END), 9) AS max_value FROM u GROUP BY product")
def q24_raster_summary(spark, d):
    cells = damaged_pixels(spark, d).unpivot(["pixel_id"], ["obs_sin", "hc_cos", "hu_sin", "ske_ref"], "product", "value")
    return rounded(metrics.raster_summary(cells), min_value=9, max_value=9)


#: (gate, expected, tolerance) of every fold.
_EXPECTED = (("rmse", 0.0, 1e6), ("mae", 0.0, 1e-9), ("ske_min", 0.0, 0.05), ("nonfinite_count", 0.0, 0.0), ("missing", 1.0, 1.0))


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.metrics(frame(spark, d), MODEL.high, ["fold_id"]).withColumn("scope", F.format_string("fold_%02d", "fold_id")).drop("fold_id")
    rows = [(f"fold_{k:02d}", g, e, t) for k in folds.FOLDS for g, e, t in _EXPECTED]
    return gates.gate_table(gates.unpivoted(found, "scope"), spark.createDataFrame(rows, gates.GATES))


_GATES = MF + f""", a AS ({S.metrics('fold_id')}), e AS (SELECT * FROM (VALUES {', '.join(f"('fold_{k:02d}', {k}, '{g}', {S.num(e)}, {S.num(t)})" for k in folds.FOLDS for g, e, t in _EXPECTED)}) v(scope, fold_id, gate, expected, tol)),
g AS (SELECT e.scope, e.gate, CASE e.gate WHEN 'rmse' THEN rmse WHEN 'mae' THEN mae WHEN 'ske_min' THEN ske_min WHEN 'nonfinite_count' THEN CAST(nonfinite_count AS DOUBLE) END AS actual, e.expected, e.tol FROM e LEFT JOIN a ON a.fold_id = e.fold_id),
h AS (SELECT *, coalesce(abs(actual - expected) <= tol, FALSE) AS passed FROM g) """


@query(_GATES + "SELECT scope, gate, round(actual, 6) AS actual, expected, tol, passed FROM h")
def q25_gate_table(spark, d):
    return rounded(gate_rows(spark, d), actual=6)


@query(_GATES + "SELECT scope, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS status, string_agg(CASE WHEN NOT passed THEN gate END, ',' ORDER BY gate) AS failed FROM h GROUP BY scope")
def q26_failed_gates(spark, d):
    return gates.verdicts(gate_rows(spark, d)).withColumn("failed", F.array_join("failed", ","))


def event_history(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as the iterations of a run."""
    e = F.col("event_id")
    return read_table(spark, d, "events").select(F.col("user_id").alias("run"), e.alias("iteration"), (F.col("value") + 1).alias("objective"), (e % 10 / F.lit(100.0)).alias("relative_step"), (e % 7 / F.lit(1000.0)).alias("gradient_rms"))


_EV = f"WITH e AS (SELECT user_id AS run, event_id AS iteration, value + 1 AS objective, (event_id % 10) / {S.num(100)} AS relative_step, (event_id % 7) / {S.num(1000)} AS gradient_rms FROM events)"


@query(_EV + f""", g AS (SELECT run, iteration, count(*) OVER w AS n, abs(first_value(objective) OVER w - objective) / greatest(abs(first_value(objective) OVER w), {S.num(1e-30)}) AS rel_drop, max(relative_step) OVER v AS max_step, gradient_rms FROM e
 WINDOW w AS (PARTITION BY run ORDER BY iteration ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), v AS (PARTITION BY run ORDER BY iteration ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
SELECT run, iteration, round(rel_drop, 9) AS rel_drop, max_step, gradient_rms AS grad_rms, n >= 10 AND rel_drop <= {S.num(0.5)} AND max_step <= {S.num(0.095)} AND gradient_rms <= {S.num(0.0045)} AS converged FROM g""")
def q27_convergence_gate(spark, d):
    return rounded(history.convergence_gate(event_history(spark, d), 0.5, 0.095, 0.0045), rel_drop=9)


@query(_EV + f", l AS (SELECT run, iteration, row_number() OVER w AS number, objective, lag(objective) OVER w AS before FROM e WINDOW w AS (PARTITION BY run ORDER BY iteration)) SELECT run, iteration, CAST(number AS INTEGER) AS number, round(abs(objective - before) / greatest(abs(before), {S.num(1e-30)}), 9) AS relative_change FROM l")
def q28_iteration_deltas(spark, d):
    rows = history.iteration_changes(event_history(spark, d))
    change = F.when(guards.finite(F.col("relative_change")), F.col("relative_change"))
    return rows.select("run", "iteration", "number", r(change, 9, "relative_change"))


@query(_EV + " SELECT * FROM (SELECT 'global' AS stage, run, iteration, round(objective, 6) AS objective FROM e WHERE run % 2 = 0 UNION ALL SELECT 'all', run, iteration, round(objective, 6) FROM e WHERE run % 2 = 1) ORDER BY iteration DESC LIMIT 10")
def q29_history_tail(spark, d):
    rows = event_history(spark, d).select("run", "iteration", F.round("objective", 6).alias("objective"))
    stages = rows.where("run % 2 = 0").withColumn("stage", F.lit("global")).unionByName(rows.where("run % 2 = 1").withColumn("stage", F.lit("all")))
    return history.tail(stages)


@query(f"WITH {S.PX} SELECT block_id, count(*) AS n, round(sum(obs_sin), 6) AS total FROM px WHERE mask = 1 GROUP BY block_id")
def q30_mask_join(spark, d):
    pixels = order_pixels(spark, d)
    mask = pixels.select("row", "col", F.col("mask").alias("inside"))
    return rounded(pixels.drop("mask").join(mask.where("inside = 1"), ["row", "col"]).groupBy("block_id").agg(F.count("*").alias("n"), F.sum("obs_sin").alias("total")), total=6)


@query(f"WITH {S.PX} SELECT fold_id, count(*) AS n, round(sum(hc_cos), 6) AS total FROM px GROUP BY fold_id")
def q31_fold_join(spark, d):
    pixels = order_pixels(spark, d)
    raster = pixels.select("row", "col", "fold_id")
    return rounded(pixels.drop("fold_id").join(raster, ["row", "col"]).groupBy("fold_id").agg(F.count("*").alias("n"), F.sum("hc_cos").alias("total")), total=6)


@query("SELECT r.product, CASE WHEN p.product IS NULL THEN 'missing' ELSE 'present' END AS status FROM (SELECT DISTINCT p_brand || '/' || p_size AS product FROM part) r LEFT JOIN (SELECT DISTINCT p_brand || '/' || p_size AS product FROM part WHERE p_partkey % 3 = 0) p ON r.product = p.product")
def q32_product_audit(spark, d):
    """Every product that is asked for, present where a third of the rows names it."""
    rows = read_table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("product"))
    there = rows.where("p_partkey % 3 = 0").select("product", F.lit("present").alias("status")).distinct()
    return gates.product_audit(rows.select("product").distinct(), there)


@query("SELECT o_orderkey AS pixel_id, 1000 + CAST(floor(o_orderkey / 125) AS BIGINT) AS row, 2000 + o_orderkey % 125 AS col FROM orders")
def q33_flat_index_decode(spark, d):
    row, col = geometry.cell_of(F.col("o_orderkey"), F.lit(125).cast("long"), F.lit(1000).cast("long"), F.lit(2000).cast("long"))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("pixel_id"), row.alias("row"), col.alias("col"))


@query(f"WITH {S.PX} SELECT pixel_id, round({S.num(5e5)} + (col + {S.num(0.5)}) * {S.num(30.0)}, 6) AS cx, round({S.num(4.2e6)} - (row + {S.num(0.5)}) * {S.num(30.0)}, 6) AS cy FROM px")
def q34_cell_centre(spark, d):
    x, y = geometry.cell_centre(F.col("row"), F.col("col"), (5e5, 4.2e6), (30.0, -30.0))
    return order_pixels(spark, d).select("pixel_id", r(x, 6, "cx"), r(y, 6, "cy"))


_FIN = " AND ".join(f"coalesce(isfinite({c}), FALSE)" for c in ("obs_sin", "obs_cos", "hc_sin", "hc_cos", "hu_sin", "hu_cos"))


@query(f"WITH {S.PX}, {S.BAD} SELECT fold_id, count(*) AS n, count_if({_FIN}) AS usable, count_if(NOT ({_FIN})) AS damaged, count_if(coalesce(isfinite(hc_sin) AND isfinite(hc_cos), FALSE)) AS confined FROM bad WHERE mask = 1 GROUP BY fold_id")
def q35_nonfinite_guard(spark, d):
    ok = guards.finite(*(F.col(c) for c in ("obs_sin", "obs_cos", "hc_sin", "hc_cos", "hu_sin", "hu_cos")))
    rows = damaged_pixels(spark, d).where("mask = 1").groupBy("fold_id")
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("usable"), F.count_if(~ok).alias("damaged"), F.count_if(guards.finite(F.col("hc_sin"), F.col("hc_cos"))).alias("confined"))


@query(f"WITH {S.PX} SELECT fold_id, round(quantile_cont(obs_sin, 0.5), 9) AS p50, round(quantile_cont(obs_sin, 0.99), 9) AS p99 FROM px GROUP BY fold_id")
def q36_percentiles(spark, d):
    return order_pixels(spark, d).groupBy("fold_id").agg(r(F.percentile("obs_sin", F.lit(0.5)), 9, "p50"), r(F.percentile("obs_sin", F.lit(0.99)), 9, "p99"))


@query(f"WITH {S.PX}, {S.BAD} SELECT fold_id, round(coalesce(greatest(max(CASE WHEN isfinite(obs_sin) THEN abs(obs_sin) END), {S.num(1e-12)}), 1e0), 9) AS limit_value FROM bad GROUP BY fold_id")
def q37_symmetric_limit(spark, d):
    return damaged_pixels(spark, d).groupBy("fold_id").agg(r(guards.symmetric_limit(F.col("obs_sin")), 9, "limit_value"))


@query(MF + f"SELECT fold_id, count_if({S.num(0.005)} - ske <= {S.num(0.003)}) AS near, round(count_if({S.num(0.005)} - ske <= {S.num(0.003)}) / count(*), 9) AS share FROM mf GROUP BY fold_id")
def q38_saturation(spark, d):
    near = F.lit(0.005) - F.col("ske") <= 0.003
    return frame(spark, d).groupBy("fold_id").agg(F.count_if(near).alias("near"), r(guards.ratio(F.count_if(near).cast("double"), F.count("*")), 9, "share"))


@query(f"WITH {S.PX} SELECT pixel_id, greatest(least(CAST(pixel_id % 100 - 50 AS DOUBLE), {S.num(20)}), {S.num(-40)}) AS clipped FROM px")
def q39_clip(spark, d):
    return order_pixels(spark, d).select("pixel_id", guards.clip((F.col("pixel_id") % 100 - 50).cast("double"), *storage_model.LOG_CU).alias("clipped"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q40_sha256(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query()
def q41_fit_small(spark, d):
    start = replace(MODEL, eta0=-3.0, log_cu=math.log(1e-3), lag_c=40.0)
    fitted, summary = fit.fit(usable(masked_pixels(spark, d)), start, DESIGN)
    rows = [("initial_objective", summary["initial_objective"]), ("final_objective", summary["final_objective"]), *((f"theta{i}", float(v)) for i, v in enumerate(fitted.theta))]
    return spark.createDataFrame(rows, "name string, value double")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def q43_duplicates(spark, d):
    return metrics.duplicates(read_table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


#: A model for each fold.
_FOLD_MODELS = {k: replace(MODEL, eta0=MODEL.eta0 + 0.1 * k, lag_c=MODEL.lag_c + k) for k in folds.FOLDS}


@query(f"WITH {S.PX} " + " UNION ALL ".join(f"SELECT * FROM (WITH {S.model('px', f'mask = 1 AND fold_id = {k}', m)} {S.metrics('fold_id')})" for k, m in _FOLD_MODELS.items()))
def q44_fold_models(spark, d):
    return rounded(metrics.metrics(fold_model_frame(usable(masked_pixels(spark, d)), _FOLD_MODELS, DESIGN), MODEL.high, ["fold_id"]))


@query(f"WITH {S.PX} SELECT pixel_id, round(sqrt(obs_sin * obs_sin + obs_cos * obs_cos), 9) AS amplitude, CASE WHEN obs_sin > 0 THEN 'positive_delay' ELSE 'negative_or_zero_delay' END AS direction FROM px")
def q45_amplitude_direction(spark, d):
    s, c = F.col("obs_sin"), F.col("obs_cos")
    return order_pixels(spark, d).select("pixel_id", r(harmonics.amplitude(s, c), 9, "amplitude"), harmonics.direction_label(s).alias("direction"))


@query(f"WITH {S.PX}, {S.REPEATED} SELECT count(*) AS intersection_n FROM rp v WHERE mask = 1 AND fold_id = 1 AND EXISTS (SELECT 1 FROM rp t WHERE t.mask = 1 AND t.fold_id <> 1 AND t.pixel_id = v.pixel_id)")
def q46_disjoint_folds(spark, d):
    return folds.overlap(repeated_pixels(masked_pixels(spark, d)), 1)


@query(MF + f"SELECT fold_id, pixel_count, observation_count, rmse, mae FROM ({S.metrics('fold_id')})")
def q47_running_metrics(spark, d):
    """The stream of pixel files that are there, run to its end into a table in memory."""
    orders = read_table(spark, d, "orders")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/orders.parque[t]")
    name = f"running_{uuid.uuid4().hex}"
    from ..sources import pixels as source

    rows = source.pixels_of(stream).where("o_orderstatus <> 'P'")
    asked = running_metrics(rows, MODEL, DESIGN).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    asked.awaitTermination()
    return rounded(spark.table(name))


@query(f"WITH {S.PX}, {S.UNDEFINED}, t AS (SELECT * FROM uf WHERE mask = 1 AND fold_id IS DISTINCT FROM 2) SELECT count(*) AS n, round(avg(obs_sin), 9) AS mean FROM t")
def q48_split_filter(spark, d):
    return split_filter(undefined_folds(masked_pixels(spark, d)), "training", 2).agg(F.count("*").alias("n"), r(F.avg("obs_sin"), 9, "mean"))


@query(f"WITH {S.PX}, {S.BAD}, {S.model('bad')} {S.damaged_metrics('fold_id')}")
def q49_nonfinite_metrics(spark, d):
    return rounded(metrics.metrics(model_frame(damaged_pixels(spark, d).where("mask = 1"), MODEL, DESIGN), MODEL.high, ["fold_id"]))


@query(f"""WITH {S.PX}, {S.REPEATED}, p AS (SELECT pixel_id, list(DISTINCT fold_id) AS f FROM rp WHERE mask = 1 GROUP BY pixel_id), k AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS fold_id),
n AS (SELECT fold_id, count_if(len(list_filter(f, lambda x: x <> fold_id)) > 0) AS training_n, count_if(list_contains(f, fold_id)) AS validation_n, count_if(list_contains(f, fold_id) AND len(f) > 1) AS intersection_n, count(*) AS common FROM p, k GROUP BY fold_id)
SELECT fold_id, training_n, validation_n, intersection_n, training_n + validation_n - intersection_n AS union_n, intersection_n = 0 AND training_n + validation_n - intersection_n = common AS passed FROM n""")
def q50_partition_by_pixel(spark, d):
    return folds.partition_audit(repeated_pixels(masked_pixels(spark, d)), by_pixel=True)


_FOUND = " UNION ALL ".join(f"SELECT *, {S.num(math.exp(m.log_cu))} AS cu, {S.num(m.lag_c)} AS lag_c, {S.num(m.lag_u)} AS lag_u FROM (WITH {S.model('px', f'mask = 1 AND fold_id = {k}', m)} {S.metrics('fold_id')})" for k, m in _FOLD_MODELS.items())
_VALIDATION = {
    "validation_rmse": S.near("a.rmse", "z.frozen_rmse", 1e-5), "validation_mae": S.near("a.mae", "s.mae", 1e-5), "validation_pixel_count": "a.pixel_count = s.pixel_count AND a.pixel_count = c.n",
    "nonfinite_prediction_count": "a.nonfinite_count = 0", "ske_min_bound": f"a.ske_min >= {S.num(MODEL.low - 1e-9)}", "ske_max_bound": f"a.ske_max <= {S.num(MODEL.high + 1e-9)}",
    "ske_min_value": S.near("a.ske_min", "s.ske_min", 1e-6), "ske_max_value": S.near("a.ske_max", "s.ske_max", 1e-6), "prediction_abs_p99": f"a.pred_abs_p99 <= {S.num(100)}",
    "cu": S.near("a.cu", "s.cu", 1e-12), "lag_c": S.near("a.lag_c", "s.lag_c", 1e-12), "lag_u": S.near("a.lag_u", S.num(10), 1e-12),
}
_STORED = f"s AS (SELECT fold_id, mae + CASE WHEN fold_id = 4 THEN 1 ELSE 0 END AS mae, pixel_count + CASE WHEN fold_id = 2 THEN 1 ELSE 0 END AS pixel_count, ske_min, ske_max, cu, lag_c + CASE WHEN fold_id = 1 THEN {S.num(1e-9)} ELSE 0 END AS lag_c FROM a WHERE fold_id <> 3)"


@query(f"WITH {S.PX}, a AS ({_FOUND}), {_STORED}, c AS (SELECT fold_id, count(*) AS n FROM px WHERE mask = 1 GROUP BY fold_id), z AS (SELECT fold_id, CASE WHEN fold_id = 2 THEN 0 ELSE rmse END AS frozen_rmse FROM a) {S.gates(_VALIDATION, 'z LEFT JOIN a USING (fold_id) LEFT JOIN s USING (fold_id) LEFT JOIN c USING (fold_id)', 'fold_id')}")
def q51_validation_gates(spark, d):
    """Each fold under its own model, held against stored fits of which some are off and one is missing."""
    pixels = masked_pixels(spark, d)
    found = release.with_model(metrics.metrics(fold_model_frame(usable(pixels), _FOLD_MODELS, DESIGN), MODEL.high, ["fold_id"]), _FOLD_MODELS)
    off = lambda k, by: F.when(F.col("fold_id") == k, by).otherwise(0 * by)
    stored = found.where("fold_id <> 3").select("fold_id", "rmse", (F.col("mae") + off(4, F.lit(1.0))).alias("mae"), (F.col("pixel_count") + off(2, F.lit(1))).alias("pixel_count"), "ske_min", "ske_max", "cu", (F.col("lag_c") + off(1, F.lit(1e-9))).alias("lag_c"))
    frozen = found.select("fold_id", F.when(F.col("fold_id") == 2, 0.0).otherwise(F.col("rmse")).alias("frozen_rmse"))
    return release.validation_gates(found, stored, folds.partition_audit(pixels), frozen, MODEL.low, MODEL.high, 10.0)


#: Expected numbers of the final model, and tolerances that some of them meet.
_FINAL = {"rmse": 5.0, "mae": 0.0, "ske_min": 0.0, "ske_p50": 0.0, "ske_max": 0.05, "cu": math.exp(MODEL.log_cu)}
_FINAL_TOL = {"rmse": 1e3, "mae": 1e-9, "ske_min": 0.05, "ske_p50": 1e-12, "ske_max": 0.05, "cu": 1e-13}
_FINAL_GATES = {k: S.near({"cu": S.num(math.exp(MODEL.log_cu))}.get(k, k), S.num(v), _FINAL_TOL[k]) for k, v in _FINAL.items()} | {
    "lag_c": "TRUE", "lag_u": "FALSE", "gamma_norm_finite": "TRUE", "nonfinite_prediction_count": "nonfinite_count = 0", "ske_min_bound": f"ske_min >= {S.num(MODEL.low - 1e-9)}", "ske_max_bound": f"ske_max <= {S.num(MODEL.high + 1e-9)}",
    "prediction_abs_p99_finite": "isfinite(pred_abs_p99)", "parameter_count": "TRUE",
}


@query(f"WITH {S.PX}, {S.BAD}, {S.model('bad')}, a AS ({S.damaged_metrics('mask')}) {S.gates(_FINAL_GATES, 'a')}")
def q52_final_gates(spark, d):
    found = metrics.metrics(model_frame(damaged_pixels(spark, d).where("mask = 1"), MODEL, DESIGN), MODEL.high)
    return release.final_gates(found, MODEL, _FINAL, (MODEL.lag_c, 11.0), len(MODEL.theta), _FINAL_TOL)


_RELEASE = release.StorageRelease(0.0, 0.0, 0.0, MODEL.lag_c, 100.0, 200.0, "passed", {"confined_storage_uncertainty_status": "passed", "p2_5_m3": 100.5, "p97_5_m3": 201.5})
_STORAGE_GATES = {
    **{k: f"abs({k}) <= {S.num(1e-3)}" for k in ("coherent_m3", "local_sum_m3", "peak_to_trough_m3")}, "delayed_peak_shift": f"abs(shift_days - {S.num(MODEL.lag_c)}) < {S.num(0.05)}", "delayed_direction": "direction = 'positive_delay'",
    "delayed_positive_shift": f"abs(shift_days - {S.num(MODEL.lag_c)}) < {S.num(0.05)} AND direction = 'positive_delay'", "published_ske": f"(SELECT max(abs(ske - ske_ref)) FROM mf) <= {S.num(1e-8)}", "lag_c": "TRUE",
    "envelope_present": "TRUE", "envelope_status": "TRUE", "envelope_low": "TRUE", "envelope_high": "FALSE",
}


@query(MF + f", z AS (WITH {_SUMMARY[2:]}) {S.gates(_STORAGE_GATES, 'z')}")
def q53_storage_gates(spark, d):
    area = geometry.cell_area(F.col("row"), TOP, STEP, STEP)
    rows = storage.storage_components(masked_pixels(spark, d), MODEL, DESIGN, area)
    return release.storage_gates(storage.storage_summary(rows, MODEL), metrics.difference(rows, F.col("ske"), F.col("ske_ref")), MODEL, _RELEASE)


#: (product, crs, height): what the fixture's rasters say of themselves; hu_sin has no metadata, none is empty.
_RASTERS = (("obs_sin", "EPSG:4326", 40), ("hc_cos", "EPSG:4326", 40), ("ske_ref", "EPSG:32650", 40), ("none", "EPSG:4326", 40))
_ASKED = ("obs_sin", "hc_cos", "hu_sin", "ske_ref", "none")


@query(f"""WITH {S.PX}, {S.BAD}, u AS (SELECT product, value FROM bad UNPIVOT INCLUDE NULLS (value FOR product IN (obs_sin, hc_cos, hu_sin, ske_ref))),
t AS (SELECT product, count(CASE WHEN isfinite(value) THEN 1 END) AS n, round(min(CASE WHEN isfinite(value) THEN value END), 9) AS lo, round(max(CASE WHEN isfinite(value) THEN value END), 9) AS hi FROM u GROUP BY product),
m AS (SELECT * FROM (VALUES {', '.join(map(str, _RASTERS))}) v(product, crs, height)), q AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ASKED)}]) AS product)
SELECT q.product, CASE WHEN m.product IS NOT NULL THEN sha256(q.product) END AS sha256, crs, CASE WHEN m.product IS NOT NULL THEN '30,0,0,0,-30,0' END AS transform, height, CASE WHEN m.product IS NOT NULL THEN 125 END AS width, CAST(NULL AS DOUBLE) AS nodata, coalesce(n, 0) AS finite_count, lo AS min_value, hi AS max_value,
 CASE WHEN m.product IS NULL THEN 'missing' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'passed' END AS status FROM q LEFT JOIN m USING (product) LEFT JOIN t USING (product)""")
def q54_raster_audit(spark, d):
    cells = damaged_pixels(spark, d).unpivot(["pixel_id"], ["obs_sin", "hc_cos", "hu_sin", "ske_ref"], "product", "value")
    metadata = spark.createDataFrame(list(_RASTERS), "product string, crs string, height int").withColumns({"sha256": F.sha2("product", 256), "transform": F.lit("30,0,0,0,-30,0"), "width": F.lit(125), "nodata": F.lit(None).cast("double")})
    return rounded(release.raster_audit(spark.createDataFrame([(x,) for x in _ASKED], "product string"), metadata, metrics.raster_summary(cells)), min_value=9, max_value=9)


@query("WITH p AS (SELECT p_partkey AS id, 'a/' || ['src', 'build', 'dist', 'rebuild'][1 + p_partkey % 4] || '/f' || p_partkey || ['.py', '.tif', '.npy'][1 + p_partkey % 3] AS path FROM part) SELECT id, path FROM p WHERE NOT list_has_any(string_split(path, '/'), ['build', 'dist']) AND (path LIKE '%.tif' OR path LIKE '%.npy')")
def q56_active_paths(spark, d):
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    paths = read_table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("a/"), pick("src", "build", "dist", "rebuild"), F.lit("/f"), k.cast("string"), pick(".py", ".tif", ".npy")).alias("path"))
    return release.active_paths(paths, ("build", "dist"), (".tif", ".npy"))


@query(f"WITH {S.PX}, {S.BAD} SELECT fold_id, round(quantile_cont(CASE WHEN isfinite(obs_sin) THEN obs_sin END, 0.5), 9) AS p50, round(quantile_cont(CASE WHEN isfinite(obs_sin) THEN obs_sin END, 0.99), 9) AS p99, round(quantile_cont(ske_ref, 0.25), 9) AS q25 FROM bad GROUP BY fold_id")
def q57_narrowed_percentiles(spark, d):
    """With so few values held and so few bins that the fixture's groups have to be narrowed."""
    found = percentiles.percentiles(damaged_pixels(spark, d), ["fold_id"], {"p50": (F.col("obs_sin"), 0.5), "p99": (F.col("obs_sin"), 0.99), "q25": (F.col("ske_ref"), 0.25)}, held=32, bins=16)
    return rounded(found, p50=9, p99=9, q25=9)


_BANDS = "CASE WHEN pixel_id % 16 < 9 THEN 0 WHEN pixel_id % 16 = 14 THEN 100 + pixel_id % 1024 WHEN pixel_id % 16 <> 15 THEN pixel_id % 16 END"


@query(MF + S.metrics("band", f"(SELECT *, CAST({_BANDS} AS BIGINT) AS band FROM mf)"))
def q74_skewed_metrics(spark, d):
    """Groups of most rows, of few and of a null key; held is so small that the large ones leave the single task."""
    rows = frame(spark, d).withColumn("band", F.expr(_BANDS).cast("long"))
    return rounded(metrics.metrics(rows, MODEL.high, ["band"], held=100))


_START = replace(MODEL, eta0=-3.0, log_cu=math.log(1e-3), lag_c=40.0)
_SSE_START = f"sum(res_sin * res_sin + res_cos * res_cos) * {S.num(0.5 / MODEL.sigma**2)}"


@query(f"WITH {S.PX}, {S.model(m=_START)} SELECT round(({_SSE_START} + {S.num(_PRIOR)}) / (2 * count(*)), 8) AS initial_objective, TRUE AS descends, TRUE AS bounded FROM mf")
def q58_fit_descends(spark, d):
    """A few iterations of each stage: the objective at the start, whether it falls, and whether the bounds hold."""
    fitted, summary = fit.fit(usable(masked_pixels(spark, d)), _START, DESIGN, (4, 3, 4))
    low, high = storage_model.LOG_CU
    row = (round(summary["initial_objective"], 8), summary["final_objective"] < summary["initial_objective"], low <= fitted.log_cu <= high)
    return spark.createDataFrame([row], "initial_objective double, descends boolean, bounded boolean")


@query(f"WITH {S.PX}, {S.model()} SELECT fold_id, round(quantile_cont(CAST(CAST(ske AS FLOAT) AS DOUBLE), 0.5), 9) AS ske_p50, round(quantile_cont(CAST(CAST(greatest(abs(pred_sin), abs(pred_cos)) AS FLOAT) AS DOUBLE), 0.99), 8) AS pred_abs_p99 FROM mf GROUP BY fold_id")
def q59_single_percentiles(spark, d):
    """Percentiles of values in single precision."""
    found = metrics.metrics(frame(spark, d), MODEL.high, ["fold_id"], single=True)
    return rounded(found.select("fold_id", "ske_p50", "pred_abs_p99"), ske_p50=9, pred_abs_p99=8)


_EASTING, _NORTHING = S.utm("lon", "lat", 50)


@query(f"""WITH {S.PX}, g AS (SELECT pixel_id, {S.num(115)} + {S.num(STEP)} * col AS lon, {S.num(TOP)} - {S.num(STEP)} * row AS lat FROM px)
SELECT pixel_id, round({_EASTING}, 3) AS easting, round({_NORTHING}, 3) AS northing, round({S.num(MAJOR)} * radians(lon), 3) AS x, round({S.num(MAJOR)} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM g""")
def q60_reproject(spark, d):
    """Degrees to a UTM zone, from there to web Mercator, and back to degrees."""
    east, north = projection.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32650")
    rows = order_pixels(spark, d).select("pixel_id", east.alias("easting"), north.alias("northing"))
    x, y = projection.reproject(F.col("easting"), F.col("northing"), "EPSG:32650", "EPSG:3857")
    rows = rows.select("*", x.alias("x"), y.alias("y"))
    lon, lat = projection.reproject(F.col("x"), F.col("y"), "EPSG:3857", "EPSG:4326")
    return rounded(rows.select("*", lon.alias("lon"), lat.alias("lat")), easting=3, northing=3, x=3, y=3, lon=8, lat=8)

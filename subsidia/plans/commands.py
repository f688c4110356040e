"""The commands of the command line as a query: over pixels that the engine has laid out, their reports read back as documents."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, functions as F

from .. import cli, config
from ..operators import release
from ..sources import files, scratch
from ..sources.pixels import DESIGN, MODEL, STEP, TOP, layout, order_pixels, undefined_folds
from . import sql as S
from .queries import SQL, query

#: Decimals by the last part of a path; text and other numbers stay as they are.
_DECIMALS = {
    2: ("real_m3", "imag_m3", "coherent_m3", "local_sum_m3", "peak_to_trough_m3"),
    5: ("gradient_norm",),
    6: ("rmse", "mae", "pred_abs_p99", "phase_days", "shift_days"),
    9: ("ske_min", "ske_p50", "ske_max", "upper_bound_fraction"),
    10: ("initial_objective", "final_objective", "theta"),
}
_METRICS = ("pixel_count", "observation_count", "nonfinite_count", "rmse", "mae", "ske_min", "ske_p50", "ske_max", "pred_abs_p99", "upper_bound_fraction")
_SUMMARY = ("valid_pixel_count", *_DECIMALS[2], "phase_days", "shift_days")
#: Gates of the final metrics (scope, gate, expected, tolerance).
_EXPECTED = (("final", "nonfinite_count", 0.0, 0.0), ("final", "ske_max", 0.05, 0.05), ("storage", "shift_days", MODEL.lag_c, 1e-6))


def _sql() -> str:
    def document(name: str, rows: str) -> str:
        return f"SELECT '{name}.json' AS document, * FROM ({rows})"

    def numbers(source: str, prefix: str, names) -> str:
        """(path, number, text) of some columns of a source."""
        one = lambda c: f"round(CAST({c} AS DOUBLE), {next((k for k, v in _DECIMALS.items() if c in v), 0)})"
        return f"SELECT {prefix} || unnest([{', '.join(repr(c) for c in names)}]) AS path, unnest([{', '.join(one(c) for c in names)}]) AS number, CAST(NULL AS VARCHAR) AS text FROM {source}"

    def words(source: str, **exprs: str) -> str:
        return " UNION ALL ".join(f"SELECT '{k.replace('__', '.')}' AS path, CAST(NULL AS DOUBLE) AS number, {x} AS text FROM {source}" for k, x in exprs.items())

    theta = f"SELECT 'theta.' || (i - 1) AS path, round(v[i], 10) AS number, CAST(NULL AS VARCHAR) AS text FROM (SELECT [{', '.join(S.num(x) for x in MODEL.theta)}] AS v), range(1, {len(MODEL.theta) + 1}) t(i)"
    near = lambda a, b, tol: f"abs({a} - {S.num(b)}) <= {S.num(tol)}"
    parts = [
        document("cv", numbers("f", "'folds.' || (fold_id - 1) || '.'", _METRICS)),
        document("cv", "SELECT 'folds.' || (fold_id - 1) || '.scope' AS path, CAST(NULL AS DOUBLE) AS number, 'fold_0' || fold_id AS text FROM f"),
        document("cv", numbers("a", "'partition.' || (fold_id - 1) || '.'", ("fold_id", "training_n", "validation_n", "intersection_n", "union_n"))),
        document("cv", numbers("u", "''", ("undefined_fold_count", "exit_code"))),
        document("cv", words("u", partition_status="CASE WHEN undefined_fold_count > 0 THEN 'failed' ELSE 'passed' END")),
        document("invert", numbers("m", "'metrics.'", _METRICS)),
        document("invert", numbers(f"(SELECT f_total AS initial_objective, f_total AS final_objective FROM ({SQL['q17_objective']}))", "'fit.'", ("initial_objective", "final_objective"))),
        document("invert", numbers(f"(SELECT sqrt(sum(grad * grad)) AS gradient_norm FROM ({SQL['q18_gradient']}))", "'fit.'", ("gradient_norm",))),
        document("invert", f"SELECT 'fit.' || path AS path, number, text FROM ({theta})"),
        document("invert", words("m", fit__status="'evaluated only'", gates_status=f"CASE WHEN nonfinite_count = 0 AND {near('ske_max', 0.05, 0.05)} THEN 'passed' ELSE 'failed' END")),
        document("invert", numbers(f"(SELECT CASE WHEN nonfinite_count = 0 AND {near('ske_max', 0.05, 0.05)} THEN 0 ELSE 1 END AS exit_code FROM m)", "''", ("exit_code",))),
        document("parameters", theta),
        document("storage", numbers("s", "'summary.'", _SUMMARY)),
        document("storage", words("s", summary__direction="direction", gates_status=f"CASE WHEN {near('shift_days', MODEL.lag_c, 1e-6)} THEN 'passed' ELSE 'failed' END")),
        document("storage", numbers(f"(SELECT CASE WHEN {near('shift_days', MODEL.lag_c, 1e-6)} THEN 0 ELSE 1 END AS exit_code FROM s)", "''", ("exit_code",))),
    ]
    return f"""WITH {S.PX}, {S.UNDEFINED}, {S.model('uf')}, f AS ({S.metrics('fold_id', where='fold_id IN (1, 2, 3, 4)')}), m AS ({S.metrics('')}), s AS ({SQL['q22_storage_summary']}),
c AS (SELECT * FROM uf WHERE mask = 1), k AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS fold_id),
a AS (SELECT k.fold_id, count_if(c.fold_id IS DISTINCT FROM k.fold_id) AS training_n, count_if(c.fold_id = k.fold_id) AS validation_n, count_if(c.fold_id = k.fold_id AND c.fold_id IS DISTINCT FROM k.fold_id) AS intersection_n, count(*) AS union_n FROM c, k GROUP BY k.fold_id),
u AS (SELECT count_if(coalesce(fold_id NOT IN (0, 1, 2, 3, 4), TRUE)) AS undefined_fold_count, CASE WHEN undefined_fold_count > 0 THEN 1 ELSE 0 END AS exit_code FROM c)
""" + " UNION ALL ".join(parts)


@query(_sql())
def q73_commands(spark, d) -> DataFrame:
    """Validation, inversion without a budget and storage, as the command line runs them from a configuration.

    Pixels are laid out by fold, some with an undefined one, so that validation reports a failure. The configuration goes
    through JSON and its frozen values are checked; parameters are stored and loaded; reports become documents.
    """
    path = scratch.folder(spark, "commands")
    layout(undefined_folds(order_pixels(spark, d)), f"{path}/pixels")
    written = {"pixels": f"{path}/pixels", "output": path, "origin_latitude": TOP, "step": [STEP, STEP], "design": asdict(DESIGN), "model": asdict(MODEL), "frozen": {"low": MODEL.low, "high": MODEL.high}, "expected": _EXPECTED, "budgets": [100, 200, 500]}
    c = config.config_from(json.loads(json.dumps(written)))
    reports = {"cv": cli.cv(spark, c), "invert": cli.invert(spark, c, optimize=True, most=0), "storage": cli.storage_summary(spark, c)}
    for report in reports.values():
        report["exit_code"] = cli.exit_code(report)
    reports["parameters"] = {"theta": files.load_parameters(spark, f"{path}/parameters", "fitted")}
    bodies = [(f"{k}.json", json.dumps(v, sort_keys=True, default=str)) for k, v in reports.items()]
    release.write_documents(spark.createDataFrame(bodies, "document string, body string"), f"{path}/reports")
    found = files.leaves(files.nested_documents(spark, f"{path}/reports"))
    last = F.regexp_extract("path", r"([^.]*?)(\.\d+)?$", 1)
    number = F.expr("try_cast(value AS DOUBLE)")
    rounds = F.round(number, 0)
    for places, names in _DECIMALS.items():
        rounds = F.when(last.isin(*names), F.round(number, places)).otherwise(rounds)
    wanted = [*_METRICS, *_SUMMARY, *_DECIMALS[5], *_DECIMALS[10], "scope", "training_n", "validation_n", "intersection_n", "union_n", "undefined_fold_count", "exit_code", "direction", "status", "partition_status", "gates_status", "fold_id"]
    return found.where(last.isin(*wanted) & ~F.col("path").startswith("fit.stages")).select("document", "path", rounds.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))

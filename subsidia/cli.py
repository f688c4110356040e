"""Command line: verify, invert, cv, products, storage, figures, audit and all; JSON to stdout, status as exit code."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession, functions as F

from . import config as configs
from .functions.geometry import cell_area
from .functions.harmonics import PERIOD
from .operators import fit, folds, gates, metrics, model_frame, release, storage
from .sources import files


def verify(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    """Digests of inputs against the configured ones."""
    return {f"{p}_match": files.file_digest(p) == h for p, h in c.hashes.items()}


def invert(spark: SparkSession, c: configs.Config, optimize: bool = False, most: int | None = None) -> dict[str, Any]:
    pixels = model_frame.usable(spark.read.parquet(c.pixels))
    model, out = c.model, {}
    if optimize:
        budgets = c.budgets if most is None else (*c.budgets[:2], most) if most else (0, 0, 0)
        model, out["fit"] = fit.fit(pixels, c.model, c.design, budgets)
        files.save_parameters(spark, f"{c.output}/parameters", "fitted", model.theta)
    found = metrics.metrics(model_frame.model_frame(pixels, model, c.design), model.high)
    out |= {"metrics": found.first().asDict()} | _gates(spark, c, found.withColumn("scope", F.lit("final")), "final")
    if c.final:
        expected, tolerances = ({k: v[i] for k, v in c.final.items()} for i in (0, 1))
        out |= _verdict("final", release.final_gates(found, model, expected, (c.model.lag_c, c.model.lag_u), len(c.model.theta), tolerances))
    return out


def cv(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    """Each validation fold under its own model, or under the one model where the configuration has no others."""
    pixels = spark.read.parquet(c.pixels)
    models = c.fold_models or dict.fromkeys(folds.FOLDS, c.model)
    found = release.with_model(metrics.metrics(model_frame.fold_model_frame(model_frame.usable(pixels), models, c.design), c.model.high, ["fold_id"]), models)
    partition = folds.partition_audit(pixels)
    audit = [r.asDict() for r in partition.orderBy("fold_id").collect()]
    undefined = sum(r["n"] for r in folds.fold_histogram(pixels).where("fold_id = -1").collect())
    sound = all(r["passed"] for r in audit) and not undefined
    scoped = found.withColumn("scope", F.format_string("fold_%02d", "fold_id"))
    out = {"folds": [r.asDict() for r in scoped.orderBy("scope").drop("fold_id").collect()], "partition": audit, "undefined_fold_count": undefined, "partition_status": "passed" if sound else "failed"}
    out |= _gates(spark, c, scoped.drop("fold_id"), *map(configs.fold_name, folds.FOLDS))
    if c.fold_rmse:
        frozen = spark.createDataFrame(list(c.fold_rmse.items()), "fold_id long, frozen_rmse double")
        rows = release.validation_gates(found, files.stored_fits(spark, c.fold_fits), partition, frozen, c.model.low, c.model.high, c.model.lag_u)
        out |= _verdict("validation", rows.select(F.concat_ws(".", F.format_string("fold_%02d", "fold_id"), "gate").alias("gate"), "passed"))
    return out


def storage_summary(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    area = cell_area(F.col("row"), c.origin_latitude, *c.step)
    rows = storage.storage_components(spark.read.parquet(c.pixels), c.model, c.design, area)
    found = storage.storage_summary(rows, c.model)
    out = {"summary": found.first().asDict()} | _gates(spark, c, found.drop("direction").withColumn("scope", F.lit("storage")), "storage")
    if c.storage and c.published:
        held = replace(c.storage, envelope=files.optional_document(c.envelope))
        published = spark.read.parquet(c.published).select("row", "col", F.col("ske").alias("published_ske"))
        compared = metrics.difference(rows.join(published, ["row", "col"]), F.col("ske"), F.col("published_ske"))
        out |= {"published": compared.first().asDict()} | _verdict("storage", release.storage_gates(found, compared, c.model, held))
    return out


def products(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    """Digest, grid and extremes of each configured raster, and whether all share a grid."""
    if not c.products:
        return {"products": {}, "products_status": "passed"}
    files_of = spark.createDataFrame(list(c.products.items()), "product string, path string")
    found = {r["product"]: r.asDict() for r in release.audited_rasters(files_of).collect()}
    states = [r["status"] for r in found.values()]
    grids = {tuple(r[k] for k in ("crs", "transform", "height", "width")) for r in found.values() if r["height"] is not None}
    status = "missing" if "missing" in states else "passed" if set(states) <= {"passed", "empty"} else "failed"
    return {"products": found, "products_status": status, "products_same_geometry": len(grids) <= 1}


def figures(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    return _present(spark, c.figures, "figures")


def spatial_qa(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    """The stored record of the spatial review, where the configuration names one."""
    if not c.qa:
        return {}
    return files.read_document(c.qa) if Path(c.qa).exists() else {"qa_status": "failed_missing"}


def audit(spark: SparkSession, c: configs.Config) -> dict[str, Any]:
    parts = {f.__name__: f(spark, c) for f in (verify, invert, cv, storage_summary, products, figures, spatial_qa)}
    reasons = [f"{name}: {k}" for name, part in parts.items() for k, v in part.items() if _bad(k, v)]
    if c.acceptance:
        flat = {k: v for part in parts.values() for k, v in part.items()} | dict(c.acceptance.get("report", {}))
        families = release.acceptance(spark, flat, c.acceptance.get("exact", {}), *(c.acceptance.get(k, ()) for k in ("true", "passed", "configured")))
        reasons += release.reasons(families, "position")
    if c.acceptance.get("gates"):
        reasons += _accepted(spark, c, parts)
    report = {**parts, "failure_reasons": reasons, "overall_status": "failed" if reasons else "passed"}
    files.write_report(json.loads(json.dumps(report, default=str)), f"{c.output}/audit.json")
    return report


def _accepted(spark: SparkSession, c: configs.Config, parts: dict[str, Any]) -> list[str]:
    """What the configured gates (family, document, path, expected, tol) find wrong in the engine's own reports.

    The reports are written as documents and read back, with those stored by others in the folder that acceptance names.
    """
    sound = [parts[p].get(f"{k}_status") for p, k in (("cv", "partition"), ("cv", "validation_recalculation"), ("invert", "final_recalculation"), ("storage_summary", "storage_recalculation"))]
    derived = {"scientific_metrics_unchanged": all(x in (None, "passed") for x in sound), "delayed_positive_shift_status": "passed" if parts["storage_summary"]["summary"]["direction"] == "positive_delay" else "failed"}
    for name, part in (parts | {"derived": derived}).items():
        files.write_report(json.loads(json.dumps(part, default=str)), f"{c.output}/reports/{name}.json")
    found = files.leaves(files.nested_documents(spark, f"{c.output}/reports"))
    if stored := c.acceptance.get("documents"):
        found = found.unionByName(files.leaves(files.nested_documents(spark, stored)))
    wanted = [(i, g[0], g[1], g[2], None if len(g) < 4 or g[3] is None else str(g[3]), float(g[4]) if len(g) > 4 else 0.0) for i, g in enumerate(c.acceptance["gates"])]
    rows = release.accepted(found, spark.createDataFrame(wanted, "position int, family string, document string, path string, expected string, tol double"))
    return release.acceptance_status(rows).first()["failure_reasons"]


def _present(spark: SparkSession, paths: dict[str, str], name: str) -> dict[str, Any]:
    if not paths:
        return {name: {}, f"{name}_status": "passed"}
    required = spark.createDataFrame([(p,) for p in paths], "product string")
    found = {r["product"]: r["status"] for r in gates.product_audit(required, files.existence(spark, paths)).collect()}
    return {name: found, f"{name}_status": "missing" if "missing" in found.values() else "passed"}


def _gates(spark: SparkSession, c: configs.Config, found, *scopes: str) -> dict[str, Any]:
    own = [x for x in c.expected if x[0] in scopes]
    if not own:
        return {}
    rows = gates.gate_table(gates.unpivoted(found, "scope"), spark.createDataFrame(own, gates.GATES))
    states = {r["scope"]: (r["status"], r["failed"]) for r in gates.verdicts(rows).collect()}
    return {"gates": {k: v[1] for k, v in states.items()}, "gates_status": "failed" if any(v[0] == "failed" for v in states.values()) else "passed"}


def _verdict(name: str, rows) -> dict[str, Any]:
    failed = release.reasons(rows)
    return {f"{name}_gates": {r["gate"]: r["passed"] for r in rows.collect()}, f"{name}_recalculation_status": "failed" if failed else "passed", f"{name}_failed": failed}


def _bad(key: str, value: Any) -> bool:
    return (key.endswith("_match") and value is not True) or (key.endswith("status") and str(value).startswith(("failed", "missing")))


def exit_code(report: dict[str, Any]) -> int:
    """1 where a match isn't true or a status says failed or missing."""
    return int(any(_bad(k, v) for k, v in report.items()) or report.get("overall_status", "passed") != "passed")


COMMANDS = {"verify": verify, "invert": invert, "cv": cv, "products": products, "storage": storage_summary, "figures": figures, "audit": audit, "all": audit}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="subsidia", description=f"Seasonal storage analytics on pixel tables (year of {PERIOD} days).")
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("--config", default="config.json")
    out.add_argument("--optimize", action="store_true", help="invert: fit the parameters first")
    out.add_argument("--maxiter", type=int, help="invert: iterations of the last stage in place of the configured ones; 0 evaluates only")
    out.add_argument("--output-dir")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        c = configs.load_config(args.config)
        if args.output_dir:
            c = replace(c, output=args.output_dir)
        spark = SparkSession.builder.appName("subsidia").getOrCreate()
        extra = {"optimize": args.optimize, "most": args.maxiter} if args.command == "invert" else {}
        report = COMMANDS[args.command](spark, c, **extra)
    except Exception as error:  # the report tells, and the exit code
        report = {"status": "failed", "error": f"{type(error).__name__}: {error}"}
    print(json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, default=str))
    return exit_code(report)


if __name__ == "__main__":
    sys.exit(main())

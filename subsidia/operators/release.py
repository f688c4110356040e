"""Release gates: what validation, the final model, storage and the release itself are held against."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.guards import finite
from ..functions.storage_model import StorageModel
from ..sources import rasters

#: What is stored of the fit of each fold.
STORED = "fold_id long, rmse double, mae double, pixel_count long, ske_min double, ske_max double, cu double, lag_c double"
#: Tolerances of the gates.
EXACT, ERROR, EXTREME, BOUND, LAG, PREDICTION = 1e-12, 1e-8, 1e-6, 1e-12, 0.05, 100.0
FINAL = {"rmse": 1e-8, "mae": 1e-8, "ske_min": 1e-10, "ske_p50": 1e-9, "ske_max": 1e-10, "cu": 1e-13}
VOLUME, PUBLISHED, ENVELOPE = 1e-3, 1e-8, 1.0


def close(actual: Column, expected: Column, tol: float) -> Column:
    """Within the tolerance; false for what is missing or not finite."""
    return F.coalesce(F.abs(actual - expected) <= tol, F.lit(False)) & finite(actual, expected)


def with_model(found: DataFrame, models: Mapping[int, StorageModel]) -> DataFrame:
    """Adds cu, lag_c, lag_u and gamma_norm of the model of each row's fold."""
    pick = lambda f: F.element_at(F.create_map(*(F.lit(x) for k, m in models.items() for x in (k, float(f(m))))), F.col("fold_id").cast("int"))
    return found.withColumns({"cu": pick(lambda m: math.exp(m.log_cu)), "lag_c": pick(lambda m: m.lag_c), "lag_u": pick(lambda m: m.lag_u), "gamma_norm": pick(lambda m: m.gamma_norm)})


def _stacked(rows: DataFrame, gates: Mapping[str, Column], *keys: str) -> DataFrame:
    """(keys, gate, passed): a row for each gate; what can't be told fails."""
    wide = rows.select(*keys, *(F.coalesce(c, F.lit(False)).alias(f"gate {n}") for n, c in gates.items()))
    long = wide.unpivot(list(keys), [f"gate {n}" for n in gates], "gate", "passed")
    return long.withColumn("gate", F.substring("gate", 6, 1000))


def validation_gates(found: DataFrame, stored: DataFrame, counts: DataFrame, frozen: DataFrame, low: float, high: float, lag_u: float, tol: float = ERROR) -> DataFrame:
    """(fold_id, gate, passed): twelve gates of each fold of frozen(fold_id, frozen_rmse).

    found: with_model() of the metrics by fold; stored: STORED; counts(fold_id, validation_n). A fold that one of them
    lacks fails.
    """
    old = stored.select("fold_id", *(F.col(c).alias(f"old_{c}") for c in stored.columns if c != "fold_id"))
    rows = frozen.join(found, "fold_id", "left").join(old, "fold_id", "left").join(counts.select("fold_id", "validation_n"), "fold_id", "left")
    c = F.col
    gates = {
        "validation_rmse": close(c("rmse"), c("frozen_rmse"), tol),
        "validation_mae": close(c("mae"), c("old_mae"), tol),
        "validation_pixel_count": (c("pixel_count") == c("old_pixel_count")) & (c("pixel_count") == c("validation_n")),
        "nonfinite_prediction_count": c("nonfinite_count") == 0,
        "ske_min_bound": c("ske_min") >= low - BOUND,
        "ske_max_bound": c("ske_max") <= high + BOUND,
        "ske_min_value": close(c("ske_min"), c("old_ske_min"), EXTREME),
        "ske_max_value": close(c("ske_max"), c("old_ske_max"), EXTREME),
        "prediction_abs_p99": finite(c("pred_abs_p99")) & (c("pred_abs_p99") <= PREDICTION),
        "cu": close(c("cu"), c("old_cu"), EXACT),
        "lag_c": close(c("lag_c"), c("old_lag_c"), EXACT),
        "lag_u": close(c("lag_u"), F.lit(lag_u), EXACT),
    }
    return _stacked(rows, gates, "fold_id")


def final_gates(found: DataFrame, model: StorageModel, expected: Mapping[str, float], lags: tuple[float, float], parameters: int, tolerances: Mapping[str, float] = FINAL) -> DataFrame:
    """(gate, passed) of one row of metrics of the final model: its numbers, and eight gates besides."""
    rows = found.withColumns({"cu": F.lit(math.exp(model.log_cu)), "gamma_norm": F.lit(model.gamma_norm)})
    gates = {name: close(F.col(name), F.lit(float(value)), tolerances[name]) for name, value in expected.items()} | {
        "lag_c": close(F.lit(model.lag_c), F.lit(lags[0]), EXACT),
        "lag_u": close(F.lit(model.lag_u), F.lit(lags[1]), EXACT),
        "gamma_norm_finite": finite(F.col("gamma_norm")),
        "nonfinite_prediction_count": F.col("nonfinite_count") == 0,
        "ske_min_bound": F.col("ske_min") >= model.low - BOUND,
        "ske_max_bound": F.col("ske_max") <= model.high + BOUND,
        "prediction_abs_p99_finite": finite(F.col("pred_abs_p99")),
        "parameter_count": F.lit(len(model.theta) == parameters),
    }
    return _stacked(rows, gates)


@dataclass(frozen=True)
class StorageRelease:
    """What the storage gate expects; envelope: what the stored document says, or nothing where there is none."""

    coherent_m3: float
    local_sum_m3: float
    peak_to_trough_m3: float
    lag_c: float
    low_m3: float
    high_m3: float
    status: str
    envelope: Mapping[str, object] = field(default_factory=dict)


def storage_gates(summary: DataFrame, published: DataFrame, model: StorageModel, release: StorageRelease) -> DataFrame:
    """(gate, passed) of one row of storage_summary() and one of difference() between ske and its published raster."""
    one = lambda df: df.withColumn("one", F.lit(1))
    rows = one(summary).join(one(published), "one")
    number = lambda k: F.lit(float(release.envelope.get(k, math.nan)))
    near = F.abs(F.col("shift_days") - F.lit(release.lag_c)) < LAG
    gates = {
        **{k: close(F.col(k), F.lit(getattr(release, k)), VOLUME) for k in ("coherent_m3", "local_sum_m3", "peak_to_trough_m3")},
        "delayed_peak_shift": near,
        "delayed_direction": F.col("direction") == "positive_delay",
        "delayed_positive_shift": near & (F.col("direction") == "positive_delay"),
        "published_ske": F.col("max_abs_diff") <= PUBLISHED,
        "lag_c": F.abs(F.lit(model.lag_c) - F.lit(release.lag_c)) < LAG,
        "envelope_present": F.lit(bool(release.envelope)),
        "envelope_status": F.lit(release.envelope.get("confined_storage_uncertainty_status") == release.status),
        "envelope_low": close(number("p2_5_m3"), F.lit(release.low_m3), ENVELOPE),
        "envelope_high": close(number("p97_5_m3"), F.lit(release.high_m3), ENVELOPE),
    }
    return _stacked(rows, gates)


def raster_audit(required: DataFrame, metadata: DataFrame, summary: DataFrame) -> DataFrame:
    """Each required(product) with metadata(product, sha256, crs, transform, height, width, nodata) and its summary.

    A product without metadata is "missing", one without a finite cell is "empty"; others have "passed".
    """
    rows = required.join(metadata, "product", "left").join(summary, "product", "left")
    status = F.when(F.col("height").isNull(), "missing").when(F.coalesce("finite_count", F.lit(0)) == 0, "empty").otherwise("passed")
    return rows.select("product", "sha256", "crs", "transform", "height", "width", "nodata", F.coalesce("finite_count", F.lit(0)).cast("long").alias("finite_count"), "min_value", "max_value", status.alias("status"))


def audited_rasters(files: DataFrame) -> DataFrame:
    """raster_audit() of files(product, path) themselves: each is read by one task, a tile at a time.

    What isn't a raster that can be read has status "failed: no raster".
    """
    found = rasters.raster_files(files)
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("height").isNull(), "failed: no raster").when(F.col("finite_count") == 0, "empty").otherwise("passed")
    return found.drop("path").withColumns({"finite_count": F.coalesce("finite_count", F.lit(0)).cast("long"), "status": status})


def same_geometry(metadata: DataFrame) -> DataFrame:
    """(products, same): do all products with metadata share a grid?"""
    grid = F.struct("crs", "transform", "height", "width")
    return metadata.agg(F.count("*").alias("products"), (F.count_distinct(grid) <= 1).alias("same"))


def acceptance(spark: SparkSession, report: Mapping[str, object], exact: Mapping[str, int], true: Sequence[str], passed: Sequence[str], configured: Sequence[str] = ()) -> DataFrame:
    """(position, family, name, actual, expected, passed): the release's report by families of gates, in their order.

    exact: numbers that must be these; true: booleans; passed and configured: statuses that must say so. A name that the
    report lacks fails.
    """
    wanted = [("exact", k, v) for k, v in exact.items()] + [("true", k, True) for k in true] + [("passed", k, "passed") for k in passed] + [("configured", k, "configured") for k in configured]
    rows = [(i, family, k, None if report.get(k) is None else str(report[k]), str(v), type(report.get(k)) is type(v) and report[k] == v) for i, (family, k, v) in enumerate(wanted)]
    return spark.createDataFrame(rows, "position int, family string, name string, actual string, expected string, passed boolean")


def accepted(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(position, family, document, path, actual, expected, passed): gates of a release, held against nested documents.

    found: sources.files.leaves(); wanted(position, family, document, path, expected, tol). By family: exact is a number
    equal to expected, near one within tol, true the boolean, passed and configured the text that says so, and absent is
    for what mustn't be there. What can't be told fails.
    """
    rows = wanted.join(found.withColumnRenamed("value", "actual"), ["document", "path"], "left")
    number, asked = F.expr("try_cast(actual AS DOUBLE)"), F.expr("try_cast(expected AS DOUBLE)")
    numeric = F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    says = lambda family: (F.col("family") == family) & (F.col("kind") == "STRING") & (F.col("actual") == family)
    passed = (
        ((F.col("family") == "exact") & numeric & (number == asked))
        | ((F.col("family") == "near") & numeric & (F.abs(number - asked) <= F.col("tol")))
        | ((F.col("family") == "true") & (F.col("kind") == "BOOLEAN") & (F.col("actual") == "true"))
        | says("passed") | says("configured") | ((F.col("family") == "absent") & F.col("kind").isNull())
    )
    return rows.select("position", "family", "document", "path", "actual", "expected", F.coalesce(passed, F.lit(False)).alias("passed"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Write documents(document, body), each as a file of its own, by tasks; a body is a report, not a table."""

    def store(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root)
        for batch in batches:
            for name, body in zip(batch.column("document").to_pylist(), batch.column("body").to_pylist(), strict=True):
                held = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(held) as out:
                    out.write((body or "").encode())
                fs.move(held, f"{root}/{name}")
            yield batch.select(["document"])

    documents.select("document", "body").mapInArrow(store, "document string").write.format("noop").mode("overwrite").save()


def acceptance_status(gates: DataFrame, *by: str) -> DataFrame:
    """(by, gates, failed, overall_status, failure_reasons) of accepted(), reasons in their order, by one aggregation."""
    failing = F.collect_list(F.when(~F.col("passed"), F.struct("position", F.concat_ws(".", "document", "path").alias("name"))))
    found = gates.groupBy(*by).agg(F.count("*").alias("gates"), F.count_if(~F.col("passed")).alias("failed"), F.transform(F.sort_array(failing), lambda x: x["name"]).alias("failure_reasons"))
    return found.select(*by, "gates", "failed", F.when(F.col("failed") == 0, "passed").otherwise("failed").alias("overall_status"), "failure_reasons")


def reasons(gates: DataFrame, *order: str) -> list[str]:
    """Names of the gates that failed, in their order."""
    name = "name" if "name" in gates.columns else "gate"
    return [r[0] for r in gates.where("not passed").orderBy(*(order or [name])).select(name).collect()]


def active_paths(paths: DataFrame, excluded: Sequence[str], suffixes: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Rows whose path has none of the excluded parts (whole names between slashes) and one of the suffixes, if any are given."""
    parts = F.split(F.col(path), "/")
    rows = paths.where(~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in excluded)))) if excluded else paths
    if suffixes:
        ends = [F.endswith(F.col(path), F.lit(s)) for s in suffixes]
        rows = rows.where(F.array_contains(F.array(*ends), True))
    return rows

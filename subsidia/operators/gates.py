"""Gates as long tables: one row for each number that is held against an expected one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

GATES = "scope string, gate string, expected double, tol double"


def unpivoted(metrics: DataFrame, scope: str) -> DataFrame:
    """(scope, gate, actual) from one row of numbers for each scope."""
    values = [c for c in metrics.columns if c != scope]
    return metrics.select(F.col(scope).cast("string").alias("scope"), *(F.col(c).cast("double").alias(c) for c in values)).unpivot(["scope"], values, "gate", "actual")


def gate_table(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected gate with the actual number; one that is missing or not finite fails."""
    rows = expected.join(actual, ["scope", "gate"], "left")
    passed = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("tol"), F.lit(False)) & ~F.coalesce(F.isnan("actual"), F.lit(True))
    return rows.select("scope", "gate", "actual", "expected", "tol", passed.alias("passed"))


def verdicts(gates: DataFrame) -> DataFrame:
    """(scope, status, failed): passed where all gates of a scope did, and the names of those that didn't."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    return gates.groupBy("scope").agg(F.when(F.bool_and("passed"), "passed").otherwise("failed").alias("status"), failed.alias("failed"))


def product_audit(required: DataFrame, present: DataFrame) -> DataFrame:
    """Each required product with the status of the table of those present, or "missing"."""
    return required.join(present, "product", "left").select("product", F.coalesce("status", F.lit("missing")).alias("status"))

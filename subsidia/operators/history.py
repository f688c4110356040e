"""Iteration histories: convergence gates and changes as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.guards import relative_change


def iteration_changes(history: DataFrame, run: str = "run") -> DataFrame:
    """Adds the row number and the relative change of the objective; the first row has infinity."""
    order = Window.partitionBy(run).orderBy("iteration")
    change = F.coalesce(relative_change(F.col("objective"), F.lag("objective").over(order)), F.lit(float("inf")))
    return history.withColumns({"number": F.row_number().over(order), "relative_change": change})


def convergence_gate(history: DataFrame, drop: float, step: float, gradient: float, rows: int = 10, run: str = "run") -> DataFrame:
    """At each iteration: has the objective settled over the last rows, with small steps and a small gradient?"""
    order = Window.partitionBy(run).orderBy("iteration")
    last, inner = order.rowsBetween(1 - rows, 0), order.rowsBetween(2 - rows, 0)
    first = F.first("objective").over(last)
    out = history.select(
        run, "iteration", F.count("*").over(last).alias("seen"),
        (F.abs(first - F.col("objective")) / F.greatest(F.abs(first), F.lit(1e-30))).alias("rel_drop"),
        F.max("relative_step").over(inner).alias("max_step"), F.col("gradient_rms").alias("grad_rms"),
    )
    settled = (F.col("seen") >= rows) & (F.col("rel_drop") <= drop) & (F.col("max_step") <= step) & (F.col("grad_rms") <= gradient)
    return out.withColumn("converged", settled).drop("seen")


def tail(history: DataFrame, n: int = 10) -> DataFrame:
    """The last n iterations: the limit is the feature."""
    return history.orderBy(F.desc("iteration")).limit(n)

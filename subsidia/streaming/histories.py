"""The convergence gate over iterations that arrive, late and repeated ones among them, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import sent_along

KEPT = "iterations array<long>, objectives array<double>, steps array<double>, gradients array<double>, whole boolean"
GATES = "run {kind}, iteration long, rel_drop double, max_step double, grad_rms double, converged boolean"


def running_gate(history: DataFrame, drop: float, step: float, gradient: float, rows: int = 10, late: int = 50, run: str = "run") -> DataFrame:
    """(run, iteration, rel_drop, max_step, grad_rms, converged), anew for each iteration whose last rows have changed.

    history(run, iteration, objective, relative_step, gradient_rms). The state of a run is its last rows - 1 + late
    iterations. An iteration that arrives late gives new rows for itself and for the rows - 1 after it; one that lies
    before all that is kept, once something has been let go, is left out. A repeated iteration counts once, as it
    arrived first. The sink gets updates: of several rows of an iteration the last one holds (settled()).
    """
    names, kinds = ("iteration", "objective", "relative_step", "gradient_rms"), ("int64", "float64", "float64", "float64")
    inner, held = rows - 1, rows - 1 + late

    def gates(iteration: np.ndarray, objective: np.ndarray, steps: np.ndarray, gradients: np.ndarray, only: np.ndarray) -> dict[str, np.ndarray]:
        at = np.flatnonzero(only)
        first = objective[np.maximum(at - inner, 0)]
        with np.errstate(all="ignore"):
            drops = np.abs(first - objective[at]) / np.maximum(np.abs(first), 1e-30)
            padded = np.concatenate([np.full(inner - 1, np.nan), steps])
            most = np.fmax.reduce(sliding_window_view(padded, inner)[at], axis=1)
            settled = (at >= inner) & (drops <= drop) & (most <= step) & (gradients[at] <= gradient)
        return {"iteration": iteration[at], "rel_drop": drops, "max_step": most, "grad_rms": gradients[at], "converged": settled}

    # a run has few rows in a batch, so a call must cost little: arrays, and one frame for what it gives
    def step_of(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *columns, whole = state.get if state.exists else ([], [], [], [], True)
        kept = [np.array(c, dtype=k) for c, k in zip(columns, kinds, strict=True)]
        parts = [[x[n].to_numpy(k) for n, k in zip(names, kinds, strict=True)] for x in arrived]
        new = [np.concatenate(c) for c in zip(*parts, strict=True)]
        take = np.unique(new[0], return_index=True)[1]
        take = take[~np.isin(new[0][take], kept[0])]
        if not whole:
            take = take[new[0][take] > kept[0][0]]
        if len(take):
            every = [np.concatenate([old, c[take]]) for old, c in zip(kept, new, strict=True)]
            order = np.argsort(every[0])
            every = [c[order] for c in every]
            # of a change at an iteration only the rows - 1 that follow can tell
            changed = np.cumsum(order >= len(kept[0]))
            reach = changed > np.concatenate([np.zeros(min(rows, len(order)), dtype=changed.dtype), changed[:-rows]])
            out = gates(*every, reach if whole else reach & (np.arange(len(order)) >= inner))
            whole = whole and len(order) <= held
            state.update((*(c[-held:].tolist() for c in every), whole))
            yield pd.DataFrame({"run": [key[0]] * len(out["iteration"]), **out})

    kind = history.schema[run].dataType.simpleString()
    rows_of = history.select(F.col(run).alias("run"), F.col("iteration").cast("long"), *(F.col(c).cast("double") for c in ("objective", "relative_step", "gradient_rms")))
    return rows_of.where("iteration IS NOT NULL").groupBy("run").applyInPandasWithState(step_of, GATES.format(kind=kind), KEPT, "update", GroupStateTimeout.NoTimeout)


def write_gates(gates: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch's rows with the batch's number."""

    def store(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch}-rows")

    return gates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def settled(written: DataFrame) -> DataFrame:
    """The last row of each iteration of each run."""
    values = ("rel_drop", "max_step", "grad_rms", "converged")
    last = written.groupBy("run", "iteration").agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select("run", "iteration", *(F.col("last")[c].alias(c) for c in values))


sent_along(__name__)

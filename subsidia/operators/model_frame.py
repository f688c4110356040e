"""Evaluates the model on pixels: one scan, one projection."""

from __future__ import annotations

from collections.abc import Mapping

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.basis import Design, gaussian, total
from ..functions.guards import finite
from ..functions.harmonics import delayed
from ..functions.storage_model import StorageModel, bounded, heads, predictor, prediction

VECTORS = ("obs_sin", "obs_cos", "hc_sin", "hc_cos", "hu_sin", "hu_cos")


def split_filter(pixels: DataFrame, split: str = "all", fold: int | None = None) -> DataFrame:
    """validation: the fold; training: every other row, rows without a fold too; all: all rows."""
    if split not in ("all", "validation", "training"):
        raise ValueError(f"unknown split {split!r}")
    if split != "all" and fold is None:
        raise ValueError(f"split {split!r} needs a fold")
    if split == "validation":
        return pixels.where(F.col("fold_id") == fold)
    if split == "training":
        return pixels.where((F.col("fold_id") != fold) | F.col("fold_id").isNull())
    return pixels


def usable(pixels: DataFrame) -> DataFrame:
    """Pixels under the mask whose three vectors are finite."""
    return pixels.where(F.col("mask") == 1).where(finite(*(F.col(c) for c in VECTORS)))


def with_storage(pixels: DataFrame, model: StorageModel, design: Design) -> DataFrame:
    """Adds eta and ske."""
    rows = pixels.withColumn("eta", predictor(gaussian(F.col("x"), F.col("y"), design), model, design))
    return rows.withColumn("ske", bounded(F.col("eta"), model.low, model.high))


def model_frame(pixels: DataFrame, model: StorageModel, design: Design) -> DataFrame:
    """Adds eta, ske, the prediction and the residual."""
    rows = with_storage(pixels, model, design)
    p = prediction(F.col("ske"), math.exp(model.log_cu), *heads(model))
    rows = rows.withColumns({"pred_sin": p[0], "pred_cos": p[1]})
    return rows.withColumns({"res_sin": F.col("obs_sin") - F.col("pred_sin"), "res_cos": F.col("obs_cos") - F.col("pred_cos")})


def fold_model_frame(pixels: DataFrame, models: Mapping[int, StorageModel], design: Design) -> DataFrame:
    """Each pixel under the model of its fold, all folds in one scan; pixels of other folds go."""
    first = next(iter(models.values()))
    pick = lambda f: F.element_at(F.create_map(*(F.lit(x) for k, m in models.items() for x in (k, float(f(m))))), F.col("fold_id").cast("int"))
    rows = pixels.where(F.col("fold_id").isin(list(models)))
    raw = gaussian(F.col("x"), F.col("y"), design)
    weights = [pick(lambda m, k=k: design.weights(m.gamma)[k]) for k in range(len(raw))]
    rows = rows.withColumn("eta", pick(lambda m: m.eta0) + total([r * w for r, w in zip(raw, weights, strict=True)]))
    rows = rows.withColumns({"ske": bounded(F.col("eta"), first.low, first.high), "lag_c": pick(lambda m: m.lag_c), "cu": pick(lambda m: math.exp(m.log_cu))})
    confined = delayed(F.col("hc_sin"), F.col("hc_cos"), F.col("lag_c"), first.period)
    p = prediction(F.col("ske"), F.col("cu"), confined, heads(first)[1])
    rows = rows.withColumns({"pred_sin": p[0], "pred_cos": p[1]})
    return rows.withColumns({"res_sin": F.col("obs_sin") - F.col("pred_sin"), "res_cos": F.col("obs_cos") - F.col("pred_cos")})

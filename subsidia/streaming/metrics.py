"""Running metrics over pixel blocks that arrive as files.

Counts and sums merge, so update mode needs no watermark; exact percentiles don't and are left to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.basis import Design
from ..functions.guards import ratio
from ..functions.storage_model import StorageModel
from ..operators.model_frame import model_frame, usable


def pixel_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """New Parquet files under a path, at most so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_metrics(pixels: DataFrame, model: StorageModel, design: Design) -> DataFrame:
    """Pixels, coefficients, RMSE and MAE by fold."""
    e = lambda f: f(F.col("res_sin")) + f(F.col("res_cos"))
    sums = model_frame(usable(pixels), model, design).groupBy("fold_id").agg(F.count("*").alias("pixel_count"), F.sum(e(lambda x: x * x)).alias("sse"), F.sum(e(F.abs)).alias("sae"))
    n = F.lit(2) * F.col("pixel_count")
    return sums.select("fold_id", "pixel_count", n.alias("observation_count"), F.sqrt(ratio(F.col("sse"), n)).alias("rmse"), ratio(F.col("sae"), n).alias("mae"))

"""Pixel tables: the fixture over the driver's orders, blocks, rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.basis import Design
from ..functions.harmonics import PERIOD
from ..functions.storage_model import StorageModel

#: Columns of the fixture's grid.
WIDTH = 125
#: Four centres and an orthogonal transform.
DESIGN = Design(((20.0, 20.0), (60.0, 60.0), (90.0, 30.0), (30.0, 100.0)), 30.0, ((0.5, 0.5, 0.5, 0.5), (0.5, -0.5, 0.5, -0.5), (0.5, 0.5, -0.5, -0.5), (0.5, -0.5, -0.5, 0.5)))
MODEL = StorageModel(-3.8, (0.4, -0.3, 0.2, 0.1), math.log(4e-4), 55.7732)
#: The first latitude and the steps in degrees of the fixture's grid.
TOP, STEP = 38.0, 0.001


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel for each order: a grid of WIDTH columns with harmonics made of its date, price and customer."""
    return pixels_of(read_table(spark, sf_dir, "orders"))


def pixels_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    angle = F.lit(2 * math.pi / PERIOD) * day
    early = F.lit(2 * math.pi / PERIOD) * (day - 40)
    size = F.lit(1.0) + (F.col("o_custkey") % 97) / F.lit(97.0)
    rows = orders.select(
        key.alias("pixel_id"), F.floor(key / WIDTH).cast("long").alias("row"), (key % WIDTH).alias("col"), F.floor(key / (10 * WIDTH)).cast("long").alias("block_id"),
        (F.floor(key / 50).cast("long") % 5).alias("fold_id"), F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("mask"), "o_orderstatus",
        (F.col("o_totalprice") / 5e4 * F.sin(angle)).alias("obs_sin"), (F.col("o_totalprice") / 5e4 * F.cos(angle)).alias("obs_cos"),
        (size * F.sin(early)).alias("hc_sin"), (size * F.cos(early)).alias("hc_cos"), ((key % 89) / F.lit(89.0)).alias("hu_sin"), ((key % 83) / F.lit(83.0)).alias("hu_cos"),
        (F.lit(0.01) + F.lit(0.001) * (key % 7)).alias("ske_ref"),
    )
    return rows.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double"), "lon": F.lit(115.0) + F.lit(STEP) * F.col("col"), "lat": F.lit(TOP) - F.lit(STEP) * F.col("row")})


def masked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_pixels() under the mask, filtered by the stored column, so that the filter reaches the scan."""
    return order_pixels(spark, sf_dir).where("o_orderstatus <> 'P'")


def damaged_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture with NaN, infinities and nulls in places that the key tells."""
    key, damage = F.col("pixel_id"), {}
    for c, (step, value) in {"obs_sin": (11, math.nan), "hc_cos": (13, math.inf), "hu_sin": (17, -math.inf), "obs_cos": (19, None)}.items():
        damage[c] = F.when(key % step == 0, F.lit(value).cast("double")).otherwise(F.col(c))
    return order_pixels(spark, sf_dir).withColumns(damage)


def undefined_folds(pixels: DataFrame) -> DataFrame:
    """The fixture with folds that are null or that the scheme doesn't know."""
    key = F.col("pixel_id")
    return pixels.withColumn("fold_id", F.when(key % 23 == 0, F.lit(None).cast("long")).when(key % 29 == 0, F.lit(9).cast("long")).otherwise(F.col("fold_id")))


def repeated_pixels(pixels: DataFrame) -> DataFrame:
    """The fixture with some pixels once more, under the next fold."""
    return pixels.unionByName(pixels.where("pixel_id % 31 = 0").withColumn("fold_id", (F.col("fold_id") + 1) % 5))


def layout(pixels: DataFrame, path: str) -> None:
    """Write pixels for later scans: a folder for each fold, sorted by block, so that fold filters prune files."""
    pixels.repartition("fold_id", "block_id").sortWithinPartitions("fold_id", "block_id").write.partitionBy("fold_id").mode("overwrite").parquet(path)

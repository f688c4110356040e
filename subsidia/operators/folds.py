"""Spatial folds: 0 is development, 1 to 4 validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FOLDS = (1, 2, 3, 4)


def fold_histogram(pixels: DataFrame) -> DataFrame:
    """Masked pixels of each fold, development and undefined ones included (undefined: -1)."""
    known = F.when(F.col("fold_id").isin(0, *FOLDS), F.col("fold_id")).otherwise(F.lit(-1).cast("long"))
    return pixels.where("mask = 1").groupBy(known.alias("fold_id")).agg(F.count("*").alias("n"))


def partition_audit(pixels: DataFrame, by_pixel: bool = False) -> DataFrame:
    """Sizes of training and validation of each fold, measured from the rows, not by subtraction.

    One scan counts rows; a row has one fold, so a pixel that stands in several rows isn't seen. by_pixel groups the rows
    of a pixel first, which shuffles all of them: a pixel with two folds is in training and in validation of either.
    """
    own = pixels.where("mask = 1")
    if by_pixel:
        own = own.groupBy("pixel_id").agg(F.collect_set("fold_id").alias("folds"), F.count_if(F.col("fold_id").isNull()).alias("none"))
    else:
        own = own.select(F.array_compact(F.array("fold_id")).alias("folds"), F.col("fold_id").isNull().cast("int").alias("none"))
    total = own.agg(
        F.count("*").alias("common"),
        *(F.count_if(F.array_contains("folds", F.lit(k).cast("long"))).alias(f"v{k}") for k in FOLDS),
        *(F.count_if((F.size(F.array_remove("folds", F.lit(k).cast("long"))) > 0) | (F.col("none") > 0)).alias(f"t{k}") for k in FOLDS),
        *(F.count_if(F.array_contains("folds", F.lit(k).cast("long")) & ((F.size("folds") > 1) | (F.col("none") > 0))).alias(f"b{k}") for k in FOLDS),
    )
    stacked = total.selectExpr("common", f"stack({len(FOLDS)}, {', '.join(f'{k}L, t{k}, v{k}, b{k}' for k in FOLDS)}) AS (fold_id, training_n, validation_n, intersection_n)")
    union = F.col("training_n") + F.col("validation_n") - F.col("intersection_n")
    return stacked.select("fold_id", "training_n", "validation_n", "intersection_n", union.alias("union_n"), ((F.col("intersection_n") == 0) & (union == F.col("common"))).alias("passed"))


def partition_bitmaps(pixels: DataFrame) -> DataFrame:
    """partition_audit(by_pixel=True) by bitmaps: what is shuffled is bitmaps of 4 KB, not pixels.

    A bitmap holds a slice of pixel ids; each task sends at most nine for each slice that it meets: who validates a fold,
    who trains it, and all. The intersection follows from the sizes of both and of their union. Rows without a pixel_id
    aren't counted.
    """
    bit = F.bitmap_bit_position("pixel_id")
    own = pixels.where("mask = 1 AND pixel_id IS NOT NULL").select("fold_id", F.bitmap_bucket_number("pixel_id").alias("slice"), bit.alias("bit"))
    size = lambda x: F.bitmap_count(F.bitmap_construct_agg(x))
    here = {k: F.coalesce(F.col("fold_id") == k, F.lit(False)) for k in FOLDS}
    sizes = own.groupBy("slice").agg(size(F.col("bit")).alias("common"), *(size(F.when(c, F.col("bit"))).alias(f"v{k}") for k, c in here.items()), *(size(F.when(~c, F.col("bit"))).alias(f"t{k}") for k, c in here.items()))
    total = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes.columns if c != "slice"))
    stacked = total.selectExpr(f"stack({len(FOLDS)}, {', '.join(f'{k}L, t{k}, v{k}, common' for k in FOLDS)}) AS (fold_id, training_n, validation_n, union_n)")
    both = F.col("training_n") + F.col("validation_n") - F.col("union_n")
    return stacked.select("fold_id", "training_n", "validation_n", both.alias("intersection_n"), "union_n", (both == 0).alias("passed"))


def overlap(pixels: DataFrame, fold: int) -> DataFrame:
    """How many validation pixels of a fold are also in its training: a semi-join, 0 in sound data."""
    masked = pixels.where("mask = 1")
    validation, training = masked.where(F.col("fold_id") == fold), masked.where((F.col("fold_id") != fold) | F.col("fold_id").isNull())
    return validation.join(training, "pixel_id", "left_semi").agg(F.count("*").alias("intersection_n"))

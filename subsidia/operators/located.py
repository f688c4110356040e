"""Pixels and rasters laid out alike, so that looking up a raster's cells shuffles nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch

KEYS = ("row", "col")


def store_located(rows: DataFrame, name: str, buckets: int) -> str:
    """Store rows(row, col, ...) as a table in buckets of cells, a sorted file for each; gives the table's name.

    All tables that are to be joined need the same number of buckets: so many that one fits in a task's memory.
    """
    own = scratch.table(rows.sparkSession, name)
    rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(own)
    return own


def looked_up(spark: SparkSession, pixels: str, *rasters: str, how: str = "inner") -> DataFrame:
    """Rows of a stored table with the columns of stored rasters at their cells: merged bucket by bucket, no exchange."""
    found = spark.table(pixels)
    for name in rasters:
        found = found.join(spark.table(name).hint("merge"), list(KEYS), how)
    return found

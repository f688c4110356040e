"""Error metrics of a model frame, percentiles, raster summaries, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.guards import finite, ratio
from .percentiles import HELD, percentiles


def metrics(frame: DataFrame, high: float, by: Sequence[str] = (), approx: bool = False, near: float = 1e-6, narrowed: bool | None = None, single: bool = False, held: int = HELD) -> DataFrame:
    """One row for each group (or one in all): counts, errors, extremes, percentiles, share at the upper bound.

    Non-finite predictions are counted and left out of every sum, but count as pixels. Percentiles are exact and
    interpolated, of doubles. One task sorts a group's values where the group has at most held rows, which a scan of the
    group's columns counts first; those of larger groups are found with bounded state in more scans. narrowed=True goes
    that way for all groups, False for none, and neither counts; approx takes percentile_approx. With single they are
    those of values in single precision, interpolated in doubles. Null keys are a group of their own.
    """
    good = finite(*(F.col(c) for c in ("pred_sin", "pred_cos", "res_sin", "res_cos")))
    rows, keys = frame.withColumn("good", good), [f"of_{b}" for b in by]
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)] or F.lit(True)
    large, few = None, F.lit(not narrowed)
    if not approx and narrowed is None:
        # at most a row for each held rows of the frame
        sizes = frame.groupBy(*by).agg(F.count("*").alias("rows")).where(F.col("rows") > held).drop("rows").withColumnsRenamed(dict(zip(by, keys, strict=True)))
        found_large = sizes.collect()
        if found_large and by:
            large = F.broadcast(frame.sparkSession.createDataFrame(found_large, sizes.schema).withColumn("large", F.lit(True)))
            rows, few = rows.join(large, same, "left").drop(*keys), F.col("large").isNull()
        narrowed, few = bool(found_large), few if by else F.lit(not found_large)
    percentile = (lambda x, p: F.percentile_approx(x, p, 10_000)) if approx else (lambda x, p: F.percentile(F.when(few, x), p)) if narrowed else F.percentile
    ske, top = F.when(F.col("good"), F.col("ske")), F.when(F.col("good"), F.greatest(F.abs("pred_sin"), F.abs("pred_cos")))
    held_ske, held_top = (x.cast("float").cast("double") if single else x for x in (ske, top))
    own = lambda x: F.when(F.col("good"), x)
    found = rows.groupBy(*by).agg(
        F.count("*").alias("pixel_count"),
        (F.lit(2) * F.count_if("good")).alias("observation_count"),
        F.count_if(~F.col("good")).alias("nonfinite_count"),
        F.coalesce(F.sum(own(F.col("res_sin") * F.col("res_sin") + F.col("res_cos") * F.col("res_cos"))), F.lit(0.0)).alias("sse"),
        F.coalesce(F.sum(own(F.abs("res_sin") + F.abs("res_cos"))), F.lit(0.0)).alias("sae"),
        F.min(ske).alias("ske_min"),
        percentile(held_ske, F.lit(0.5)).alias("ske_p50"),
        F.max(ske).alias("ske_max"),
        percentile(held_top, F.lit(0.99)).alias("pred_abs_p99"),
        F.count_if(F.col("good") & (F.lit(high) - F.col("ske") <= near)).alias("upper"),
    )
    if narrowed and not approx:
        exact = percentiles(rows.where(~few) if large is not None else rows, by, {"large_p50": (held_ske, 0.5), "large_p99": (held_top, 0.99)}, held)
        found = found.join(F.broadcast(exact.withColumnsRenamed(dict(zip(by, keys, strict=True)))), same, "left")
        found = found.withColumns({c: F.coalesce(c, x) for c, x in (("ske_p50", "large_p50"), ("pred_abs_p99", "large_p99"))})
    return found.select(
        *by, "pixel_count", "observation_count", "nonfinite_count",
        F.sqrt(ratio(F.col("sse"), F.col("observation_count"))).alias("rmse"), ratio(F.col("sae"), F.col("observation_count")).alias("mae"),
        "ske_min", "ske_p50", "ske_max", "pred_abs_p99", ratio(F.col("upper").cast("double"), F.col("pixel_count")).alias("upper_bound_fraction"),
    )


def training_errors(frame: DataFrame, folds: Sequence[int]) -> DataFrame:
    """(fold_id, pixel_count, rmse, mae) over the rows outside each fold; undefined and null folds train everywhere.

    One scan sums by fold; the handful of sums is then added up once for each fold left out.
    """
    own = frame.groupBy("fold_id").agg(F.count("*").alias("n"), F.sum(F.col("res_sin") * F.col("res_sin") + F.col("res_cos") * F.col("res_cos")).alias("sse"), F.sum(F.abs("res_sin") + F.abs("res_cos")).alias("sae"))
    asked = F.filter(F.array(*(F.lit(k).cast("long") for k in folds)), lambda k: ~F.col("fold_id").eqNullSafe(k))
    sums = own.withColumn("left_out", F.explode(asked)).groupBy(F.col("left_out").alias("fold_id")).agg(F.sum("n").alias("pixel_count"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae"))
    count = F.lit(2) * F.col("pixel_count")
    return sums.select("fold_id", "pixel_count", F.sqrt(ratio(F.col("sse"), count)).alias("rmse"), ratio(F.col("sae"), count).alias("mae"))


def raster_summary(cells: DataFrame, product: str = "product", value: str = "value") -> DataFrame:
    """Finite cells, their least and greatest value, by product."""
    x = F.when(finite(F.col(value)), F.col(value))
    return cells.groupBy(product).agg(F.count(x).alias("finite_count"), F.min(x).alias("min_value"), F.max(x).alias("max_value"))


def difference(frame: DataFrame, a: Column, b: Column) -> DataFrame:
    """Greatest and root mean square difference and their number, over rows where both are finite."""
    d = F.when(finite(a, b), a - b)
    return frame.agg(F.max(F.abs(d)).alias("max_abs_diff"), F.sqrt(ratio(F.coalesce(F.sum(d * d), F.lit(0.0)), F.count(d))).alias("rms_diff"), F.count(d).alias("n"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows are repeats of a key."""
    return rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.greatest(F.col("count") - 1, F.lit(0))), F.lit(0)).alias("duplicate_count"))

"""Seasonal storage: volumes over cell areas, regional sums, phases and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.basis import Design
from ..functions.guards import finite
from ..functions.harmonics import amplitude, circular_difference, delayed, direction_label, phase_days
from ..functions.storage_model import StorageModel
from .model_frame import with_storage


def storage_components(pixels: DataFrame, model: StorageModel, design: Design, area: Column) -> DataFrame:
    """Masked pixels with finite confined heads: adds ske, area_m2 and the two volume components (m3).

    A pixel whose ske isn't finite keeps null volumes, so that it can still be counted.
    """
    rows = with_storage(pixels.where("mask = 1").where(finite(F.col("hc_sin"), F.col("hc_cos"))), model, design).withColumn("area_m2", area)
    volume = lambda h: F.when(finite(F.col("ske")), F.col("ske") * F.col(h) * F.col("area_m2"))
    return rows.withColumns({"vol_sin": volume("hc_sin"), "vol_cos": volume("hc_cos")})


def storage_summary(components: DataFrame, model: StorageModel) -> DataFrame:
    """One row: regional sums, coherent and local amplitudes, phase, and the shift that the lag makes."""
    later = delayed(F.col("vol_sin"), F.col("vol_cos"), model.lag_c, model.period)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    sums = components.agg(F.count("*").alias("valid_pixel_count"), total(F.col("vol_sin")).alias("real_m3"), total(F.col("vol_cos")).alias("imag_m3"), total(later[0]).alias("ds"), total(later[1]).alias("dc"), total(amplitude(F.col("vol_sin"), F.col("vol_cos"))).alias("local_sum_m3"))
    phase = phase_days(F.col("real_m3"), F.col("imag_m3"), model.period)
    shift = circular_difference(phase, phase_days(F.col("ds"), F.col("dc"), model.period), model.period)
    coherent = amplitude(F.col("real_m3"), F.col("imag_m3"))
    return sums.select("valid_pixel_count", "real_m3", "imag_m3", coherent.alias("coherent_m3"), "local_sum_m3", (F.lit(2.0) * coherent).alias("peak_to_trough_m3"), phase.alias("phase_days"), shift.alias("shift_days"), direction_label(shift).alias("direction"))

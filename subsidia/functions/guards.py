"""Finite values, guarded ratios, clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def finite(*columns: Column) -> Column:
    """Are all of them finite? NULL counts as no."""
    return F.coalesce(reduce(lambda a, b: a & b, (F.abs(c) < F.lit(float("inf")) for c in columns)), F.lit(False))


def ratio(total: Column, count: Column) -> Column:
    """total / max(count, 1)."""
    return total / F.greatest(count, F.lit(1)).cast("double")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def relative_change(now: Column, before: Column, floor: float = 1e-30) -> Column:
    return F.abs(now - before) / F.greatest(F.abs(before), F.lit(floor))


def symmetric_limit(x: Column, floor: float = 1e-12, default: float = 1.0) -> Column:
    """An aggregate: max |x| over finite values, at least floor; default where there are none."""
    most = F.max(F.when(finite(x), F.abs(x)))
    return F.when(most.isNotNull(), F.greatest(most, F.lit(floor))).otherwise(F.lit(default))

"""Quantile sketches that merge: counts of logarithmic bins, with a bound on the relative error.

A bin of number i holds the values in (g^(i-1), g^i], g = (1 + error) / (1 - error), and stands for 2 g^i / (g + 1), which
is at most error * |x| from each of them. Sketches add up bin by bin, in any order, so they can be stored for each block,
merged for any group of blocks, and kept as the state of a stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ERROR = 0.005
#: Added to a bin's number, so that all bins of positive values have positive ones; 0 is for zero.
_SHIFT = 1 << 20


def _growth(error: float) -> float:
    return math.log1p(error) - math.log1p(-error)


def bin_of(x: Column, error: float = ERROR) -> Column:
    """The bin of a value, in the order of values; null for nulls and what isn't finite."""
    i = F.ceil(F.log(F.abs(x)) / F.lit(_growth(error))) + _SHIFT
    return F.when(F.abs(x) < math.inf, F.when(x == 0, F.lit(0).cast("long")).when(x > 0, i).otherwise(-i))


def value_of(number: Column, error: float = ERROR) -> Column:
    """What a bin stands for."""
    size = F.exp((F.abs(number) - _SHIFT) * F.lit(_growth(error))) * F.lit(2 / (math.exp(_growth(error)) + 1))
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number.cast("double")) * size)


def _packed(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    return bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("sketch"))


def sketches(rows: DataFrame, by: Sequence[str], x: Column, error: float = ERROR) -> DataFrame:
    """(by, sketch array of (bin, n)) of the finite values of each group.

    Only counts of bins are shuffled. A group has as many bins as its values' range asks for: at 0.005 about 231 for each
    power of ten, and at most 300 thousand for all doubles.
    """
    bins = rows.select(*by, bin_of(x, error).alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return _packed(bins, by)


def merged(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches put together by other columns of theirs."""
    bins = stored.select(*by, F.inline("sketch")).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return _packed(bins, by)


def quantile(sketch: Column, q: float, error: float = ERROR) -> Column:
    """About the value of rank floor(q * (n - 1)), counted from 0."""
    zero = F.lit(0).cast("long")
    rank = F.floor(F.lit(q) * (F.aggregate(sketch, zero, lambda n, b: n + b["n"]) - 1))
    start = F.struct(zero.alias("below"), F.lit(None).cast("long").alias("bin"))
    step = lambda s, b: F.struct((s["below"] + b["n"]).alias("below"), F.coalesce(s["bin"], F.when(s["below"] + b["n"] > rank, b["bin"])).alias("bin"))
    return value_of(F.aggregate(sketch, start, step, lambda s: s["bin"]), error)

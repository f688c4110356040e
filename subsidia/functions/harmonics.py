"""Annual harmonics as (sin, cos) coefficient pairs; a positive lag is a delay."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Days of a year.
PERIOD = 365.2425


def harmonic_value(sin: Column, cos: Column, day: Column, period: float = PERIOD) -> Column:
    """The value at a day of the harmonic with these coefficients."""
    angle = day * F.lit(2 * math.pi / period)
    return sin * F.sin(angle) + cos * F.cos(angle)


def phase_days(sin: Column, cos: Column, period: float = PERIOD) -> Column:
    """The phase atan2(sin, cos) in days, in [0, period)."""
    return F.pmod(F.atan2(sin, cos) * F.lit(period / (2 * math.pi)), F.lit(period))


def delayed(sin: Column, cos: Column, lag: Column | float, period: float = PERIOD) -> tuple[Column, Column]:
    """Coefficients of the harmonic delayed by lag days."""
    turn, slope = _turn(lag, period)
    return sin * turn + cos * slope, cos * turn - sin * slope


def delay_slope(sin: Column, cos: Column, lag: Column | float, period: float = PERIOD) -> tuple[Column, Column]:
    """Derivatives of delayed() by the lag."""
    turn, slope = _turn(lag, period)
    w = F.lit(2 * math.pi / period)
    return (cos * turn - sin * slope) * w, (-cos * slope - sin * turn) * w


def _turn(lag: Column | float, period: float) -> tuple[Column, Column]:
    if isinstance(lag, Column):
        angle = lag * F.lit(2 * math.pi / period)
        return F.cos(angle), F.sin(angle)
    angle = 2 * math.pi * lag / period
    return F.lit(math.cos(angle)), F.lit(math.sin(angle))


def circular_difference(a: Column, b: Column, period: float = PERIOD) -> Column:
    """b - a on the circle, in (-period / 2, period / 2]."""
    d = F.pmod(b - a, F.lit(period))
    return F.when(d > period / 2, d - F.lit(period)).otherwise(d)


def direction_label(shift: Column) -> Column:
    return F.when(shift > 0, F.lit("positive_delay")).otherwise(F.lit("negative_or_zero_delay"))


def amplitude(sin: Column, cos: Column) -> Column:
    return F.hypot(sin, cos)


def cyclic_limits(period: float = PERIOD) -> tuple[float, float]:
    """Colour limits for maps of phases."""
    return 0.0, period

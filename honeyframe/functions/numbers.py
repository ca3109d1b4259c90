"""Small numeric column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LN_SQRT_2PI = 0.918938533204673  # fixed value: ln(sqrt(2 pi))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(col(c), 6) + F.lit(0.0)


def safe_div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def exp2(c) -> Column:
    return F.pow(F.lit(2.0), col(c))


def wrap_angle(c, period: float) -> Column:
    """Java-style remainder, then into (-period/2, period/2]."""
    a = col(c) % F.lit(period)
    return (
        F.when(a > period / 2, a - period).when(a <= -period / 2, a + period).otherwise(a)
    )


def positive_angle(c) -> Column:
    a = col(c)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def circular_mean(angle, weight, fold: int) -> Column:
    """Aggregate: weighted mean angle of period 2 pi / fold."""
    a, w = col(angle) * fold, col(weight)
    return F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a))) / fold

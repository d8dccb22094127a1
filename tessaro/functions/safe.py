"""Column helpers that never raise under ANSI rules and never let NaN or infinity through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sdiv(a: Column, b: Column, least: float = EPS) -> Column:
    """a / b, null where b is nearer to zero than `least`."""
    return F.when(F.abs(b) >= least, F.try_divide(a, b))


def sln(x: Column) -> Column:
    """ln(x), null for x <= 0."""
    return F.when(x > 0, F.ln(x))


def clip(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; greatest() and least() alone would turn null into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))

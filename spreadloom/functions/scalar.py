"""Scalar expressions with this library's conventions: missing is NULL, never NaN; division by zero is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least price that a logarithm sees.
EPS = 1e-8


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def null_if_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def zero_if_missing(x: Column) -> Column:
    """NULL and NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def log_price(x: Column, eps: float = EPS) -> Column:
    return F.ln(F.greatest(x, F.lit(eps)))


def is_close_to_zero(x: Column, atol: float = 1e-12) -> Column:
    return F.abs(x) <= atol


def rounded(x: Column, digits: int = 6) -> Column:
    """round, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def protected_div(a: Column, b: Column) -> Column:
    """1 where the divisor is within 0.001 of 0."""
    return F.when(F.abs(b) > 0.001, F.try_divide(a, b)).otherwise(1.0)


def protected_sqrt(a: Column) -> Column:
    return F.sqrt(F.abs(a))


def protected_log(a: Column) -> Column:
    """Logarithm of the magnitude; 0 where it is within 0.001 of 0."""
    return F.when(F.abs(a) > 0.001, F.ln(F.abs(a))).otherwise(0.0)


def format_float(x: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", x), F.lit("nan"))


def to_number(x: Column) -> Column:
    """NULL for what isn't a number."""
    return x.try_cast("double")

"""Scalar expressions with explicit treatment of null, NaN and infinity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value):
    return value if isinstance(value, Column) else F.col(value)


def is_finite(value):
    """True for ordinary numbers; false for null, NaN and both infinities."""
    x = as_column(value).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def finite_or_null(value):
    return F.when(is_finite(value), as_column(value).cast("double"))


def not_nan_or_null(value):
    """The value as a double, with NaN turned into null and infinities kept."""
    x = as_column(value).cast("double")
    return F.when(~F.isnan(x), x)


def ratio(numerator, denominator, empty=0.0):
    """Quotient as a double; ``empty`` when the denominator is zero or null."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(empty).cast("double")
    )

"""Rounding and guarded division on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals at which a computed double is settled first, so that a decimal tie such as
# 1.025, which no double holds exactly, rounds the way the decimal would.
_SETTLED = 10


def as_double(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def round_to(value: Column, digits: int = 0) -> Column:
    """Round half away from zero, as DOUBLE.

    Spark rounds the shortest decimal that stands for the double, whatever its size.
    """
    settled = F.round(as_double(value), _SETTLED)
    rounded = settled if digits >= _SETTLED else F.round(settled, digits)
    return rounded + 0.0  # turns -0.0 into 0.0


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as DOUBLE; NULL where the divisor is 0 or NULL."""
    return as_double(top) / F.nullif(as_double(bottom), F.lit(0.0))


def ladder(*rungs: tuple[Column, object], default: object) -> Column:
    """First rung whose condition holds gives the value."""
    (condition, value), *rest = rungs
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def total(column: Column | str) -> Column:
    """Exact decimal sum reported as DOUBLE."""
    return as_double(F.sum(column))


def mean(column: Column | str) -> Column:
    """Mean from an exact sum: the same bits whatever the row order."""
    return ratio(F.sum(column), F.count(column))


def exact_sum(value: Column, digits: int) -> Column:
    """Sum of a rounded double, added up as decimals so that row order cannot matter."""
    return as_double(F.sum(value.cast(f"decimal(18,{digits})")))


def exact_mean(value: Column, digits: int) -> Column:
    rounded = value.cast(f"decimal(18,{digits})")
    return ratio(F.sum(rounded), F.count(rounded))

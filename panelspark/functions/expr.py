"""Scalar expressions.  All of them give NULL, never an error, on data ANSI mode would reject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator: ColumnOrName, divisor: ColumnOrName) -> Column:
    """``numerator / divisor`` as double; NULL when the divisor is 0 or either side is NULL."""
    return F.try_divide(_col(numerator).cast("double"), _col(divisor).cast("double"))


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``100 * part / whole`` with the NULL rules of :func:`safe_ratio`."""
    return safe_ratio(F.lit(100.0) * _col(part), whole)


def null_strict_sum(columns: list[ColumnOrName]) -> Column:
    """Row-wise sum that is NULL as soon as one addend is NULL."""
    return reduce(lambda a, b: a + b, [_col(c) for c in columns])


def period_label(last: ColumnOrName, n: int, separator: str = " - ") -> Column:
    """``"<last-n+1><separator><last>"``, the name of an n-period frame ending at ``last``."""
    last = _col(last).cast("int")
    return F.concat((last - F.lit(n - 1)).cast("string"), F.lit(separator), last.cast("string"))


def month_number(month: ColumnOrName) -> Column:
    """Month 1..12 held as text or number; NULL for total rows such as ``Annual``."""
    number = _col(month).cast("string").try_cast("int")
    return F.when(number.between(1, 12), number)


def quarter_of_month(month: ColumnOrName) -> Column:
    """1-3 -> 1, ..., 10-12 -> 4, anything else -> NULL."""
    return F.floor((month_number(month) + F.lit(2)) / F.lit(3)).cast("int")


def date_quarter(text: ColumnOrName, pattern: str = "M/d/yyyy") -> Column:
    """Quarter of a date held as text; NULL when the text is not a date."""
    return F.quarter(F.try_to_date(_col(text), pattern)).cast("int")


def text_bar(value: ColumnOrName, low: Column, high: Column, width: int = 100) -> Column:
    """Min-max scaled bar of ``*``; the length is rounded to the nearest integer."""
    length = F.round(safe_ratio(F.lit(float(width)) * (_col(value) - low), high - low))
    return F.repeat(F.lit("*"), length.cast("int"))

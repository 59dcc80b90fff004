"""NULL rules of the measurement algebra.

A group total is NULL as soon as one member is NULL, a quotient is NULL when it
is not finite, and NaN / infinite inputs count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def is_finite(x: Column) -> Column:
    """True for a finite number, otherwise false or NULL (NaN sorts above infinity in Spark)."""
    return F.abs(x) < F.lit(_INF)


def finite(x: Column) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    return F.when(is_finite(x), x)


def complete(x: Column) -> Column:
    """Aggregate: no member of the group is NULL."""
    return F.count(x) == F.count(F.lit(1))


def strict_sum(x: Column) -> Column:
    return F.when(complete(x), F.sum(x))


def strict_avg(x: Column) -> Column:
    return F.when(complete(x), F.avg(x))


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))

"""p-values of the three reports.

Spark has no erf or incomplete beta function. The reports hold one row per
facet, so these small vector helpers only ever see the tail of an aggregation.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# ship these helpers with the query: executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi2_sf_1df(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300

    def guard(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c = 1.0
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d
    limit = 200 + int(8 * math.sqrt(max(a, b)))
    for m in range(1, limit):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    return math.nan  # not converged


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(Gamma(a + b) / Gamma(a)), without cancellation when a is large and b small."""
    if a > 1e6 and b < 1e3:
        return b * math.log(a) + b * (b - 1.0) / (2.0 * a)
    return math.lgamma(a + b) - math.lgamma(a)


def beta_inc(x: float, y: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), given x and y = 1 - x."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(_log_gamma_ratio(a, b) - math.lgamma(b) + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(y, b, a) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    total = d2 + d1 * f
    return beta_inc(d2 / total, d1 * f / total, d2 / 2.0, d1 / 2.0)


def t_sf_two_sided(t: float, df: float) -> float:
    total = df + t * t
    return beta_inc(df / total, t * t / total, df / 2.0, 0.5)


def _each(fn, *series: pd.Series) -> pd.Series:
    values = [
        None if any(v is None or (isinstance(v, float) and np.isnan(v)) for v in row) else fn(*map(float, row))
        for row in zip(*series)
    ]
    return pd.Series(values, dtype="float64")


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _tail(fn, *args: Column) -> Column:
    @pandas_udf("double")
    def tail(*series: pd.Series) -> pd.Series:
        return _each(fn, *series)

    return _known(tail(*[a.cast("double") for a in args]))


def chi2_p(h: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom; NULL stays NULL."""
    return _tail(chi2_sf_1df, h)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _tail(f_sf, f, d1, d2)


def t_p(t: Column, df: Column) -> Column:
    return _tail(t_sf_two_sided, t, df)


def p_text(p: Column) -> Column:
    """Report text: '<0.0001' or four decimals; NULL stays NULL."""
    return F.when(p < 0.0001, F.lit("<0.0001")).when(p.isNotNull(), F.format_string("%.4f", p))

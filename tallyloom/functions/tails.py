"""Tails of the t, F and normal distributions as Arrow-batched column functions.

The statistics these are applied to are result rows (a few per group), never
raw data; the numerics work on whole numpy batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a, b, x, rounds=300):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds + 1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a, b, x = a[ok], b[ok], x[ok]
    safe = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(safe) + b * np.log1p(-safe)
    ) if x.size else x
    left = x < (a + 1) / (a + b + 2)
    lower = np.where(left, front * _beta_fraction(a, b, safe) / a, 0.0)
    upper = np.where(~left, 1 - front * _beta_fraction(b, a, 1 - safe) / b, 0.0)
    res = np.where(left, lower, upper)
    out[ok] = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, res))
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(p, df):
    """Quantile of the t distribution for p in (0.5, 1) by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, dtype=float), np.asarray(df, dtype=float))
    lo, hi = np.zeros(p.shape), np.full(p.shape, 1e6)
    target = 2 * (1 - p)
    for _ in range(100):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(df > 0, (lo + hi) / 2, np.nan)


def t_pvalue(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t, df))

    return tail(t.cast("double"), df.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series(f_upper(f, d1, d2))

    return tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_critical(level: float, df: Column) -> Column:
    """Two-sided critical value, for example 0.95 to the 97.5 % quantile."""

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        return pd.Series(t_quantile(0.5 + level / 2, df))

    return quantile(df.cast("double"))

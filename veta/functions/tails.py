"""Tail probabilities for small summary tables (F, t, binomial, normal), applied batch-wise."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_regularised(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    if f is None or np.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if np.isinf(f):
        return 0.0
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    if t is None or np.isnan(t) or df <= 0:
        return float("nan")
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def normal_cdf(z: float) -> float:
    return 0.5 * erfc(-z / sqrt(2))


def binomial_at_least(k: float, n: float, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    if k <= 0:
        return 1.0
    return beta_regularised(k, n - k + 1, p)


def _nullable(values) -> pd.Series:
    return pd.Series([None if v is None or np.isnan(v) else float(v) for v in values], dtype="object")


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _nullable([f_tail(*v) if not pd.isna(v[0]) else None for v in zip(f, d1, d2, strict=True)])


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable([t_two_sided(*v) if not pd.isna(v[0]) else None for v in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def binomial_pvalue(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _nullable([binomial_at_least(*v) for v in zip(k, n, p, strict=True)])

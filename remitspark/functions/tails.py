"""Tail probabilities Spark has no built-in for. Used on aggregated rows only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h * scale


@F.pandas_udf(T.DoubleType())
def chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """P(chi-square with ``dof`` degrees >= statistic)."""
    return pd.Series(
        [
            None if pd.isna(s) or pd.isna(k) or k < 1 else upper_gamma(float(k) / 2, float(s) / 2)
            for s, k in zip(statistic, dof)
        ],
        dtype="float64",
    )


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return pd.Series([None if pd.isna(v) else normal_two_sided(float(v)) for v in z], dtype="float64")

"""Normal and t quantiles as driver scalars, and as Arrow-batched column functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function, by Lentz's scheme."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, abs(1.0 - (a + b) * x / (a + 1.0))) * (1 if 1.0 - (a + b) * x / (a + 1.0) > 0 else -1)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """By bisection; large df meet the normal quantile."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2.0


def normal_cdf_column(c: Column) -> Column:
    """Phi of a double column, in Arrow batches: SQL has no erf."""

    @F.pandas_udf("double")
    def phi(x: pd.Series) -> pd.Series:
        return pd.Series(0.5 * np.vectorize(math.erfc, otypes=[float])(-x.to_numpy(float) / math.sqrt(2.0)))

    return phi(c.cast("double"))


def normal_quantile_column(c: Column) -> Column:
    """The normal quantile of a double column within (0, 1), in Arrow batches."""

    @F.pandas_udf("double")
    def quantile(x: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return pd.Series([inv(v) if v is not None and 0.0 < v < 1.0 else float("nan") for v in x])

    return quantile(c.cast("double"))

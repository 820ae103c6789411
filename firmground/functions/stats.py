"""Normal quantiles, tail probabilities and the two-sample statistics used by error and experiment read-outs."""
from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F


def z_value(p: float) -> float:
    return NormalDist().inv_cdf(p)


# Task functions of this module travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype("float64")


def normal_p(z: Column | str) -> Column:
    """Two-sided tail probability of a standard normal; meant for small summary tables."""
    return F.pandas_udf(_normal_tail, "double")(z)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument beyond 10 by the recurrence."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(10):
        small = x < 10
        shift = np.where(small, shift - np.log(x), shift)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def _beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function at ``x = 1 - other``, by its continued fraction for all rows at once."""
    turn = x > (a + 1) / (a + b + 2)
    a, b, x, other = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, other, x), np.where(turn, x, other)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log(other)) / a
    tiny = lambda v: np.where(v == 0, 1e-300, v)
    c, d = np.ones_like(x), 1 / tiny(1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for k in (even, odd):
            d = 1 / tiny(1 + k * d)
            c = tiny(1 + k / c)
            total *= c * d
        if np.nanmax(np.abs(c * d - 1), initial=0.0) < 1e-14:
            break
    part = np.where(x <= 0, 0.0, front * total)
    return np.where(turn, 1 - part, part)


def _student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    v, k = t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)
    known = ~np.isnan(v) & ~np.isnan(k) & (k > 0)
    v, k = v[known], k[known]
    out = np.full(len(t), np.nan)
    with np.errstate(invalid="ignore"):
        x, other = np.where(np.isinf(v), 0.0, k / (k + v * v)), np.where(np.isinf(v), 1.0, v * v / (k + v * v))
    out[known] = _beta_tail(k / 2, np.full_like(k, 0.5), x, other)
    return pd.Series(out).where(known)


def student_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided tail probability of Student's t; meant for small summary tables."""
    return F.pandas_udf(_student_tail, "double")(t, df)


def two_proportion_z(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    """Pooled z statistic; NULL without spread or with an empty side."""
    pooled = F.try_divide(p1 * n1 + p2 * n2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.try_divide(p1 - p2, se)


def sample_var(n: Column, s: Column, q: Column) -> Column:
    """Sample variance from count, sum and sum of squares."""
    return F.when(n > 1, F.greatest((q - s * s / F.greatest(n, F.lit(1))) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """Welch's t statistic and its degrees of freedom."""
    a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    return t, df

"""NaN-aware columns, moments and significance. NaN is a missing number; no comparison with it holds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def number(c: Column | str) -> Column:
    """The value, or null where it is NaN, so that aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def above(c: Column | str, limit) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (c > limit), F.lit(False))


def below(c: Column | str, limit) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (c < limit), F.lit(False))


def moments(x: Column, y: Column) -> list[Column]:
    """Aggregates n, sx, sy, sxx, syy, sxy over the rows where both are numbers."""
    both = F.isnotnull(x) & F.isnotnull(y) & ~F.isnan(x) & ~F.isnan(y)
    x, y = F.when(both, x), F.when(both, y)
    parts = {"n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    return [v.alias(k) for k, v in parts.items()]


def pearson(n="n", sx="sx", sy="sy", sxx="sxx", syy="syy", sxy="sxy", tiny: float = 1e-12) -> Column:
    """r from moments; null for fewer than two rows or a constant side (variance under `tiny` of the mean square)."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) if isinstance(c, str) else c for c in (n, sx, sy, sxx, syy, sxy))
    vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    varies = (vx > tiny * sxx) & (vy > tiny * syy)
    return F.when((n >= 2) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))


def betainc(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    small = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < small, small, d)
    total = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < small, small, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < small, small, c)
            total *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    found = np.where(x <= 0, 0.0, front * total)
    return np.where(flip, 1 - found, found)


def p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    df = np.maximum(n.fillna(2).to_numpy(float) - 2, 0)
    value = r.to_numpy(float)
    known = ~np.isnan(value)
    p = np.where(known, 1.0, np.nan)
    test = known & (df > 0)
    if test.any():
        p[test] = betainc(df[test] / 2, 0.5, 1 - np.minimum(value[test] ** 2, 1))
    return pd.Series(p).astype("Float64").mask(~known)


def pearson_p(r: str, n: str) -> Column:
    """Two-sided p-value of a Pearson r over n rows; 1 for two rows, null where r is."""
    return F.pandas_udf(p_values, "double")(F.col(r), F.col(n))


def ks_p(statistic: float, n: int, m: int) -> float:
    """Two-sided two-sample Kolmogorov-Smirnov p-value by the asymptotic series."""
    root = math.sqrt(n * m / (n + m))
    z = root * statistic
    if z < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))))


def savgol_weights(win: int, poly: int) -> list[float]:
    """Weights of the centre value of a least-squares polynomial over `win` equally spaced values."""
    at = np.arange(win) - win // 2
    return np.linalg.pinv(np.vander(at, poly + 1, increasing=True))[0].tolist()


def elementwise(make, *columns: Column, is_array: bool) -> Column:
    """make(*columns), or the array of it over the elements of array columns."""
    if not is_array:
        return make(*columns)
    return F.transform(F.sequence(F.lit(1), F.size(columns[0])), lambda i: make(*(F.element_at(c, i) for c in columns)))

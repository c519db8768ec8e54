"""Numeric functions as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def finite(value: Column) -> Column:
    """A finite double, or null; for strings the number that they spell."""
    v = F.expr(f"try_cast({value._jc.toString()} as double)") if isinstance(value, str) else value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def number_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# Coefficients of the rational approximation of the normal quantile, centre and tails.
_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def normal_quantile(p: float) -> float:
    """The standard normal's quantile, to about nine digits."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    value = lambda pair, x: _power_sum(pair[0], x) / _power_sum(pair[1], x)
    if min(p, 1 - p) < 0.02425:
        tail = value(_TAIL, math.sqrt(-2 * math.log(min(p, 1 - p))))
        return tail if p < 0.5 else -tail
    return (p - 0.5) * value(_CENTRE, (p - 0.5) ** 2)


def _power_sum(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(reversed(coefficients)))


def wilson_upper(failures: Column, count: Column, delta: float) -> Column:
    """The one-sided upper bound of a failure rate by Wilson's score interval; 1 where nothing was counted."""
    z = normal_quantile(1 - delta)
    n = F.nullif(count.cast("double"), F.lit(0.0))
    p = failures / n
    centre, margin = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.coalesce(F.least(F.lit(1.0), (centre + margin) / (1 + z * z / n)), F.lit(1.0))


def binomial_upper(failures: Column, count: Column, delta: float) -> Column:
    """The exact one-sided upper bound (Clopper-Pearson): the rate at which so few failures have probability delta. Spark has no
    beta quantile, so an Arrow function finds it."""

    @pandas_udf("double")
    def bound(f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(upper_rates(f.to_numpy(float), n.to_numpy(float), delta))

    return F.coalesce(F.when(failures < count, bound(failures.cast("double"), count.cast("double"))), F.lit(1.0))


def upper_rates(failures: np.ndarray, count: np.ndarray, delta: float) -> np.ndarray:
    """By bisection: P(at most f of n fail) is 1 - I(p; f + 1, n - f) with the incomplete beta integral I."""
    a, b = failures + 1, np.maximum(count - failures, 1e-9)
    scale = np.array([math.lgamma(x + y) - math.lgamma(x) - math.lgamma(y) for x, y in zip(a, b, strict=True)])
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        p = (low + high) / 2
        above = _beta_integral(p, a, b, scale) < 1 - delta
        low, high = np.where(above, p, low), np.where(above, high, p)
    return (low + high) / 2


def _beta_integral(x: np.ndarray, a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta integral, by the continued fraction that converges on x's side of the mean."""
    swap = x > (a + 1) / (a + b + 2)
    u, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(scale + p * np.log(u) + q * np.log1p(-u)) / p
        value, c, d = np.ones(len(x)), np.ones(len(x)), 1 / _off_zero(1 - (p + q) * u / (p + 1))
        value = d.copy()
        for m in range(1, 100_000):
            for factor in (m * (q - m) / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / _off_zero(1 + factor * u * d)
                c = _off_zero(1 + factor * u / c)
                value = value * c * d
            if (np.abs(c * d - 1) < 1e-14).all():
                break
    part = np.where(u > 0, front * value, 0.0)
    return np.where(swap, 1 - part, part)


def _off_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def day(text: Column) -> Column:
    """The date that the first ten characters spell, or null."""
    return F.when(F.regexp_like(F.substring(text, 1, 10), F.lit("^\\d{4}-\\d{2}-\\d{2}$")), F.substring(text, 1, 10).try_cast("date"))


def jurisdiction_applies(area: Column, asked: Column) -> Column:
    """Whether an area covers the asked one: blank, worldwide, equal, or the nation of its part."""
    a, q = F.upper(F.trim(area)), F.upper(F.trim(asked))
    return a.isin("", "GLOBAL", "ALL") | (a == q) | F.startswith(q, F.concat(a, F.lit("-")))

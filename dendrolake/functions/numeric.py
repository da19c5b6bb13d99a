"""Special functions over Arrow batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: float) -> float:
    """Recurrence up to six, then the asymptotic series."""
    if not x > 0:
        return float("nan")
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def gamma_cdf(x: float, shape: float) -> float:
    """Regularised lower incomplete gamma function: series below shape + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (d * a + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_quantile(p: float, shape: float) -> float:
    """Inverse of gamma_cdf by bisection."""
    lo, hi = 0.0, max(1.0, shape)
    while gamma_cdf(hi, shape) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf(mid, shape) < p else (lo, mid)
    return (lo + hi) / 2


def _batched(f):
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else f(v))

    return run


def erf(x: Column) -> Column:
    return _batched(math.erf)(x.cast("double"))


def digamma_of(x: Column) -> Column:
    return _batched(digamma)(x.cast("double"))


def normal_quantile(p: Column) -> Column:
    return _batched(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else float("nan"))(p.cast("double"))


def truncated_exponential(u: Column, rate: Column, lower: Column, upper: Column) -> Column:
    """A draw by inversion from a uniform u; uniform where the rate hardly matters; within the bounds."""
    width = upper - lower
    flat = lower + u * width
    x = lower - F.log1p(u * F.expm1(-rate * width)) / rate
    return F.greatest(lower, F.least(upper, F.when(F.abs(rate * width) < 1e-12, flat).otherwise(x)))


def hash_uniform(seed: Column, *key: Column) -> Column:
    """A number in (0, 1) that depends on seed and key alone, whatever the order or partition of rows."""
    return (F.pmod(F.xxhash64(seed, *key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

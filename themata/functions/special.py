"""Digamma, trigamma and log-gamma: NumPy for kernels, Column form for queries.

All shift the argument up by six with the recurrence and use the asymptotic
series there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 6

# Coefficients of the asymptotic series (Bernoulli numbers).
# digamma(y) = ln y - 1/(2y) - sum c_i / y^(2i)
DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12, -3617 / 8160)
# trigamma(y) = 1/y + 1/(2y^2) + sum c_i / y^(2i+1)
TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510)
# lgamma(y) = (y - 1/2) ln y - y + ln(2 pi)/2 + sum c_i / y^(2i-1)
LGAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
HALF_LOG_TWO_PI = 0.5 * math.log(2 * math.pi)


def _series(u, coefficients):
    """sum c_i u^(i-1) by Horner's rule."""
    total = coefficients[-1]
    for c in coefficients[-2::-1]:
        total = total * u + c
    return total


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    y = x + SHIFT
    r = 1.0 / y
    u = r * r
    out = np.log(y) - 0.5 * r - u * _series(u, DIGAMMA)
    # 1/x + ... + 1/(x + 5), where 1/(x + i) + 1/(x + 5 - i) share a numerator.
    pair = x * (x + 5)
    return out - (2 * x + 5) * (1.0 / pair + 1.0 / (pair + 4) + 1.0 / (pair + 6))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    r = 1.0 / (x + SHIFT)
    u = r * r
    out = r + 0.5 * u + r * u * _series(u, TRIGAMMA)
    for i in range(SHIFT):
        out += 1.0 / (x + i) ** 2
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    y = x + SHIFT
    r = 1.0 / y
    out = (y - 0.5) * np.log(y) - y + HALF_LOG_TWO_PI + r * _series(r * r, LGAMMA)
    rising = x.copy()
    for i in range(1, SHIFT):
        rising = rising * (x + i)
    return out - np.log(rising)


def dirichlet_expectation(x: np.ndarray) -> np.ndarray:
    """Expected log of Dirichlet variables, one distribution per row."""
    # One call for values and sums: for small arrays, calls are what takes the time.
    both = digamma(np.concatenate([x, x.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def digamma_col(x: Column) -> Column:
    y = x + F.lit(float(SHIFT))
    u = F.lit(1.0) / (y * y)
    out = F.log(y) - F.lit(0.5) / y - u * _series(u, DIGAMMA)
    for i in range(SHIFT):
        out = out - F.lit(1.0) / (x + F.lit(float(i)))
    return out


def lgamma_col(x: Column) -> Column:
    y = x + F.lit(float(SHIFT))
    r = F.lit(1.0) / y
    out = (y - F.lit(0.5)) * F.log(y) - y + F.lit(HALF_LOG_TWO_PI) + r * _series(r * r, LGAMMA)
    rising = x
    for i in range(1, SHIFT):
        rising = rising * (x + F.lit(float(i)))
    return out - F.log(rising)


def dirichlet_expectation_col(x: Column, total: Column | None = None) -> Column:
    """Expected log of an array column, against its own sum or a given array of sums."""
    if total is None:
        own = F.array(F.aggregate(x, F.lit(0.0), lambda a, b: a + b))
        own = F.array_repeat(F.get(F.transform(own, digamma_col), F.lit(0)), F.size(x))
        return F.zip_with(x, own, lambda v, s: digamma_col(v) - s)
    return F.zip_with(x, total, lambda v, s: digamma_col(v) - digamma_col(s))

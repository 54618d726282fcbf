"""Random numbers that depend on keys only, never on partitions or row order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the SplitMix64 generator.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = z + GOLDEN
        z = (z ^ (z >> np.uint64(30))) * MIX_A
        z = (z ^ (z >> np.uint64(27))) * MIX_B
        return z ^ (z >> np.uint64(31))


def _uniform(state: np.ndarray, stream: int) -> np.ndarray:
    """Values in (0, 1) for one numbered stream of each state."""
    bits = _mix(state ^ _mix(np.asarray([stream], dtype=np.uint64)))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gamma_draws(
    ids: np.ndarray, width: int, seed: int, iteration: int, shape: float = 100.0
) -> np.ndarray:
    """Gamma(shape, 1/shape) values, one row per id, by Marsaglia and Tsang's method."""
    key = _mix(np.asarray([seed & (2**64 - 1)], dtype=np.uint64))
    key = _mix(key ^ np.asarray([iteration], dtype=np.uint64))
    rows = _mix(np.asarray(ids).astype(np.int64).view(np.uint64) ^ key)
    state = _mix(rows[:, None] ^ _mix(np.arange(width, dtype=np.uint64))[None, :]).ravel()
    d = shape - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    out = np.empty(state.size)
    open_at = np.arange(state.size)
    attempt = 0
    while open_at.size:
        s = state[open_at]
        u1, u2, u3 = (_uniform(s, 3 * attempt + i) for i in range(3))
        x = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)
        v = (1.0 + c * x) ** 3
        taken = v > 0
        taken[taken] = np.log(u3[taken]) < (
            0.5 * x[taken] ** 2 + d - d * v[taken] + d * np.log(v[taken])
        )
        out[open_at[taken]] = d * v[taken] / shape
        open_at = open_at[~taken]
        attempt += 1
    return out.reshape(len(rows), width)


def uniform_col(seed: int, iteration: Column, key: Column) -> Column:
    """A uniform value in [0, 1) from an MD5 digest, the same in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), iteration.cast("string"), F.lit(":"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_thresholds(rate: float) -> list[float]:
    """P(X <= j) for j = 0, 1, ... until it reaches one."""
    out, term, total, j = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        if total >= 1.0 or (j > rate and term < 2.0**-54):
            return out
        out.append(total)
        j += 1
        term *= rate / j

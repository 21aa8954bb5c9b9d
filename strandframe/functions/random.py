"""Random draws as columns: functions of a key and a seed only, so reruns and lost tasks give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Proposals of a gamma draw.
TRIALS = 6


def uniform(key: Column, seed: int = 0, draw: int = 0) -> Column:
    """In (0, 1), from 52 bits of the md5 of seed, draw and key: any SQL engine can draw the same."""
    text = F.concat(F.lit(f"{seed}:{draw}:"), key.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) * 2.0**-52


def exponential(key: Column, rate: float = 1.0, seed: int = 0, draw: int = 0) -> Column:
    return -F.log(uniform(key, seed, draw)) / rate


def normal(key: Column, mean: float = 0.0, sd: float = 1.0, seed: int = 0) -> Column:
    """Box-Muller."""
    return mean + sd * F.sqrt(-2 * F.log(uniform(key, seed, 1))) * F.cos(2 * 3.141592653589793 * uniform(key, seed, 2))


def gamma(key: Column, shape: float, scale: float = 1.0, seed: int = 0) -> Column:
    """A whole shape is a sum of exponentials; any other one is drawn by squeezing a cubed normal.

    Each of TRIALS proposals is accepted with a chance of over 0.95; should all fail, the last one stands. A shape under
    1 is that of shape + 1 times a power of a uniform.
    """
    if shape == int(shape):
        return scale * sum((exponential(key, 1.0, seed, 10 + i) for i in range(int(shape))), F.lit(0.0))
    if shape < 1:
        return gamma(key, shape + 1, scale, seed) * F.pow(uniform(key, seed, 9), F.lit(1 / shape))
    d = shape - 1 / 3
    out = None
    for i in reversed(range(TRIALS)):
        x = F.sqrt(-2 * F.log(uniform(key, seed, 100 + 3 * i))) * F.cos(2 * 3.141592653589793 * uniform(key, seed, 101 + 3 * i))
        v = F.pow(1 + x / math.sqrt(9 * d), F.lit(3))
        taken = (v > 0) & (F.log(uniform(key, seed, 102 + 3 * i)) < 0.5 * x * x + d - d * v + d * F.log(F.when(v > 0, v)))
        out = d * F.abs(v) if out is None else F.when(taken, d * v).otherwise(out)
    return scale * out


def beta(key: Column, a: float, b: float, seed: int = 0) -> Column:
    x, y = gamma(key, a, 1.0, seed), gamma(key, b, 1.0, seed + 1)
    return x / (x + y)


def chi_square(key: Column, freedom: float, seed: int = 0) -> Column:
    return gamma(key, freedom / 2, 2.0, seed)


def student_t(key: Column, freedom: float, seed: int = 0) -> Column:
    return normal(key, 0.0, 1.0, seed) / F.sqrt(chi_square(key, freedom, seed + 7) / freedom)


def poisson(key: Column, mean: float, seed: int = 0) -> Column:
    """By inversion up to mean + 10 deviations, for means up to some hundreds."""
    most, p, total, out = int(mean + 10 * math.sqrt(mean) + 10), math.exp(-mean), 0.0, []
    for k in range(most):
        total += p
        p *= mean / (k + 1)
        out.append(total)
    u = uniform(key, seed, 3)
    return F.size(F.filter(F.array(*[F.lit(x) for x in out]), lambda x: x < u))

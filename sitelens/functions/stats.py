"""Distribution functions that neither Spark nor the standard library has."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * h


def chi2_survival(x: float, df: float) -> float:
    """Chance of a chi-square value above x."""
    return gamma_q(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@F.arrow_udf(DoubleType())
def _chi2(x: pa.Array, df: pa.Array) -> pa.Array:
    return pa.array([None if a is None or k is None else chi2_survival(a, k) for a, k in zip(x.to_pylist(), df.to_pylist(), strict=True)], pa.float64())


def chi2_sf(x: Column, df: Column) -> Column:
    return _chi2(x.cast("double"), df.cast("double"))


#: The distribution of U is worked out in whole numbers up to the first of these many values of it, in floats up to the second; beyond, the normal one differs by less than 0.01.
EXACT_VALUES, MAX_VALUES = 10_000, 20_000_000


def u_counts(m: int, n: int) -> list[int]:
    """Number of orders of m and n untied values for each U from 0 to m * n.

    Coefficients of the Gaussian binomial: a factor (1 - q^(n+k)) / (1 - q^k) at a time.
    """
    table = [1] + [0] * (m * n)
    for k in range(1, m + 1):
        for i in range(m * n, n + k - 1, -1):
            table[i] -= table[i - n - k]
        for i in range(k, m * n + 1):
            table[i] += table[i - k]
    return table


def u_shares(m: int, n: int) -> np.ndarray:
    """Share of the orders of m and n untied values that have each U from 0 to m * n.

    A recurrence on the smaller side: the share for one more value on it is a
    running mean of the share before, so nothing is subtracted but running sums.
    """
    m, n = min(m, n), max(m, n)
    share = np.zeros(m * n + 1)
    share[0] = 1.0
    for k in range(1, m + 1):
        # coefficients of (1 - q^(n+k)) / (1 - q^k), scaled by k / (n + k)
        top = k * n
        wide = np.zeros(-(-(top + 1) // k) * k)
        wide[: top + 1] = share[: top + 1]
        wide[n + k : top + 1] -= share[: top + 1 - n - k]
        share[: top + 1] = np.cumsum(wide.reshape(-1, k), axis=0).reshape(-1)[: top + 1] * (k / (n + k))
        half = top // 2  # the distribution is symmetric; its later half has the sums' rounding errors
        share[top - half : top + 1] = share[: half + 1][::-1]
    return share


def mann_whitney_p(u: float, m: int, n: int, ties: float) -> float:
    """Two-sided p of U: exact for 8 values or fewer on a side without ties (up to MAX_VALUES values of U), else normal with corrections."""
    top = max(u, m * n - u)
    if min(m, n) <= 8 and ties == 0 and m * n <= MAX_VALUES:
        if m * n <= EXACT_VALUES:
            counts = u_counts(m, n)
            return min(1.0, 2 * sum(counts[math.ceil(top) :]) / sum(counts))
        return min(1.0, 2 * float(u_shares(m, n)[: m * n - math.ceil(top) + 1].sum()))
    total = m + n
    variance = m * n / 12 * ((total + 1) - ties / (total * (total - 1)))
    if variance <= 0:
        return 1.0
    return min(1.0, normal_two_sided((top - m * n / 2 - 0.5) / math.sqrt(variance)))


@F.arrow_udf(DoubleType())
def _mann_whitney(u: pa.Array, m: pa.Array, n: pa.Array, ties: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (u, m, n, ties)), strict=True)
    return pa.array([None if None in r else mann_whitney_p(r[0], int(r[1]), int(r[2]), r[3]) for r in rows], pa.float64())


def mann_whitney(u: Column, m: Column, n: Column, ties: Column) -> Column:
    return _mann_whitney(u.cast("double"), m.cast("long"), n.cast("long"), ties.cast("double"))

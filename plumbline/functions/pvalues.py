"""Tail probabilities in plain mathematics, and their vectorised column forms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_sf1(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom; 1 if x is not positive or not finite."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 and math.isfinite(x) else 1.0


def normal_sf2(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-square with k degrees, by the Wilson-Hilferty cube root."""
    if x <= 0 or k <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf2(t: float, df: float) -> float:
    """Two-sided Student tail."""
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def binom_two_sided(k: int, n: int) -> float:
    """Exact two-sided binomial test at one half."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher test: the mass of all tables with these margins that are no likelier than the seen one; 1 if a margin is empty.

    Starts from the likeliest corner in logarithms and steps through the support by
    the ratio of neighbouring tables, so that large counts cost no factorials.
    """
    first, second, col = a + b, c + d, a + c
    other = first + second - col
    if min(first, second, col, other) == 0:
        return 1.0
    least, most = max(0, col - second), min(first, col)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    now = log(first, least) + log(second, col - least) - log(first + second, col)
    masses = [now]
    for x in range(least, most):
        now += math.log((first - x) * (col - x)) - math.log((x + 1) * (second - col + x + 1))
        masses.append(now)
    seen = masses[a - least] + 1e-7
    return min(1.0, math.fsum(math.exp(m) for m in masses if m <= seen))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else chi2_sf1(float(v)))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact below 25 discordant pairs, else Yates."""
    return pd.Series([binom_two_sided(int(x), int(x + y)) if x + y < 25 else chi2_sf1((abs(x - y) - 1) ** 2 / (x + y)) for x, y in zip(b, c)])


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher(*map(int, r)) for r in zip(a, b, c, d)])


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else t_sf2(float(x), float(k)) for x, k in zip(t, df)])

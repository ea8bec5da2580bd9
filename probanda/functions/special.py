"""Distribution functions for the few numbers per stratum that end at the driver."""

from __future__ import annotations

import math

import pandas as pd


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def _root(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return _root(lambda t: t_cdf(t, df) - p, -1e4, 1e4)


def nct_cdf(t: float, df: float, shift: float) -> float:
    """Noncentral t, by a series over Poisson-weighted beta functions."""
    if t < 0:
        return 1 - nct_cdf(-t, df, -shift)
    x, half = t * t / (df + t * t), shift * shift / 2
    total, log_half = normal_cdf(-shift), math.log(half) if half else -math.inf
    if half == 0:
        return t_cdf(t, df)
    for j in range(600):
        p = math.exp(-half + j * log_half - math.lgamma(j + 1))
        q = math.copysign(math.exp(-half + j * log_half - math.lgamma(j + 1.5)), shift) * abs(shift) / math.sqrt(2)
        step = 0.5 * (p * beta_inc(j + 0.5, df / 2, x) + q * beta_inc(j + 1, df / 2, x))
        total += step
        if j > half and abs(step) < 1e-14:
            break
    return total


def paired_power(effect: float, n: int, alpha: float = 0.05) -> float:
    """Power of a two-sided paired t test at a standardised effect."""
    df, shift = n - 1, effect * math.sqrt(n)
    edge = t_quantile(1 - alpha / 2, df)
    return 1 - nct_cdf(edge, df, shift) + nct_cdf(-edge, df, shift)


def mde_paired(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """Smallest standardised effect that ``n`` pairs find with the wanted power; NaN under 2 pairs."""
    return math.nan if n < 2 else _root(lambda d: paired_power(d, n, alpha) - power, 0.0, 60.0)


def recommended_n_paired(effect: float, alpha: float = 0.05, power: float = 0.8, most: int = 100_000) -> int:
    """Fewest pairs that find an effect with the wanted power."""
    low, high = 2, 2
    while high < most and paired_power(abs(effect), high, alpha) < power:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if paired_power(abs(effect), mid, alpha) >= power else (mid + 1, high)
    return low


def normal_p_column(z):
    """Two-sided p of a column of standard normal values, by the complementary error function's rational approximation, to 1.2e-7."""
    from pyspark.sql import functions as F

    # Coefficients of the published approximation.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        power = F.lit(c) + t * power
    return t * F.exp(power - x * x)


def normal_p_exact(z):
    """Two-sided p of a column of standard normal values, to double precision, by Arrow batches; null for null."""
    from pyspark.sql import functions as F

    def p(z: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype=object)

    return F.pandas_udf(p, "double")(z)


def t_p_column(t, df):
    """Two-sided p of a column of t values with ``df`` degrees of freedom, by Arrow batches; null for null and for df under 1."""
    from pyspark.sql import functions as F

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if v != v or not d >= 1 else 0.0 if math.isinf(v) else beta_inc(d / 2, 0.5, d / (d + v * v)) for v, d in zip(t, df, strict=True)], dtype=object)

    return F.pandas_udf(p, "double")(t, df)


def binomial_tail_column(k, n, p: float):
    """P(X >= k) of columns k of n, 0 < p < 1: the first term from its logarithm, the others each from the one before."""
    from pyspark.sql import functions as F

    first, last = k.cast("int"), n.cast("int")
    ones = F.when(first > 0, F.sequence(F.lit(1), first)).otherwise(F.array().cast("array<int>"))
    log_first = F.aggregate(ones, F.lit(0.0), lambda s, i: s + F.log((last - first + i) / i)) + k * math.log(p) + (n - k) * math.log1p(-p)
    rest = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(log_first.cast("double").alias("term"), F.exp(log_first).alias("sum"))

    def add(acc, i):
        term = acc["term"] + F.log((last - i) / (i + 1.0)) + (math.log(p) - math.log1p(-p))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.aggregate(rest, start, add, lambda acc: acc["sum"])))


def binomial_p_column(k, n):
    """Two-sided sign-test p of columns k of n: twice the larger side's tail, at most 1; null for no trials."""
    from pyspark.sql import functions as F

    return F.when(n > 0, F.least(F.lit(1.0), 2 * binomial_tail_column(F.greatest(k, n - k), n, 0.5)))


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    if n > 1000:  # by logarithms, where the coefficients are no doubles
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(max(k, 0), n + 1)]
        return min(1.0, math.fsum(map(math.exp, logs)))
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1))


def binomial_p(k: int, n: int, direction: str = "either") -> float:
    """Sign-test p: one-tailed for a direction, two-sided on the larger side for ``either``."""
    if n == 0:
        return math.nan
    if direction == "either":
        return min(1.0, 2 * binomial_tail(max(k, n - k), n))
    return binomial_tail(k if direction == "positive" else n - k, n)


def sign_permutation_p(values: list[float], most: int = 16_384, draws: int = 10_000, seed: int = 42) -> float:
    """Two-sided p of the mean of per-stratum values under flips of their signs: exact up to ``most`` flips, else seeded draws."""
    import numpy as np

    x = np.asarray([v for v in values if not math.isnan(v)], float)
    k = len(x)
    if not k:
        return math.nan
    if 2**k <= most:
        signs = 1 - 2 * ((np.arange(2**k)[:, None] >> np.arange(k)) & 1)
        return float((np.abs(signs @ x) >= abs(x.sum()) - 1e-12).mean())
    signs = np.random.default_rng(seed).choice([-1, 1], (draws, k))
    return float((1 + (np.abs(signs @ x) >= abs(x.sum()) - 1e-12).sum()) / (draws + 1))

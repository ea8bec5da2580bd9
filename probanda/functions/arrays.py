"""Reductions of array columns, as expressions that stay in the JVM. Windows are fractions of the array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, number


def _nan() -> Column:
    return F.lit(None).cast("double")


def series(key: str) -> Column:
    return col(key).cast("array<double>")


def window(x: Column, lo: float, hi: float) -> Column:
    """x[int(lo n) : int(hi n)], one element at least; null for null or empty arrays."""
    n = F.size(x)
    low, high = F.floor(n * F.lit(float(lo))).cast("int"), F.floor(n * F.lit(float(hi))).cast("int")
    return F.when(n > 0, F.slice(x, low + 1, F.greatest(high - low, F.lit(1))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.try_divide(total(x), F.size(x).cast("double")))


def std(x: Column) -> Column:
    """Population standard deviation."""
    m = mean(x)
    return F.when(F.size(x) > 0, F.sqrt(F.try_divide(total(F.transform(x, lambda v: (v - m) * (v - m))), F.size(x).cast("double"))))


def mean_window(x: Column, lo: float, hi: float) -> Column:
    return mean(window(x, lo, hi))


def growth_window(x: Column) -> Column:
    """Last quarter's mean over the size of the first quarter's."""
    return mean_window(x, 0.75, 1.0) / F.greatest(F.abs(mean_window(x, 0.0, 0.25)), F.lit(1e-9))


def late_half(x: Column) -> Column:
    """x[n // 2:], null under two elements."""
    n = F.size(x)
    return F.when(n >= 2, F.slice(x, F.floor(n / 2).cast("int") + 1, n - F.floor(n / 2).cast("int")))


def late_mean(x: Column, fraction: float = 0.1) -> Column:
    n = F.size(x)
    k = F.greatest(F.floor(n * F.lit(fraction)).cast("int"), F.lit(1))
    return F.when(n > 0, mean(F.slice(x, n - k + 1, k)))


def masked_mean(x: Column, mask: Column) -> Column:
    kept = F.filter(F.zip_with(x, mask, lambda v, m: F.when(m > 0.5, v)), lambda v: v.isNotNull())
    return mean(kept)


def max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def select_at(values: Column, indicator: Column, op: str = "max") -> Column:
    """The value at the indicator's first extreme among its finite elements."""
    clean = F.transform(indicator, number)
    at = F.array_position(clean, F.array_max(clean) if op == "max" else F.array_min(clean))
    return F.when(at > 0, F.try_element_at(values, at.cast("int")))


def peak_window(x: Column, peak: Column, half: float) -> Column:
    """Mean around a peak index; null under two elements."""
    n = F.size(x)
    h = F.greatest(F.lit(1), F.floor(n * F.lit(half)).cast("int"))
    low, high = F.greatest(F.lit(0), peak - h), F.least(n, peak + h)
    return F.when((n > 0) & (high - low >= 2), mean(F.slice(x, low + 1, F.greatest(high - low, F.lit(0)))))


def reduce_axis(x: Column, op: str) -> Column:
    """Along the last axis of an array of arrays."""
    ops = {"mean": mean, "sum": total, "max": F.array_max, "min": F.array_min, "std": std, "var": lambda b: F.pow(std(b), 2)}
    return F.transform(x, ops[op])


def log_safe(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def cv_safe(x: Column) -> Column:
    return F.try_divide(std(x), F.abs(mean(x)))


def auc(x: Column) -> Column:
    """Trapezoid area over the index, divided by n - 1."""
    n = F.size(x)
    return F.when(n >= 2, F.try_divide(total(x) - (F.element_at(x, 1) + F.element_at(x, -1)) / 2, (n - 1).cast("double")))


def time_to(x: Column, fraction: float = 0.5) -> Column:
    """First index at ``fraction`` of the peak, as a share of n - 1; null without a positive peak."""
    peak, n = F.array_max(x), F.size(x)
    first = F.array_position(F.transform(x, lambda v: v >= peak * fraction), True) - 1
    return F.when((n >= 2) & (peak > 0), F.try_divide(first.cast("double"), (n - 1).cast("double")))


def slope(x: Column) -> Column:
    """Least-squares slope on the index."""
    n = F.size(x)
    mid, m = (n - 1) / F.lit(2.0), mean(x)
    up = total(F.transform(x, lambda v, i: (i - mid) * (v - m)))
    return F.when(n >= 2, F.try_divide(up, (n * (n * n - 1)) / F.lit(12.0)))


def plateau_slope(x: Column) -> Column:
    return F.when(F.size(x) >= 4, slope(window(x, 0.75, 1.0)))


def autocorrelation(x: Column, lag: int) -> Column:
    """Pearson correlation of the array with itself ``lag`` later; null where either side is constant or has under two elements."""
    n = F.size(x) - lag
    a, b = F.slice(x, 1, F.greatest(n, F.lit(0))), F.slice(x, lag + 1, F.greatest(n, F.lit(0)))
    ma, mb = mean(a), mean(b)
    cov = total(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)))
    return F.when(n >= 2, F.try_divide(cov, n * std(a) * std(b)))


def entropy(x: Column) -> Column:
    """Plug-in entropy in nats of the values of an array."""
    n = F.size(x)
    parts = F.transform(F.array_distinct(x), lambda v: F.try_divide(F.size(F.filter(x, lambda u: u == v)).cast("double"), n.cast("double")))
    return F.when(n > 0, -total(F.transform(parts, lambda p: p * F.ln(p))))


def distinct(x: Column) -> Column:
    return F.size(F.array_distinct(x))


def repeat_rate(x: Column, trailing: int) -> Column:
    """Share of elements that are among the ``trailing`` ones before; null where n <= trailing + 1."""
    n = F.size(x)
    met = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_contains(F.slice(x, F.greatest(i - trailing, F.lit(0)) + 1, F.least(i, F.lit(trailing))), F.get(x, i)))
    return F.when(n > trailing + 1, F.try_divide(F.size(met).cast("double"), n.cast("double")))


def by_burst(x: Column, bursts: int | Column, op=mean) -> Column:
    """The array cut at floor(n i / bursts) and each part reduced."""
    n = F.size(x)
    k = F.lit(bursts) if isinstance(bursts, int) else bursts
    edge = lambda i: F.floor(F.try_divide(n * i.cast("double"), k.cast("double"))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: op(F.slice(x, F.coalesce(edge(i), F.lit(0)) + 1, F.coalesce(F.greatest(edge(i + 1) - edge(i), F.lit(0)), F.lit(0)))))
    return F.when(k > 0, parts)


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))

"""Paired contrasts: arms meet on their pair keys by one aggregation per key, not by a self-join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import effects, special
from ..functions.columns import col, finite, number


class DuplicatePairs(ValueError):
    """More than one cell of an arm has the same pair key."""


def pairs(cells: DataFrame, source: str, pair_by: list[str], by: list[str] | None = None, arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", dedupe: str = "mean") -> DataFrame:
    """(by, pair_by, t, b, delta) of keys that both arms have; several cells of a key count as their mean, or raise."""
    keys = list(dict.fromkeys([*(by or []), *pair_by]))
    rows = cells.where(col(arm).isin(treatment, baseline) & finite(source))
    side = lambda name: F.when(col(arm) == name, number(source))
    met = rows.groupBy(*[col(k) for k in keys]).agg(F.avg(side(treatment)).alias("t"), F.avg(side(baseline)).alias("b"), F.greatest(F.count(side(treatment)), F.count(side(baseline))).alias("_most"))
    if dedupe == "raise":
        twice = met.where("_most > 1").limit(3).collect()
        if twice:
            raise DuplicatePairs(f"several cells of one arm share a pair key, such as {[tuple(r[k] for k in keys) for r in twice]}")
    return met.where("t is not null and b is not null").drop("_most").withColumn("delta", F.col("t") - F.col("b"))


def paired_g(deltas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_pairs, mean_diff, its error, sd, g, g_se and helped (share of positive differences) of each group of ``pairs``."""
    d = F.col("delta")
    out = deltas.groupBy(*[col(b) for b in by or []]).agg(F.count(d).alias("n_pairs"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), F.avg((d > 0).cast("double")).alias("helped"))
    n, sd = F.col("n_pairs"), F.col("sd")
    out = out.withColumn("mean_diff_se", F.try_divide(sd, F.sqrt(n.cast("double")))).withColumn("g", effects.hedges_g(F.col("mean_diff"), sd, n))
    return out.withColumn("g_se", effects.hedges_se(F.col("g"), sd, n))


def cliff_delta(deltas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(positive - negative) / n and its error."""
    d = F.col("delta")
    out = deltas.groupBy(*[col(b) for b in by or []]).agg(F.count(d).alias("n_pairs"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"))
    out = out.withColumn("cliff", F.try_divide((F.col("up") - F.col("down")).cast("double"), F.col("n_pairs").cast("double")))
    return out.withColumn("cliff_se", F.when(F.col("n_pairs") >= 2, F.sqrt((1 - F.col("cliff") * F.col("cliff")) / (F.col("n_pairs") - 1))))


def welch(cells: DataFrame, source: str, by: list[str] | None = None, arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline") -> DataFrame:
    """Welch's t, its error and Satterthwaite degrees of freedom, with Cohen's d."""
    side = lambda name: F.when(col(arm) == name, number(source))
    parts = [f(side(name)).alias(f"{kind}_{s}") for s, name in (("t", treatment), ("b", baseline)) for kind, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    out = cells.groupBy(*[col(b) for b in by or []]).agg(*parts)
    a, b = F.try_divide(F.col("var_t"), F.col("n_t").cast("double")), F.try_divide(F.col("var_b"), F.col("n_b").cast("double"))
    out = out.withColumn("diff", F.col("mean_t") - F.col("mean_b")).withColumn("se", F.sqrt(a + b))
    out = out.withColumn("df", F.try_divide(F.pow(a + b, 2), F.try_divide(a * a, (F.col("n_t") - 1).cast("double")) + F.try_divide(b * b, (F.col("n_b") - 1).cast("double"))))
    return out.withColumn("t", F.try_divide("diff", "se")).withColumn("d", effects.cohen_d(F.col("mean_t"), F.col("mean_b"), F.sqrt("var_t"), F.sqrt("var_b")))


def factorial(cells: DataFrame, source: str, pair_by: list[str], arms: tuple[str, str, str, str], by: list[str], arm: str = "arm_key") -> DataFrame:
    """2 x 2 contrasts of arms (none, first, second, both) per group: four simple g's and the interaction's, on keys that all four have."""
    side = lambda name: F.avg(F.when(col(arm) == name, number(source)))
    met = cells.where(col(arm).isin(*arms)).groupBy(*[col(k) for k in dict.fromkeys([*by, *pair_by])]).agg(*[side(a).alias(x) for a, x in zip(arms, "abcd", strict=True)]).where("a is not null and b is not null and c is not null and d is not null")
    contrasts = {"first": "b - a", "second": "c - a", "first_given_second": "d - c", "second_given_first": "d - b", "interaction": "(d - c) - (b - a)"}
    long = met.select(*by, F.explode(F.create_map(*[x for k, e in contrasts.items() for x in (F.lit(k), F.expr(e))])).alias("contrast", "delta"))
    return paired_g(long, [*by, "contrast"])


def directional(row, predicted: str, alpha: float = 0.05, sesoi: float = 0.5) -> dict:
    """One-sided t, standardised difference, its noncentral-t interval and equivalence p's, from a row of ``paired_g``."""
    n, sd, mean = row["n_pairs"], row["sd"], row["mean_diff"]
    if n < 2 or not sd:
        return {"n": n, "verdict": "power_insufficient"}
    sign = 1 if predicted == "positive" else -1
    dz, df, root = mean / sd, n - 1, n**0.5
    t = dz * root
    solve = lambda p: special._root(lambda shift: p - special.nct_cdf(t, df, shift), t - 40, t + 40)
    return {"n": n, "dz": dz, "t": t, "p": 1 - special.t_cdf(sign * t, df), "dz_low": solve(1 - alpha / 2) / root, "dz_high": solve(alpha / 2) / root, "p_above": 1 - special.nct_cdf(t, df, -sesoi * root), "p_below": special.nct_cdf(t, df, sesoi * root)}


def bootstrap_g(deltas: DataFrame, replicates: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(low, high, kept): percentile interval of g by a Poisson bootstrap; each task weighs its own pairs and sends three sums per
    replicate, so neither the pairs nor the replicates meet in one place."""

    def run(batches):
        sums = np.zeros((3, replicates))
        for pdf in batches:
            if len(pdf):
                d = pdf["delta"].to_numpy()
                key = pd.util.hash_pandas_object(pdf, index=False).to_numpy()
                for h, x in zip(key, d, strict=True):
                    w = np.random.default_rng([seed, int(h)]).poisson(1.0, replicates)
                    sums += w * np.array([[1.0], [x], [x * x]])
        yield pd.DataFrame({"replicate": np.arange(replicates), "n": sums[0], "s": sums[1], "q": sums[2]})

    each = deltas.mapInPandas(run, "replicate int, n double, s double, q double").groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = F.col("n")
    mean, var = F.try_divide("s", "n"), F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), n), n - 1)
    g = F.when((n >= 2) & (var > 0), mean / F.sqrt(var) * (1 - 3 / (4 * n - 5)))
    return each.select(g.alias("g")).where("g is not null").agg(F.percentile("g", alpha / 2).alias("low"), F.percentile("g", 1 - alpha / 2).alias("high"), F.count("g").alias("kept"))


def shape_flags(deltas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flags where differences are skewed (bias-corrected |G1| > 1) or heavy-tailed (G2 > 5); from four pairs on."""
    d = F.col("delta")
    out = deltas.groupBy(*[col(b) for b in by or []]).agg(F.count(d).cast("double").alias("n"), F.skewness(d).alias("g1"), F.kurtosis(d).alias("g2"))
    n = F.col("n")
    big1 = F.when(n >= 4, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    big2 = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.withColumn("skewed", F.coalesce(F.abs(big1) > 1, F.lit(False))).withColumn("heavy", F.coalesce(big2 > 5, F.lit(False)))


def mcnemar(rows: DataFrame, first: str, second: str) -> dict:
    """One-sided exact p and continuity-corrected z of two boolean columns."""
    r = rows.agg(F.count_if(col(first) & ~col(second)).alias("b"), F.count_if(~col(first) & col(second)).alias("c")).first()
    b, c = r["b"], r["c"]
    return {"b": b, "c": c, "p": special.binomial_tail(b, b + c) if b + c else float("nan"), "z": max(abs(b - c) - 1, 0) / (b + c) ** 0.5 * (1 if b >= c else -1) if b + c else float("nan")}

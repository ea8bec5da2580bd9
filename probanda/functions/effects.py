"""Effect sizes, pooling and verdicts as column expressions over aggregated frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import special
from .columns import col


def _null() -> Column:
    return F.lit(None).cast("double")


def hedges_g(mean: Column, sd: Column, n: Column) -> Column:
    """Paired g with the small-sample factor 1 - 3 / (4 n - 5); null under two pairs, 0 where all differences are equal."""
    return F.when(n < 2, _null()).when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(mean, sd) * (1 - 3.0 / (4 * n - 5)))


def hedges_se(g: Column, sd: Column, n: Column) -> Column:
    return F.when((n < 2) | (sd == 0), _null()).otherwise(F.sqrt(1.0 / n + g * g / (2.0 * n)))


def cohen_d(mean_t: Column, mean_b: Column, sd_t: Column, sd_b: Column) -> Column:
    return F.try_divide(mean_t - mean_b, F.sqrt((sd_t * sd_t + sd_b * sd_b) / 2))


def cohen_se(d: Column, n_t: Column, n_b: Column) -> Column:
    return F.sqrt(F.try_divide((n_t + n_b).cast("double"), (n_t * n_b).cast("double")) + F.try_divide(d * d, 2.0 * (n_t + n_b - 2)))


def paired_verdict(g: Column, n: Column, predicted: str | None, mde: dict[int, float]) -> Column:
    """Under-powered, held, no effect or flipped sign; ``mde`` maps numbers of pairs to the least effect found."""
    least = F.create_map([F.lit(x) for kv in mde.items() for x in kv])[n.cast("int")] if mde else _null()
    sign = {"positive": 1, "negative": -1}.get(predicted or "")
    powered = F.coalesce(F.abs(g) >= least, F.lit(False))
    if sign is None:
        return F.when(powered, "held").otherwise("power_insufficient")
    return F.when(~powered, "power_insufficient").when(g * sign > 0, "held").otherwise("sign_flip")


def dl_pool(effects: DataFrame, effect: str, se: str, by: list[str] | None = None) -> DataFrame:
    """DerSimonian-Laird pooling per group: k, fixed, q, tau2, pooled, pooled_se, i2. Rows with a null effect or se <= 0 don't count.

    Q is summed around the fixed mean in a second pass, which keeps its digits.
    """
    keys = [col(b) for b in by or []]
    rows = effects.select(*keys, col(effect).alias("_y"), col(se).alias("_s")).where("_y is not null and _s > 0").withColumn("_w", 1 / (F.col("_s") * F.col("_s")))
    fixed = rows.groupBy(*keys).agg(F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_w")).alias("sw2"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("fixed"), F.count(F.lit(1)).alias("k"))
    joined = rows.join(fixed, by) if by else rows.join(F.broadcast(fixed))
    q = joined.groupBy(*keys, "k", "sw", "sw2", "fixed").agg(F.sum(F.col("_w") * F.pow(F.col("_y") - F.col("fixed"), 2)).alias("q"))
    c = F.col("sw") - F.try_divide(F.col("sw2"), F.col("sw"))
    tau2 = q.withColumn("tau2", F.when(F.col("k") >= 2, F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k") - 1), c))))
    again = joined.join(tau2.select(*keys, "q", "tau2"), by) if by else joined.join(F.broadcast(tau2.select("q", "tau2")))
    weight = 1 / (F.col("_s") * F.col("_s") + F.col("tau2"))
    out = again.groupBy(*keys, "k", "fixed", "q", "tau2").agg((F.sum(weight * F.col("_y")) / F.sum(weight)).alias("pooled"), F.sqrt(1 / F.sum(weight)).alias("pooled_se"))
    i2 = F.when(F.col("k") >= 2, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("q")), F.lit(0.0))))
    return out.withColumn("i2", i2)


def pool_flags(k: Column, tau2: Column) -> Column:
    """What makes a DerSimonian-Laird pool unreliable, as an array: fewer than 5 strata (small_k), and a heterogeneity above 0 but under 0.02 from
    fewer than 10 (clipped_tau2), which the estimator gives without any."""
    small = F.when(k < 5, F.lit("small_k"))
    clipped = F.when((tau2 > 0) & (tau2 < 0.02) & (k < 10), F.lit("clipped_tau2"))
    return F.array_compact(F.array(small, clipped))


def prediction_interval(pooled: float, se: float, tau2: float, k: int, alpha: float = 0.05) -> tuple[float, float]:
    """Interval for the effect of a new stratum, t(k - 2); NaN under three."""
    if k < 3:
        return math.nan, math.nan
    half = special.t_quantile(1 - alpha / 2, k - 2) * math.sqrt(tau2 + se * se)
    return pooled - half, pooled + half


def random_effects_verdict(pool, predicted: str | None) -> str:
    """Verdict of a pooled row (k, pooled, pooled_se, tau2, i2)."""
    if pool is None or pool["k"] < 3 or pool["pooled"] is None:
        return "power_insufficient"
    low, high = prediction_interval(pool["pooled"], pool["pooled_se"], pool["tau2"], pool["k"])
    if low <= 0 <= high:
        return "no_effect"
    if predicted in ("positive", "negative") and (pool["pooled"] > 0) != (predicted == "positive"):
        return "sign_flip"
    return "held_with_scope_flag" if pool["i2"] >= 0.5 else "held"


def fisher_z_pool(rows: DataFrame, rho: str, n: str, offset: int, by: list[str] | None = None) -> DataFrame:
    """Correlations pooled by Fisher's z with weights n - offset: rho, z and n of each group."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), col(rho)))
    w = (col(n) - offset).cast("double")
    held = rows.where(col(rho).isNotNull() & (w > 0))
    mean = F.try_divide(F.sum(w * F.atanh(r)), F.sum(w))
    return held.groupBy(*[col(b) for b in by or []]).agg(F.tanh(mean).alias("rho"), (mean * F.sqrt(F.sum(w))).alias("z"), F.count(F.lit(1)).alias("strata"), F.sum(col(n)).alias("n"))


def null_predict_verdict(stat: Column, band: float, effect: float) -> Column:
    return F.when(F.abs(stat) <= band, "held").when(F.abs(stat) >= effect, "no_effect").otherwise("power_insufficient")


def derived_q(g: float, se: float) -> float:
    return special.normal_cdf(g / se) if se and se > 0 else math.nan


def delta_i(q: Column) -> Column:
    """One minus the binary entropy of q; 0 at and beyond 0 and 1."""
    return F.when((q <= 0) | (q >= 1), F.lit(0.0)).otherwise(1 + q * F.log2(q) + (1 - q) * F.log2(1 - q))

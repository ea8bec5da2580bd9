"""Analyses by burst, the index into a cell's evaluation array; ragged cells give the bursts that they have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import effects, special
from ..functions.columns import col, number
from . import paired, ranks


def exploded(cells: DataFrame, arrays: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep, burst, one column per array): parallel arrays taken apart together, shorter ones with nulls."""
    zipped = F.arrays_zip(*[col(a).alias(n) for n, a in arrays.items()])
    out = cells.select(*[col(k) for k in keep], F.posexplode(zipped).alias("burst", "_x"))
    return out.select(*[col(k) for k in keep], "burst", *[F.col(f"_x.{n}").alias(n) for n in arrays])


def paired_g_per_burst(cells: DataFrame, source: str, env: str, pair_by: list[str], **arms) -> DataFrame:
    """g, its error, pairs and share helped per (env, burst)."""
    long = exploded(cells, {"v": source}, list(dict.fromkeys([env, *pair_by, arms.get("arm", "arm_key")])))
    return paired.paired_g(paired.pairs(long, "v", pair_by, [env, "burst"], **arms), [env, "burst"])


def effects_per_burst(cells: DataFrame, source: str, env: str, arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline") -> DataFrame:
    """Cohen's d of the arms, pooled independently, per (env, burst)."""
    long = exploded(cells, {"v": source}, [env, arm])
    parts = [f(F.when(col(arm) == a, number("v"))).alias(f"{k}_{s}") for s, a in (("t", treatment), ("b", baseline)) for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]
    out = long.groupBy(col(env), "burst").agg(*parts).withColumn("d", effects.cohen_d(F.col("mean_t"), F.col("mean_b"), F.col("sd_t"), F.col("sd_b")))
    return out.withColumn("d_se", effects.cohen_se(F.col("d"), F.col("n_t"), F.col("n_b")))


def link_per_burst(cells: DataFrame, predictor: str, target: str, env: str, pair_by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline") -> DataFrame:
    """Per (env, burst) over pairs: correlation and slope of the target's difference on minus the predictor's; null under three pairs."""
    long = exploded(cells, {"p": predictor, "t": target}, list(dict.fromkeys([env, *pair_by, arm])))
    side = lambda v, a: F.avg(F.when(col(arm) == a, number(v)))
    d = long.groupBy(*[col(k) for k in dict.fromkeys([env, *pair_by])], "burst").agg((side("p", treatment) - side("p", baseline)).alias("dp"), (side("t", treatment) - side("t", baseline)).alias("dt"))
    d = d.where("dp is not null and dt is not null").withColumn("x", -F.col("dp"))
    n = F.count(F.lit(1)).cast("double")
    cov = F.sum(F.col("x") * F.col("dt")) - F.sum("x") * F.sum("dt") / n
    var = F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n
    out = d.groupBy(col(env), "burst").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("dp").alias("mean_d_predictor"), F.avg("dt").alias("mean_d_target"), ranks.correlation("x", "dt").alias("r"), F.when(var > 1e-13 * F.sum(F.col("x") * F.col("x")), cov / var).alias("slope"))
    return out.withColumns({c: F.when(F.col("n_pairs") >= 3, F.col(c)) for c in ("r", "slope")})


def phase_consistency(links: DataFrame, sign: int, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """(by, bursts, significant, share, p): how many of all bursts have a correlation of the expected sign that a two-sided t test finds at ``alpha``, their
    share, and the one-sided p of so many if each were found with probability alpha / 2. Bursts without a correlation count as not found."""
    r, n = F.col("r"), F.col("n_pairs")
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), (1 - r) * (1 + r)))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(special.t_p_column(t, (n - 2).cast("double")))
    rows = links.withColumn("_p", F.when(r.isNotNull(), p))
    found = F.coalesce((F.col("_p") < alpha) & (r * sign > 0), F.lit(False))
    out = rows.groupBy(*[col(b) for b in by or []]).agg(F.count(F.lit(1)).alias("bursts"), F.count_if(found).alias("significant"), F.avg(found.cast("double")).alias("share"))
    return out.withColumn("p", F.when(F.col("bursts") > 0, special.binomial_tail_column(F.col("significant"), F.col("bursts"), alpha / 2)))


def dynamic_partial(cells: DataFrame, mediator: str, outcome: str, env: str, arm: str = "arm_key", treatment: str = "treatment") -> DataFrame:
    """Per (env, burst): rank correlation of the arm with the outcome, and the same given the mediator."""
    long = exploded(cells, {"m": mediator, "o": outcome}, [env, arm]).withColumn("a", (col(arm) == treatment).cast("double"))
    plain = ranks.spearman(long, "a", "o", [env, "burst"]).withColumnRenamed("rho", "marginal")
    return plain.join(ranks.partial_spearman(long, "a", "o", "m", [env, "burst"]).select(env, "burst", F.col("rho").alias("conditional")), [env, "burst"], "left")


def dynamic_partial_multi(cells: DataFrame, mediators: list[str], outcome: str, env: str, arm: str = "arm_key", treatment: str = "treatment") -> DataFrame:
    """Per (env, burst): rank correlation of the arm with the outcome, the same given all mediators, and a status: ok, underpowered
    (n <= 3 + mediators), degenerate (a constant rank)."""
    names = [f"m{k}" for k in range(len(mediators))]
    long = exploded(cells, {**dict(zip(names, mediators, strict=True)), "o": outcome}, [env, arm]).withColumn("a", (col(arm) == treatment).cast("double"))
    plain = ranks.spearman(long, "a", "o", [env, "burst"]).withColumnRenamed("rho", "marginal")
    given = ranks.partial_spearman_multi(long, "a", "o", names, [env, "burst"]).select(env, "burst", F.col("rho").alias("conditional"))
    status = F.when(F.col("n") <= 3 + len(names), "underpowered").when(F.col("marginal").isNull() | F.col("conditional").isNull(), "degenerate").otherwise("ok")
    return plain.join(given, [env, "burst"], "left").withColumn("status", status)


def fisher_z_dl_pool(rows: DataFrame, rho: str, n: str, offset: int, by: list[str] | None = None) -> DataFrame:
    """Correlations pooled by DerSimonian-Laird on Fisher's z with errors 1 / sqrt(n - offset); rho is the pooled one's tanh."""
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), col(rho))))
    held = rows.where(col(rho).isNotNull() & (col(n) > offset)).withColumns({"_z": z, "_z_se": 1 / F.sqrt((col(n) - offset).cast("double"))})
    return effects.dl_pool(held, "_z", "_z_se", by).withColumn("rho", F.tanh("pooled"))

"""Weighted least squares from sums: products are added up in Spark, small systems are solved at the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.columns import col, cut, number, with_aggregates
from . import bursts, paired, ranks, strata


@dataclass(frozen=True)
class Fit:
    names: tuple[str, ...]
    coefficients: np.ndarray
    errors: np.ndarray
    p_values: np.ndarray
    n: int
    tau2: float
    r2: float


def centres(rows: DataFrame, y: str, xs: list[str]) -> np.ndarray:
    """Means of y and of each x, 0 where there are none: what sums are taken around, so that large means cost no digits."""
    r = rows.agg(*[F.avg(number(v)).alias(f"c{k}") for k, v in enumerate([y, *xs])]).first()
    return np.array([v if v is not None else 0.0 for v in r], float)


def normal_sums(rows: DataFrame, y: str, xs: list[str], weight=None, around: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, float, int, float]:
    """(X'WX, X'Wy, y'Wy, sum of w, n, sum of w y) with an intercept first, of values less ``around`` (y, then each x); rows with a
    non-finite value don't count."""
    w = F.lit(1.0) if weight is None else weight
    around = np.zeros(1 + len(xs)) if around is None else around
    target = number(y) - F.lit(float(around[0]))
    cols = [F.lit(1.0), *[number(x) - F.lit(float(c)) for x, c in zip(xs, around[1:], strict=True)]]
    kept = rows.where(number(y).isNotNull())
    for x in xs:
        kept = kept.where(number(x).isNotNull())
    k = len(cols)
    parts = [F.sum(w * cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * cols[i] * target).alias(f"y{i}") for i in range(k)]
    r = kept.agg(*parts, F.sum(w * target * target).alias("yy"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = r[f"x{i}_{j}"] or 0.0
    b = np.array([r[f"y{i}"] or 0.0 for i in range(k)])
    return a, b, r["yy"] or 0.0, r["w"] or 0.0, r["n"], b[0]


def _independent(a: np.ndarray) -> bool:
    """Whether a matrix of sums of products has full rank, whatever the scales of its columns."""
    size = np.sqrt(np.maximum(np.diag(a), 0))
    return bool((size > 0).all() and np.linalg.matrix_rank(a / np.outer(size, size)) == len(a))


def ols(rows: DataFrame, y: str, xs: list[str], weight=None) -> Fit:
    """Least squares with t tests; ValueError where rows don't exceed parameters or columns are collinear."""
    around = centres(rows, y, xs)
    a, b, yy, w, n, wy = normal_sums(rows, y, xs, weight, around)
    p = len(b)
    if n <= p:
        raise ValueError(f"{n} rows for {p} parameters")
    if not _independent(a):
        raise ValueError("the covariates are collinear")
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rss = max(yy - beta @ b, 0.0)
    # back from the centres: only the intercept moves
    back = np.eye(p)
    back[0, 1:] = -around[1:]
    beta = back @ beta
    beta[0] += around[0]
    errors = np.sqrt(np.maximum(rss / (n - p) * np.diag(back @ inverse @ back.T), 0))
    total = yy - wy * wy / w
    t = [2 * (1 - special.t_cdf(abs(v / e), n - p)) if e > 0 else math.nan for v, e in zip(beta, errors, strict=True)]
    return Fit(("intercept", *xs), beta, errors, np.array(t), n, 0.0, 1 - rss / total if total > 0 else math.nan)


def meta_regression(rows: DataFrame, effect: str, se: str, covariates: list[str]) -> Fit:
    """Random-effects meta-regression: weights 1 / (se^2 + tau^2), tau^2 by the moment estimator in matrix form.

    A missing covariate counts as 0. ValueError for no rows, too few, or se <= 0.
    """
    # a few numbers an effect, read by each of the jobs below: what they come from runs once
    rows = cut(rows.select(col(effect), col(se), *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in covariates]))
    bad = rows.where(number(se).isNull() | (number(se) <= 0)).limit(1).count()
    if bad:
        raise ValueError("standard errors must be positive")
    w = 1 / (number(se) * number(se))
    around = centres(rows, effect, covariates)
    a, b, yy, sw, n, _ = normal_sums(rows, effect, covariates, w, around)
    p = len(b)
    if n <= p:
        raise ValueError(f"{n} rows for {p} parameters")
    if not _independent(a):
        raise ValueError("the covariates are collinear")
    a2 = normal_sums(rows, effect, covariates, w * w, around)[0]
    inverse = np.linalg.inv(a)
    q = yy - b @ inverse @ b
    c = sw - np.trace(inverse @ a2)
    tau2 = max(0.0, float((q - (n - p)) / c)) if c > 0 else 0.0
    fit = ols(rows, effect, covariates, 1 / (number(se) * number(se) + F.lit(float(tau2))))
    return Fit(fit.names, fit.coefficients, fit.errors, fit.p_values, fit.n, tau2, fit.r2)


def cross_validate(rows: DataFrame, effect: str, se: str, covariates: list[str], folds: int = 5, seed: int = 0) -> dict[str, dict[str, float]]:
    """Per coefficient its mean, deviation and share of equal signs over fits that each leave out one hashed fold."""
    rows = cut(rows.select(*[col(c) for c in dict.fromkeys([effect, se, *covariates])]))
    fold = F.pmod(F.xxhash64(number(effect), number(se), F.lit(seed)), F.lit(folds))
    fits = [meta_regression(rows.where(fold != k), effect, se, covariates) for k in range(folds)]
    beta = np.stack([f.coefficients for f in fits])
    share = np.maximum((beta > 0).mean(0), (beta < 0).mean(0))
    return {n: {"mean": float(m), "sd": float(s), "same_sign": float(h)} for n, m, s, h in zip(fits[0].names, beta.mean(0), beta.std(0, ddof=1), share, strict=True)}


def mundlak(rows: DataFrame, stratum: str, x: str, y: str, se: str, cluster: bool = True) -> dict:
    """y on the stratum mean of x (between) and the deviation from it (within), weights 1 / se^2; Hausman t and p of their difference."""
    kept = rows.where(number(x).isNotNull() & number(y).isNotNull() & (number(se) > 0))
    kept = with_aggregates(kept, [stratum], _between=F.avg(number(x))).withColumn("_within", number(x) - F.col("_between"))
    kept = cut(kept.select(*[col(c) for c in dict.fromkeys([stratum, y, se])], "_between", "_within"))
    w, around = 1 / (number(se) * number(se)), centres(kept, y, ["_between", "_within"])
    a, b, yy, _, n, _ = normal_sums(kept, y, ["_between", "_within"], w, around)
    if n < 4 or np.linalg.matrix_rank(a) < 3:
        raise ValueError("too few rows or strata")
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    cov = inverse * (yy - beta @ b) / (n - 3)
    if cluster:
        between, within = F.col("_between") - F.lit(float(around[1])), F.col("_within") - F.lit(float(around[2]))
        r = number(y) - F.lit(float(around[0])) - (beta[0] + beta[1] * between + beta[2] * within)
        scores = kept.groupBy(col(stratum)).agg(*[F.sum(w * r * c).alias(f"s{k}") for k, c in enumerate((F.lit(1.0), between, within))])
        m = scores.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}{j}") for i in range(3) for j in range(3)]).first()
        g = m["g"]
        meat = np.array([[m[f"m{i}{j}"] for j in range(3)] for i in range(3)])
        if g > 1:
            cov = inverse @ meat @ inverse * g / (g - 1) * (n - 1) / (n - 3)
    var = cov[1, 1] + cov[2, 2] - 2 * cov[1, 2]
    t = (beta[1] - beta[2]) / math.sqrt(var) if var > 0 else math.nan
    return {"n": n, "between": float(beta[1]), "within": float(beta[2]), "hausman_t": float(t), "hausman_p": float(2 * (1 - special.t_cdf(abs(t), n - 3))) if not math.isnan(t) else math.nan}


def mediation(rows: DataFrame, treatment: str, mediators: list[str], outcome: str) -> dict[str, float]:
    """Total effect, direct effect given the mediators, the indirect rest and its share."""
    total = ols(rows, outcome, [treatment]).coefficients[1]
    direct = ols(rows, outcome, [treatment, *mediators]).coefficients[1]
    return {"total": float(total), "direct": float(direct), "indirect": float(total - direct), "share": float((total - direct) / total) if abs(total) > 1e-8 else math.nan}


def separated(edges: set[tuple[str, str]], x: str, y: str, given: frozenset[str]) -> bool:
    """Whether ``given`` d-separates x from y in a small graph of directed edges."""
    up: dict[str, set[str]] = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    old, ancestors = {x, y, *given}, set()
    while old:
        v = old.pop()
        ancestors.add(v)
        old |= up.get(v, set()) - ancestors
    near: dict[str, set[str]] = {v: set() for v in ancestors}
    for b in ancestors:
        parents = sorted(up.get(b, set()) & ancestors)
        for a in parents:
            near[a].add(b)
            near[b].add(a)
        for a in parents:  # parents of a common child are joined
            near[a] |= set(parents) - {a}
    front, seen = {x}, {x}
    while front:
        front = {w for v in front for w in near[v]} - seen - given
        seen |= front
    return y not in seen


def backdoor_set(edges: set[tuple[str, str]], treatment: str, outcome: str, observed: list[str]) -> list[str] | None:
    """A smallest set of observed non-descendants that closes every back door, or None."""
    from itertools import combinations

    down, new = {treatment}, {treatment}
    while new:
        new = {b for a, b in edges if a in new} - down
        down |= new
    cut = {(a, b) for a, b in edges if a != treatment}
    free = [v for v in observed if v not in down and v != outcome]
    for k in range(len(free) + 1):
        for given in combinations(free, k):
            if separated(cut, treatment, outcome, frozenset(given)):
                return list(given)
    return None


def backdoor_ate(rows: DataFrame, edges: set[tuple[str, str]], treatment: str, outcome: str, observed: list[str]) -> dict:
    """Average effect by regression on the treatment and a backdoor set of the authored graph."""
    given = backdoor_set(edges, treatment, outcome, observed)
    if given is None:
        return {"identified": False}
    fit = ols(rows, outcome, [treatment, *given])
    return {"identified": True, "adjusted_for": given, "ate": float(fit.coefficients[1]), "se": float(fit.errors[1]), "n": fit.n}


def refute_placebo(rows: DataFrame, treatment: str, outcome: str, given: list[str], seed: int = 0) -> float:
    """The effect left when the treatment is replaced by seeded noise."""
    noise = F.pmod(F.xxhash64(*[col(c) for c in rows.columns], F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    return float(ols(rows.withColumn("_placebo", noise), outcome, ["_placebo", *given]).coefficients[1])


def refute_common_cause(rows: DataFrame, treatment: str, outcome: str, given: list[str], seed: int = 0) -> float:
    """How far the effect moves when a seeded random cause is added."""
    noise = F.pmod(F.xxhash64(*[col(c) for c in rows.columns], F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    plain = ols(rows, outcome, [treatment, *given]).coefficients[1]
    return float(ols(rows.withColumn("_cause", noise), outcome, [treatment, *given, "_cause"]).coefficients[1] - plain)


def moderation(rows: DataFrame, predictor: str, target: str, attenuator: str, threshold: float, env: str) -> dict:
    """Whether the slope of target on predictor differs where the attenuator exceeds a threshold: OLS with the interaction and one
    indicator per environment but the first. ValueError where the columns are collinear."""
    kept = rows.where(number(predictor).isNotNull() & number(target).isNotNull() & number(attenuator).isNotNull())
    envs = sorted((r[0] for r in kept.select(col(env)).distinct().limit(501).collect()), key=repr)
    if len(envs) > 500:
        raise ValueError("over 500 environments")
    high = (number(attenuator) > threshold).cast("double")
    kept = kept.withColumns({"_high": high, "_both": high * number(predictor), **{f"_env{k}": (col(env) == e).cast("double") for k, e in enumerate(envs) if k}})
    fit = ols(kept, target, [predictor, "_high", "_both", *[f"_env{k}" for k in range(1, len(envs))]])
    return {"slope": float(fit.coefficients[1]), "interaction": float(fit.coefficients[3]), "se": float(fit.errors[3]), "p": float(fit.p_values[3]), "n": fit.n}


def tautology_audit(cells: DataFrame, reads: dict[str, set[str]], mediator: str, outcome: str, hyperparameters: list[str], by: list[str] | None = None) -> dict:
    """How far a mediator restates the outcome or the configuration: overlap of what both read, R^2 on each hyperparameter, and, with
    strata, the rank correlation of mediator and outcome pooled over them."""
    a, b = reads.get(mediator, set()), reads.get(outcome, set())
    shared = len(a & b) / len(a | b) if a | b else 0.0
    out = {"reads_jaccard": shared, "r2": {h: float(ols(cells, mediator, [h]).r2) for h in hyperparameters}}
    if by:
        row = ranks.stratified_spearman(cells, mediator, outcome, by).first()
        out["rho"] = row["rho"] if row else None
    return out


def meta_regression_paired_g(cells: DataFrame, source: str, env: str, pair_by: list[str], covariates: list[str], **arms) -> Fit:
    """Paired g per env on the env means of covariates of the cells, random effects."""
    g = paired.paired_g(paired.pairs(cells, source, pair_by, [env], **arms), [env]).where("g_se > 0")
    means = cells.groupBy(col(env)).agg(*[F.avg(number(c)).alias(c) for c in covariates])
    return meta_regression(g.join(means, env), "g", "g_se", covariates)


def meta_regression_per_burst(cells: DataFrame, source: str, env: str, pair_by: list[str], covariates: list[str], **arms) -> Fit:
    """Paired g per (env, burst) on the burst's number and env means of covariates, random effects."""
    g = bursts.paired_g_per_burst(cells, source, env, pair_by, **arms).where("g_se > 0").withColumn("burst", F.col("burst").cast("double"))
    if covariates:
        g = g.join(cells.groupBy(col(env)).agg(*[F.avg(number(c)).alias(c) for c in covariates]), env)
    return meta_regression(g, "g", "g_se", ["burst", *covariates])


def meta_regression_unpaired_d(cells: DataFrame, source: str, by: list[str], covariates: list[str], **arms) -> Fit:
    """Cohen's d per stratum on the stratum means of covariates, random effects."""
    panel = strata.stratum_panel(cells, source, by, **arms).where("d_se > 0")
    means = cells.groupBy(*[col(b) for b in by]).agg(*[F.avg(number(c)).alias(c) for c in covariates])
    return meta_regression(panel.join(means, by), "d", "d_se", covariates)


def mundlak_paired_g_per_burst(cells: DataFrame, source: str, predictor: str, env: str, pair_by: list[str], **arms) -> dict:
    """Paired g per (env, burst) on the burst means of a predictor array: between envs and within them."""
    g = bursts.paired_g_per_burst(cells, source, env, pair_by, **arms).where("g_se > 0")
    means = bursts.exploded(cells, {"x": predictor}, [env]).groupBy(col(env), "burst").agg(F.avg(number("x")).alias("x"))
    return mundlak(g.join(means, [env, "burst"]), env, "x", "g", "g_se")


def paired_continuous_do(cells: DataFrame, source: str, swept: str, pair_by: list[str], **arms) -> Fit:
    """Differences of paired arms on a swept setting, which both arms of a pair share: slope of the effect on the setting."""
    found = paired.pairs(cells, source, list(dict.fromkeys([*pair_by, swept])), **arms)
    return ols(found, "delta", [swept])


def stratum_delta_link(cells: DataFrame, predictor: str, target: str, env: str, arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", floor: float | None = None) -> Fit:
    """Differences of arm means per (env, burst): the target's on the predictor's, with one indicator per burst but the first. Cells
    whose two arrays differ in length are left out, bursts end with the shortest cell, and with ``floor`` the baseline's predictor mean
    must exceed it."""
    rows = cells.where(F.size(col(predictor)) == F.size(col(target)))
    shortest = rows.agg(F.min(F.size(col(predictor)))).first()[0] or 0
    long = bursts.exploded(rows, {"p": predictor, "t": target}, [env, arm]).where(F.col("burst") < shortest)
    side = lambda v, a: F.avg(F.when(col(arm) == a, number(v)))
    panel = long.groupBy(col(env), "burst").agg((side("p", treatment) - side("p", baseline)).alias("dp"), (side("t", treatment) - side("t", baseline)).alias("dt"), side("p", baseline).alias("pb"))
    if floor is not None:
        panel = panel.where(F.col("pb") > floor)
    panel = cut(panel).withColumns({f"_burst{k}": (F.col("burst") == k).cast("double") for k in range(1, shortest)})
    return ols(panel, "dt", ["dp", *[f"_burst{k}" for k in range(1, shortest)]])


def stratum_baseline_predictor_link(cells: DataFrame, predictor: str, target: str, env: str, by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline") -> Fit:
    """The target's difference of arms per stratum on the baseline mean of a predictor, with one indicator per env but the first."""
    side = lambda v, a: F.avg(F.when(col(arm) == a, number(v)))
    panel = cells.groupBy(*[col(k) for k in dict.fromkeys([env, *by])]).agg(side(predictor, baseline).alias("pb"), (side(target, treatment) - side(target, baseline)).alias("dt"))
    envs = sorted((r[0] for r in panel.select(col(env)).distinct().limit(501).collect()), key=repr)
    if len(envs) > 500:
        raise ValueError("over 500 environments")
    panel = panel.withColumns({f"_env{k}": (col(env) == e).cast("double") for k, e in enumerate(envs) if k})
    return ols(panel, "dt", ["pb", *[f"_env{k}" for k in range(1, len(envs))]])

"""Rank correlations by stratum, partial ones among them, and their pooling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import effects, special
from ..functions.columns import col, finite, number, running, steady_sums


def ranked(cells: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Rows with all names finite, each replaced by its average rank within the stratum.

    Equal values are counted first; the distinct ones of all columns are range-partitioned together and get prefix sums, so no
    stratum is sorted in one task. Ranks are joined back by value.
    """
    rows = cells
    for n in names:
        rows = rows.where(finite(n))
    keys = [f"_k{k}" for k in range(len(by))]
    rows = rows.select(*[col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[(number(n) + 0.0).alias(f"_v{k}") for k, n in enumerate(names)])
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.col(f"_v{k}").alias("v")) for k in range(len(names))])).alias("_x")
    counts = rows.select(*keys, values).groupBy(*keys, F.col("_x.at").alias("_at"), F.col("_x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    found = running(counts, [*keys, "_at"], "_v", ["_n"]).withColumn("_rank", F.col("_n_before") + (F.col("_n") + 1) / 2.0)
    for k in range(len(names)):
        mine = found.where(F.col("_at") == k).select(*[F.col(b).alias(f"{b}_") for b in keys], F.col("_v").alias(f"_u{k}"), F.col("_rank").alias(f"r{k}"))
        same = F.col(f"_v{k}") == F.col(f"_u{k}")
        for b in keys:
            same &= F.col(b).eqNullSafe(F.col(f"{b}_"))
        rows = rows.join(mine, same).drop(f"_u{k}", *[f"{b}_" for b in keys])
    return rows.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], *[f"r{k}" for k in range(len(names))])


def correlation(x: str, y: str) -> tuple:
    """Pearson correlation from sums; null where a side is constant, but for rounding: whatever its scale."""
    n = F.count(F.lit(1)).cast("double")
    cov = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n, F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    varies = (vx > 1e-13 * F.sum(F.col(x) * F.col(x))) & (vy > 1e-13 * F.sum(F.col(y) * F.col(y)))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(vx * vy)))))


def spearman(cells: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho); null under four rows or where a side is constant."""
    out = ranked(cells, [x, y], by).groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), correlation("r0", "r1").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= 4, F.col("rho")))


def partial_spearman(cells: DataFrame, x: str, y: str, z: str, by: list[str]) -> DataFrame:
    """(by, n, rho): rank correlation of x and y given z; null under five rows."""
    parts = ranked(cells, [x, y, z], by).groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), correlation("r0", "r1").alias("xy"), correlation("r0", "r2").alias("xz"), correlation("r1", "r2").alias("yz"))
    rho = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
    return parts.select(*by, "n", F.when(F.col("n") >= 5, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))


def gram(cells: DataFrame, names: list[str], by: list[str] | None = None, ranks: bool = False) -> DataFrame:
    """(by, n, sums, products): all sums and products of the columns in one aggregation, products row by row of the upper triangle."""
    keys = [col(b) for b in by or []]
    if ranks:
        rows, x = ranked(cells, names, by or []), [F.col(f"r{k}") for k in range(len(names))]
    else:
        rows, x = cells, [number(n) for n in names]
        for n in names:
            rows = rows.where(finite(n))
    products = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"), F.array(*products).alias("products"))


def correlations(row) -> np.ndarray:
    """Correlation matrix from a row of ``gram``; NaN for constant columns."""
    n, s = row["n"], np.array(row["sums"], float)
    m = np.zeros((len(s), len(s)))
    m[np.triu_indices(len(s))] = row["products"]
    cov = np.triu(m) + np.triu(m, 1).T - np.outer(s, s) / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-9] = math.nan
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def partial_from(corr: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """Partial correlation from a correlation matrix: what is left of both sides given the others; NaN where these are collinear or
    leave nothing of a side, but for rounding."""
    at, rest = [i, j], list(given)
    if np.isnan(corr[np.ix_(at + rest, at + rest)]).any():
        return math.nan
    left = corr[np.ix_(at, at)]
    if rest:
        inner, across = corr[np.ix_(rest, rest)], corr[np.ix_(at, rest)]
        if np.linalg.eigvalsh(inner)[0] < 1e-12:
            return math.nan
        left = left - across @ np.linalg.solve(inner, across.T)
    if min(left[0, 0], left[1, 1]) <= 1e-12:
        return math.nan
    return float(np.clip(left[0, 1] / math.sqrt(left[0, 0] * left[1, 1]), -1, 1))


def fisher_p(rho: float, n: float, given: int = 0) -> float:
    """Two-sided p of a (partial) correlation by Fisher's z."""
    if math.isnan(rho) or n <= 3 + given:
        return math.nan
    return special.normal_p(math.atanh(max(-0.999999, min(0.999999, rho))) * math.sqrt(n - 3 - given))


def partial_spearman_multi(cells: DataFrame, x: str, y: str, controls: list[str], by: list[str]) -> DataFrame:
    """(by, n, rho, z, p): rank correlation of x and y given any number of controls, per stratum, from the inverse of the ranks'
    correlations. Products are summed up in one aggregation; the small systems, one per stratum, are solved in tasks. Null under five
    rows or n <= 3 + controls, and where a rank is constant or controls are collinear."""
    sums = gram(cells, [x, y, *controls], by, ranks=True)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*[col(b) for b in by]).schema)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                enough = row["n"] >= 5 and row["n"] > 3 + len(controls)
                out.append(partial_from(correlations(row), 0, 1, tuple(range(2, 2 + len(controls)))) if enough else math.nan)
            rho = np.array(out, float)
            z = np.arctanh(np.clip(rho, -0.999999, 0.999999)) * np.sqrt(np.maximum(pdf["n"].to_numpy(float) - 3 - len(controls), 0))
            p = [special.normal_p(v) if v == v else None for v in z]
            blank = lambda a: [None if v != v else float(v) for v in a]
            yield pdf[[*by, "n"]].assign(rho=pd.Series(blank(rho), dtype=object), z=pd.Series(blank(z), dtype=object), p=pd.Series(p, dtype=object))

    return sums.mapInPandas(solve, f"{kinds}{', ' * bool(by)}n long, rho double, z double, p double")


def stratified_partial_multi(cells: DataFrame, x: str, y: str, controls: list[str], by: list[str]) -> DataFrame:
    """Partial rank correlations of the strata pooled by Fisher's z, offset 3 + controls."""
    return effects.fisher_z_pool(partial_spearman_multi(cells, x, y, controls, by).where("rho is not null"), "rho", "n", 3 + len(controls))


def with_fisher_p(rows: DataFrame, rho: str = "rho", n: str = "n", given: int = 0) -> DataFrame:
    """With z and two-sided p of each correlation by Fisher's transform; null where n is at most 3 + ``given``."""
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), col(rho)))) * F.sqrt((col(n) - 3 - given).cast("double"))
    z = F.when((col(n) > 3 + given) & col(rho).isNotNull(), z)
    return rows.withColumn("z", z).withColumn("p", special.normal_p_column(F.col("z")))


def arm_differences(cells: DataFrame, metrics: list[str], by: list[str], arm: str, treatment: str, baseline: str, least: int) -> DataFrame:
    """(by, difference0, baseline0, difference1, ...): per stratum the difference of the arms' means of each metric and the baseline's mean, from sums
    that don't depend on the order of rows, so that equal strata tie in ranks. Strata with fewer finite values than ``least`` anywhere are left out."""
    sides = {f"{s}{k}": F.when(col(arm) == a, number(m)) for k, m in enumerate(metrics) for s, a in (("t", treatment), ("b", baseline))}
    sums = steady_sums(cells, by, **sides).where(F.least(*[F.col(f"{n}_n") for n in sides]) >= least)
    mean = lambda n: F.try_divide(F.col(n), F.col(f"{n}_n").cast("double"))
    return sums.select(*[col(b) for b in by], *[c for k in range(len(metrics)) for c in ((mean(f"t{k}") - mean(f"b{k}")).alias(f"difference{k}"), mean(f"b{k}").alias(f"baseline{k}"))])


def jci_panel(cells: DataFrame, predictor: str, target: str, env: str, by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", min_cells: int = 3) -> DataFrame:
    """(kind, rho, n): over strata (keys ``by``, env among them) the rank correlation of the arms' differences of two metrics: marginal,
    pooled over environments, and the latter given the target's baseline mean. Strata with a null key, or with fewer cells or finite
    values of either arm than ``min_cells``, are left out."""
    rows = cells.where(col(arm).isin(treatment, baseline))
    for b in by:
        rows = rows.where(col(b).isNotNull())
    found = arm_differences(rows, [predictor, target], by, arm, treatment, baseline, min_cells)
    panel = found.select(*[col(b) for b in by], F.col("difference0").alias("_x"), F.col("difference1").alias("_y"), F.col("baseline1").alias("_z"))
    marginal = spearman(panel, "_x", "_y", []).select(F.lit("marginal").alias("kind"), "rho", "n")
    within = stratified_spearman(panel, "_x", "_y", [env]).select(F.lit("stratified").alias("kind"), "rho", "n")
    given = stratified_spearman(panel, "_x", "_y", [env], "_z").select(F.lit("stratified_partial").alias("kind"), "rho", "n")
    return marginal.unionByName(within).unionByName(given)


def property_slope(strata: DataFrame, effect: str, covariate: str) -> DataFrame:
    """(n, rho, z, p): rank correlation over strata of a covariate with the effect size."""
    return with_fisher_p(spearman(strata, covariate, effect, []))


def stratified_spearman(cells: DataFrame, x: str, y: str, by: list[str], z: str | None = None) -> DataFrame:
    """Per-stratum rank correlations pooled by Fisher's z; offsets 3, or 4 with a control."""
    strata = spearman(cells, x, y, by) if z is None else partial_spearman(cells, x, y, z, by)
    return effects.fisher_z_pool(strata, "rho", "n", 3 if z is None else 4)


def cross_stratum_slope(cells: DataFrame, predictor: str, target: str, by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", confound: str | None = None, min_seeds: int = 3) -> DataFrame:
    """Rank correlation over strata of the arm differences of two metrics, given a third's if asked for: (n, rho)."""
    names = [predictor, target, *([confound] if confound else [])]
    diffs = arm_differences(cells, names, by, arm, treatment, baseline, min_seeds).select(*[F.col(f"difference{k}").alias(f"_d{k}") for k in range(len(names))], F.lit(1).alias("_all"))
    found = spearman(diffs, "_d0", "_d1", ["_all"]) if confound is None else partial_spearman(diffs, "_d0", "_d1", "_d2", ["_all"])
    return found.select("n", "rho")

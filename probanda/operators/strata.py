"""Per-stratum aggregates, diagnostics and panels. Every function takes a frame of cells and returns a lazy frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import effects, special
from ..functions.columns import AGGREGATES, col, finite, number, running, steady_sums, with_aggregates


def per_stratum_aggregate(cells: DataFrame, source: str, by: list[str], op: str, cell_filter: Column | None = None, min_n: int | None = None) -> DataFrame:
    """(by, value, n): mean, std (sample) or median of the finite values of each stratum with at least ``min_n`` of them (std: 2)."""
    rows = cells if cell_filter is None else cells.where(cell_filter)
    least = (2 if op == "std" else 1) if min_n is None else min_n
    out = rows.groupBy(*[col(b) for b in by]).agg(AGGREGATES[op](number(source)).alias("value"), F.count(number(source)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("value").isNotNull())


def per_stratum_aggregates(cells: DataFrame, source: str, by: list[str], ops: list[str]) -> DataFrame:
    """(by, n, one column per aggregate) in one aggregation."""
    return cells.groupBy(*[col(b) for b in by]).agg(*[AGGREGATES[op](number(source)).alias(op) for op in ops], F.count(number(source)).alias("n"))


def diagnostics(cells: DataFrame, by: list[str], metrics: list[str], leaves: list[str], corpus: str | None = None) -> DataFrame:
    """Per stratum: cells, corpora, share of finite values per metric, and number of distinct configurations (null is a value)."""
    found = [F.count(F.lit(1)).alias("n_cells"), *[F.avg(finite(m).cast("double")).alias(f"finite_{m}") for m in metrics]]
    if leaves:
        found.append(F.count_distinct(F.to_json(F.struct(*[F.coalesce(col(x).cast("string"), F.lit("\u0000")).alias(x) for x in leaves]))).alias("n_configs"))
    if corpus:
        found.append(F.sort_array(F.collect_set(col(corpus))).alias("corpora"))
    return cells.groupBy(*[col(b) for b in by]).agg(*found)


def availability(cells: DataFrame, env: str, metrics: list[str]) -> DataFrame:
    """(env, metric, finite share, status): uniform where all are finite, unavailable where none is, else partial."""
    shares = cells.groupBy(col(env).alias("env")).agg(*[F.avg(finite(m).cast("double")).alias(m) for m in metrics])
    long = shares.unpivot(["env"], metrics, "metric", "share")
    return long.withColumn("status", F.when(F.col("share") == 1, "uniform").when(F.col("share") == 0, "unavailable").otherwise("partial"))


def stratum_panel(cells: DataFrame, source: str, by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", min_seeds: int = 3, aggregator: str = "mean") -> DataFrame:
    """Per stratum: cells and finite values of both arms, their centres and spreads, delta, Cohen's d and its error.

    Strata need ``min_seeds`` cells in both arms. One conditional aggregation; what is shuffled is one row per stratum and task.
    """
    aggregate = AGGREGATES[aggregator]
    parts = []
    for side, name in (("t", treatment), ("b", baseline)):
        mine, value = col(arm) == name, F.when(col(arm) == name, number(source))
        parts += [F.count_if(mine).alias(f"n_{side}"), F.count(value).alias(f"finite_{side}"), aggregate(value).alias(f"centre_{side}"), F.avg(value).alias(f"mean_{side}"), F.stddev_samp(value).alias(f"sd_{side}")]
    panel = cells.where(col(arm).isin(treatment, baseline)).groupBy(*[col(b) for b in by]).agg(*parts).where((F.col("n_t") >= min_seeds) & (F.col("n_b") >= min_seeds))
    panel = panel.withColumn("delta", F.col("centre_t") - F.col("centre_b"))
    panel = panel.withColumn("d", effects.cohen_d(F.col("mean_t"), F.col("mean_b"), F.col("sd_t"), F.col("sd_b")))
    return panel.withColumn("d_se", effects.cohen_se(F.col("d"), F.col("finite_t"), F.col("finite_b")))


def steady_panel(cells: DataFrame, source: str, by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", min_seeds: int = 3) -> DataFrame:
    """(by, n, mean, sd of both arms, d, d_se) as ``stratum_panel`` has them, over finite values alone, from sums that don't depend on the order of rows: strata
    of equal rows tie, as ranks over strata need. Squares are those of the deviations from the stratum's means."""
    sides = {"t": treatment, "b": baseline}
    mine = {s: F.when(col(arm) == a, number(source)) for s, a in sides.items()}
    names = [f"_p{k}" for k in range(len(by))]
    same = F.lit(True)
    for b, n in zip(by, names, strict=True):
        same &= col(b).eqNullSafe(F.col(n))
    rows = cells.where(col(arm).isin(treatment, baseline))
    means = steady_sums(rows, by, **mine).where(F.least("t_n", "b_n") >= min_seeds)
    means = means.select(*[col(b).alias(n) for b, n in zip(by, names, strict=True)], *[c for s in sides for c in (F.col(f"{s}_n").alias(f"n_{s}"), (F.col(s) / F.col(f"{s}_n")).alias(f"mean_{s}"))])
    squares = steady_sums(rows.join(means, same), by, **{s: F.pow(v - F.col(f"mean_{s}"), 2) for s, v in mine.items()})
    panel = means.join(squares, same).select(*[col(b) for b in by], *[c for s in sides for c in (f"n_{s}", f"mean_{s}", F.sqrt(F.try_divide(F.col(s), (F.col(f"n_{s}") - 1).cast("double"))).alias(f"sd_{s}"))])
    panel = panel.withColumn("d", effects.cohen_d(F.col("mean_t"), F.col("mean_b"), F.col("sd_t"), F.col("sd_b")))
    return panel.withColumn("d_se", effects.cohen_se(F.col("d"), F.col("n_t"), F.col("n_b")))


def stratum_effects(cells: DataFrame, metrics: list[str], by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", aggregator: str = "mean") -> DataFrame:
    """Difference of the arms' centres per stratum for several metrics at once."""
    side = lambda m, name: AGGREGATES[aggregator](F.when(col(arm) == name, number(m)))
    return cells.groupBy(*[col(b) for b in by]).agg(*[(side(m, treatment) - side(m, baseline)).alias(f"delta_{m}") for m in metrics])


def arm_diff_pooled(cells: DataFrame, source: str, by: list[str], scope_predictor: str | None = None, floor: float = 0.05, min_seeds: int = 5, predicted: str | None = None, **arms) -> tuple[DataFrame, DataFrame]:
    """(strata, pool): Cohen's d of the strata in scope, pooled by DerSimonian-Laird. In scope are strata with ``min_seeds`` finite
    values in both arms and a baseline mean of ``scope_predictor`` above ``floor``."""
    strata = stratum_panel(cells, source, by, min_seeds=min_seeds, **arms).where((F.col("finite_t") >= min_seeds) & (F.col("finite_b") >= min_seeds))
    if scope_predictor:
        arm, baseline = arms.get("arm", "arm_key"), arms.get("baseline", "baseline")
        scope = cells.where(col(arm) == baseline).groupBy(*[col(b) for b in by]).agg(F.avg(number(scope_predictor)).alias("scope_value")).where(F.col("scope_value") > floor)
        strata = strata.join(scope, by)
    return strata, effects.dl_pool(strata, "d", "d_se")


def sign_counts(strata: DataFrame, effect: str = "d", floor: float = 0.0) -> DataFrame:
    """How many strata have a positive and how many a negative effect of at least ``floor``."""
    d = col(effect)
    return strata.where(d.isNotNull() & (F.abs(d) >= floor)).agg(F.count_if(d > 0).alias("positive"), F.count_if(d <= 0).alias("not_positive"), F.count(F.lit(1)).alias("strata"))


def sign_alignment(x: DataFrame, y: DataFrame, by: list[str], floor_x: float = 0.0, floor_y: float = 0.0) -> DataFrame:
    """Strata whose two effects have the same sign; an effect of exactly 0 counts as not positive."""
    both = x.select(*by, F.col("d").alias("dx")).join(y.select(*by, F.col("d").alias("dy")), by)
    both = both.where((F.abs("dx") >= floor_x) & (F.abs("dy") >= floor_y))
    return both.agg(F.count_if((F.col("dx") > 0) == (F.col("dy") > 0)).alias("same"), F.count(F.lit(1)).alias("strata"))


def alignment_test(x: DataFrame, y: DataFrame, by: list[str], alignment: str = "opposite", floor_x: float = 0.0, floor_y: float = 0.0) -> DataFrame:
    """One row (aligned, strata, p): strata whose two effects have the predicted signs (the same or opposite ones; an effect of exactly 0 counts as
    not positive), and the one-tailed sign-test p of so many; null without a stratum."""
    if alignment not in ("same", "opposite"):
        raise ValueError(f"{alignment} is neither same nor opposite")
    out = sign_alignment(x, y, by, floor_x, floor_y)
    aligned = F.col("same") if alignment == "same" else F.col("strata") - F.col("same")
    return out.select(aligned.alias("aligned"), "strata").withColumn("p", F.when(F.col("strata") > 0, special.binomial_tail_column(F.col("aligned"), F.col("strata"), 0.5)))


def probability_of_improvement(cells: DataFrame, source: str, by: list[str], arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline") -> DataFrame:
    """P(treatment > baseline), ties half, per stratum, from rank sums. Ranks need one stratum's rows in order; equal values are
    counted first, so that what is ordered is one row per distinct value."""
    keys = [col(b) for b in by]
    counts = cells.where(col(arm).isin(treatment, baseline) & finite(source)).groupBy(*keys, (number(source) + 0.0).alias("_v")).agg(F.count_if(col(arm) == treatment).alias("_t"), F.count_if(col(arm) == baseline).alias("_b"))
    won = running(counts, by, "_v", ["_b"]).withColumn("_won", F.col("_t") * (F.col("_b_before") + F.col("_b") / 2.0))
    out = won.groupBy(*keys).agg(F.sum("_t").alias("n_t"), F.sum("_b").alias("n_b"), F.sum("_won").alias("u"))
    return out.withColumn("p", F.try_divide("u", (F.col("n_t") * F.col("n_b")).cast("double")))


def with_sign_p(counts: DataFrame, hits: str, trials: str) -> DataFrame:
    """With the two-sided sign-test p of ``hits`` in ``trials``."""
    return counts.withColumn("p", special.binomial_p_column(F.col(hits), F.col(trials)))


def _least(thresholds: dict[str, float], env: str):
    """The threshold of each row's env; null where it has none."""
    return F.create_map([F.lit(x) for kv in thresholds.items() for x in kv])[col(env)] if thresholds else F.lit(None).cast("double")


def classify_envs(cells: DataFrame, env: str, best: str, final: str, thresholds: dict[str, float], solved: float = 0.5) -> DataFrame:
    """(env, n, best, final, best_rate, final_rate, class): means of the finite values, shares of them that reach the env's threshold (0 where there are
    none, null without a threshold), and the class by the final share: solved from ``solved`` on, partial above 0, else unsolved; absent without a
    threshold. Cells without an env are left out."""
    least = _least(thresholds, env)
    rate = lambda v: F.when(F.max(least).isNotNull(), F.coalesce(F.avg((number(v) >= least).cast("double")), F.lit(0.0)))
    out = cells.where(col(env).isNotNull()).groupBy(col(env).alias("env")).agg(F.count(F.lit(1)).alias("n"), F.avg(number(best)).alias("best"), F.avg(number(final)).alias("final"), rate(best).alias("best_rate"), rate(final).alias("final_rate"))
    kind = F.when(F.col("final_rate").isNull(), "absent").when(F.col("final_rate") >= solved, "solved").when(F.col("final_rate") > 0, "partial").otherwise("unsolved")
    return out.withColumn("class", kind)


def entropy(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, entropy): Shannon entropy, in nats, of the distribution of a column's values per stratum, from their counts."""
    counts = rows.where(col(name).isNotNull()).groupBy(*[col(b) for b in by], col(name)).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return counts.groupBy(*[col(b) for b in by]).agg((F.log(F.sum("_n")) - F.sum(F.col("_n") * F.log("_n")) / F.sum("_n")).alias("entropy"))


def envs_in_class(classes: DataFrame, *wanted: str) -> DataFrame:
    return classes.where(F.col("class").isin(*wanted)).select("env")


def filter_to_classes(cells: DataFrame, classes: DataFrame, env: str, *wanted: str) -> DataFrame:
    """Cells of the envs of the wanted classes: a left-semi join."""
    return cells.join(envs_in_class(classes, *wanted).select(F.col("env").alias("_env")), col(env) == F.col("_env"), "left_semi")


def with_cell_class(cells: DataFrame, env: str, value: str, thresholds: dict[str, float], margin: float = 1e-3) -> DataFrame:
    """With cell_class: missing where the value isn't finite; saturated within ``margin`` of the env's largest value, whatever the threshold; else no_threshold
    where the env has none, solved from the threshold on, or unsolved."""
    least, v = _least(thresholds, env), number(value)
    kind = F.when(v.isNull(), "missing").when(F.abs(v - F.col("_top")) <= margin, "saturated").when(least.isNull(), "no_threshold").when(v >= least, "solved").otherwise("unsolved")
    return with_aggregates(cells, [env], _top=F.max(number(value))).withColumn("cell_class", kind).drop("_top")


def env_means(cells: DataFrame, env: str, names: list[str]) -> DataFrame:
    """Means of the finite values of several metrics per env."""
    return cells.groupBy(col(env)).agg(*[F.avg(number(n)).alias(n) for n in names])


def arm_leaves_wide(cells: DataFrame, group: list[str], leaves: list[str]) -> DataFrame:
    """One row per group with the distinct values of each leaf, in numeric order where all are numbers, else in text order."""
    values = lambda x: F.collect_set(col(x).cast("string"))
    ordered = lambda v: F.when(F.forall(v, lambda e: e.try_cast("double").isNotNull()), F.transform(F.array_sort(F.transform(v, lambda e: F.struct(e.try_cast("double").alias("n"), e.alias("t")))), lambda e: e["t"])).otherwise(F.sort_array(v))
    return cells.groupBy(*[col(g) for g in group]).agg(*[ordered(values(x)).alias(x) for x in leaves])


def multi_differential(cells: DataFrame, metrics: list[str], env: str, group: str, first: str, second: str, mode: str = "raw") -> DataFrame:
    """(metric, n1, n2, g): Hedges' g of several metrics between two groups of cells; raw values, z-scores within env, or env means."""
    rows = cells
    if mode == "zscore":
        rows = within_zscores(cells, metrics, env)
    elif mode == "env_mean":
        rows = cells.groupBy(col(env), col(group)).agg(*[F.avg(number(m)).alias(m) for m in metrics])
    side = lambda m, name: F.when(col(group) == name, number(m))
    packed = [F.struct(F.lit(m).alias("metric"), *[f(side(m, name)).alias(f"{k}{s}") for s, name in ((1, first), (2, second)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]) for m in metrics]
    a = rows.agg(F.array(*packed).alias("_x")).select(F.explode("_x").alias("_x")).select("_x.*")
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), (F.col("n1") + F.col("n2") - 2).cast("double")))
    g = F.try_divide(F.col("m1") - F.col("m2"), pooled) * (1 - 3.0 / (4.0 * (F.col("n1") + F.col("n2")) - 9))
    return a.select("metric", "n1", "n2", g.alias("g"))


def verdict_distribution(cells: DataFrame, env: str, verdict: str) -> DataFrame:
    """Per env: counts of held, invariant_violation, power_insufficient and other verdicts, and the strictly largest, else ''."""
    kinds = ("held", "invariant_violation", "power_insufficient")
    v = F.lower(col(verdict))
    out = cells.groupBy(col(env).alias("env")).agg(*[F.count_if(v == k).alias(k) for k in kinds], F.count_if(~F.coalesce(v.isin(*kinds), F.lit(False))).alias("other"))
    names = (*kinds, "other")
    top = F.greatest(*names)
    best = F.when(sum(((F.col(n) == top).cast("int") for n in names), F.lit(0)) == 1, F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in names])).otherwise("")
    return out.withColumn("dominant", best)


def arm_leaves(cells: DataFrame, group: list[str], leaves: list[str]) -> DataFrame:
    """(group, leaf, values): the distinct values, as text, of each leaf."""
    long = cells.select(*[col(g) for g in group], *[col(x).cast("string").alias(x) for x in leaves]).unpivot(group, leaves, "leaf", "value")
    return long.where("value is not null").groupBy(*group, "leaf").agg(F.sort_array(F.collect_set("value")).alias("values"))


def within_zscores(cells: DataFrame, metrics: list[str], env: str, suffix: str = "") -> DataFrame:
    """Metrics standardised within each env (sample deviation), in place or under a suffix; env sums are joined back."""
    sums = {f"_{k}{i}": f(number(m)) for i, m in enumerate(metrics) for k, f in (("m", F.avg), ("s", F.stddev_samp))}
    out = with_aggregates(cells, [env], **sums)
    return out.withColumns({f"{m}{suffix}": F.try_divide(number(m) - F.col(f"_m{i}"), F.col(f"_s{i}")) for i, m in enumerate(metrics)}).drop(*sums)


def within_zscore(cells: DataFrame, metric: str, env: str) -> DataFrame:
    """With ``<metric>_z``."""
    return within_zscores(cells, [metric], env, "_z")


def group_differential(cells: DataFrame, metric: str, group: str, first: str, second: str) -> DataFrame:
    """Hedges' g of a metric between two groups of cells."""
    side = lambda name: F.when(col(group) == name, number(metric))
    a = cells.agg(F.count(side(first)).alias("n1"), F.count(side(second)).alias("n2"), F.avg(side(first)).alias("m1"), F.avg(side(second)).alias("m2"), F.var_samp(side(first)).alias("v1"), F.var_samp(side(second)).alias("v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), (F.col("n1") + F.col("n2") - 2).cast("double")))
    return a.withColumn("g", F.try_divide(F.col("m1") - F.col("m2"), pooled) * (1 - 3.0 / (4.0 * (F.col("n1") + F.col("n2")) - 9)))


def classify_scope(cells: DataFrame, variable: str, by: list[str], least: float = 0.05) -> DataFrame:
    """Whether a variable varies within strata, across them, both or neither: shares of population variance."""
    v = number(variable)
    strata = cells.where(finite(variable)).groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    whole = strata.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 2)).alias("across"))
    share = F.try_divide(F.col("within"), F.col("within") + F.col("across"))
    kind = F.when(share.isNull(), "degenerate").when(share < least, "across").when(share > 1 - least, "within").otherwise("both")
    return whole.withColumn("within_share", share).withColumn("scope", kind)

"""Mediation along bursts with intervals from a cluster bootstrap over cells.

A cell keeps its bursts together, so a replicate gives each cell one weight for all of them: a Poisson(1) number drawn by its inverse
distribution from a hash of seed, cell and replicate. Ranks, correlations and edges of all replicates come from one pass: rows sorted by outcome
are summed up by batch to one row for each mix of arm and mediators, whose values are counted and get prefix sums over range partitions.
Replicate 0, whose weights are all 1, is the sample itself. No stratum is brought to one task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.columns import col, cut, finite, number, running
from .bursts import exploded
from .ranks import correlations, partial_from

SEED = 42
#: Replicates whose counts go through the prefix sums together; more are done in as many passes.
BLOCK = 128


def poisson_steps(mean: float = 1.0, bits: int = 32) -> list[int]:
    """For k = 0, 1, ...: from which number of ``bits`` bits on a draw is above k."""
    steps, term, total = [], math.exp(-mean), 0.0
    for k in range(100):
        total += term
        steps.append(math.ceil(total * (1 << bits)))
        if steps[-1] >= 1 << bits or len(steps) > 1 and steps[-1] == steps[-2]:
            break
        term *= mean / (k + 1)
    return [s for s in dict.fromkeys(steps) if s < 1 << bits]


def replicate_weights(key: Column, first: int, count: int, seed: int = SEED) -> Column:
    """Weights of the replicates ``first`` to ``first + count - 1`` (from 1) of a cell: four from each MD5 of seed, key and number.

    Digests and their quarters are bound by lambdas of their own, so each is made once; eight hexadecimal digits of equal length order as
    their numbers do, so they are compared as text."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    steps = [f"{s:08x}" for s in poisson_steps()]

    def weight(u: Column) -> Column:
        out = F.when(u < steps[0], 0)
        for k, s in enumerate(steps[1:], 1):
            out = out.when(u < s, k)
        return out.otherwise(len(steps)).cast("byte")

    low, high = (first - 1) // 4, (first + count - 2) // 4
    digests = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda c: F.md5(F.concat(F.lit(f"{seed}:"), text, F.lit(":"), c.cast("string"))))
    quarters = F.flatten(F.transform(digests, lambda d: F.array(*[F.substring(d, j * 8 + 1, 8) for j in range(4)])))
    return F.transform(F.slice(quarters, (first - 1) % 4 + 1, count), weight)


def arm_codes(cells: DataFrame, by: list[str], arm: str) -> DataFrame:
    """The cells with ``_code``, the number of arms of their stratum whose names come before; strata of one arm and null arms are left out."""
    arms = cells.where(col(arm).isNotNull()).groupBy(*[col(b).alias(f"_b{k}") for k, b in enumerate(by)], col(arm).cast("string").alias("_arm")).agg(F.lit(1).alias("_one"))
    keys = [f"_b{k}" for k in range(len(by))]
    coded = running(arms, keys, "_arm", ["_one"])
    many = coded.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.count(F.lit(1)).alias("_arms")).where("_arms > 1")
    both = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    coded = coded.join(many, reduce(Column.__and__, both, F.lit(True))).drop(*[f"{k}_" for k in keys], "_arms", "_one")
    same = [col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)]
    return cells.join(coded, reduce(Column.__and__, same, col(arm).cast("string") == F.col("_arm"))).withColumn("_code", F.col("_one_before").cast("double")).drop(*keys, "_arm", "_one_before")


def _changes(*values: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the values."""
    return np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, [np.diff(v) != 0 for v in values]))))


def _without_outcome(rows: DataFrame, keys: list[str], others: list[str], size: int) -> DataFrame:
    """(keys, _v, others, _n, _s, _q, _alone) of rows (keys, _v, others, _w) sorted by keys and _v: for each mix of the others in a run of values of one stratum in one
    batch, arrays of the sums of the weights, the weighted ranks of _v inside the run and their squares; _v is the run's first. A run ``_alone`` is the first
    or last value of a batch, which other batches may hold too; its ranks are 0."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys, "_v", *others).schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(range(len(keys) + 1 + len(others)))
            frame = own.to_pandas()
            stratum, v = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy(), frame["_v"].to_numpy()
            w = batch.column(own.num_columns).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
            starts = _changes(stratum, v)
            alone = np.zeros(len(starts), dtype=int)
            alone[0], alone[-1] = 1, 2
            heads = _changes(stratum[starts], alone)
            each = np.add.reduceat(w, starts)
            before = np.cumsum(each, axis=0) - each
            before -= np.repeat(before[heads], np.diff(np.append(heads, len(starts))), axis=0)
            rank = np.where(alone[:, None] > 0, 0.0, before + (each + 1) / 2.0).repeat(np.diff(np.append(starts, len(v))), axis=0)
            head = np.repeat(starts[heads], np.diff(np.append(starts[heads], len(v))))
            of = frame[others].assign(_head=head).groupby(["_head", *others], sort=False).ngroup().to_numpy()
            by = np.argsort(of, kind="stable")
            firsts = _changes(of[by])
            sums = [np.add.reduceat(x[by], firsts).ravel() for x in (w, w * rank, w * rank * rank)]
            at = by[firsts]
            groups = own.take(pa.array(at)).columns
            groups[len(keys)] = pa.array(v[head[at]])
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * size)
            ends_only = np.isin(head[at], starts[alone > 0])
            yield pa.RecordBatch.from_arrays([*groups, *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in sums], pa.array(ends_only)], names=[*keys, "_v", *others, "_n", "_s", "_q", "_alone"])

    return rows.select(*keys, "_v", *others, "_w").mapInArrow(run, f"{kinds}_n array<double>, _s array<double>, _q array<double>, _alone boolean")


def weighted_ranks(rows: DataFrame, names: list[str], by: list[str], weights: str, size: int) -> DataFrame:
    """(by, _n, _s, _q, _off, r0, r2, ...): arrays with a number for each of the ``size`` weights, of rows summed up over the second name, whose values may be many:
    sums of the weights, of its weighted ranks and of their squares, to all of which ranks ``_off`` is still to be added, and the average ranks of
    each other name. All values must be finite, rows unique.

    Of ``w`` copies each, a value's rank is the weights before it plus half of one more than its own."""
    keys, others = [f"_k{k}" for k in range(len(by))], [f"_v{k}" for k in range(len(names)) if k != 1]
    rows = rows.select(*[col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[(number(n) + 0.0).alias("_v" if k == 1 else f"_v{k}") for k, n in enumerate(names)], col(weights).alias("_w"))
    # the others too, so that a frequent value is dealt over tasks
    placed = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_v", *others).sortWithinPartitions(*keys, "_v")
    rows = cut(_without_outcome(placed, keys, others, size))
    sums = [F.sum(F.get("_n", F.lit(i))).alias(f"_n{i}") for i in range(size)]

    def joined(rows: DataFrame, table: DataFrame, value: str) -> DataFrame:
        table = table.withColumnsRenamed({k: f"{k}_" for k in keys})
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col(value) == F.col("_u"))
        return rows.join(table, same).drop("_u", *[f"{k}_" for k in keys])

    runs = running(rows.groupBy(*keys, "_v").agg(F.max("_alone").alias("_alone"), *sums), keys, "_v", [f"_n{i}" for i in range(size)])
    offset = F.array(*[F.col(f"_n{i}_before") + F.when(F.col("_alone"), (F.col(f"_n{i}") + 1) / 2.0).otherwise(0.0) for i in range(size)])
    out = joined(rows, runs.select(*keys, F.col("_v").alias("_u"), offset.alias("_off")), "_v")
    values = F.explode(F.array(*[F.struct(F.lit(v).alias("at"), F.col(v).alias("v")) for v in others])).alias("_x")
    counts = rows.select(*keys, "_n", values).groupBy(*keys, F.col("_x.at").alias("_at"), F.col("_x.v").alias("_u")).agg(*sums)
    found = running(counts, [*keys, "_at"], "_u", [f"_n{i}" for i in range(size)])
    found = found.select(*keys, "_at", "_u", F.array(*[F.col(f"_n{i}_before") + (F.col(f"_n{i}") + 1) / 2.0 for i in range(size)]).alias("_ranks"))
    for v in others:
        out = joined(out, found.where(F.col("_at") == v).select(*keys, "_u", F.col("_ranks").alias(f"r{v[2:]}")), v)
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "_n", "_s", "_q", "_off", *[f"r{v[2:]}" for v in others])


def _summed(ranked: DataFrame, keys: list[str], ranks: int, size: int, first: int) -> DataFrame:
    """(keys, replicate, n, sums, products): of rows of ``weighted_ranks`` the sums of the weights, the weighted ranks and their products, for each replicate
    from ``first`` on. Each batch is summed up for all replicates together before the shuffle."""
    pairs = [(i, j) for i in range(ranks) for j in range(i, ranks)]
    names = [f"_s{k}" for k in range(ranks)] + [f"_p{k}" for k in range(len(pairs))]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*[col(k) for k in keys]).schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(range(len(keys)))
            of = own.to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            by = np.argsort(of, kind="stable")
            starts = _changes(of[by])
            n, s, q, off, *r = (batch.column(len(keys) + k).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)[by] for k in range(3 + ranks))
            total = lambda v, starts=starts: np.add.reduceat(v, starts).ravel()
            r.insert(1, None)  # of the second name there are sums only
            weighted = [s + off * n if x is None else n * x for x in r]
            product = lambda i, j, r=r, w=weighted, q=q, s=s, off=off, n=n: q + off * (2 * s + off * n) if i == j == 1 else w[i] * r[j] if j != 1 else w[1] * r[i]
            found = [total(n).astype(np.int64), *map(total, weighted), *[total(product(i, j)) for i, j in pairs]]
            at = np.tile(np.arange(first, first + size, dtype=np.int32), len(starts))
            groups = own.take(pa.array(np.repeat(by[starts], size)))
            yield pa.RecordBatch.from_arrays([*groups.columns, pa.array(at), *map(pa.array, found)], names=[*keys, "replicate", "n", *names])

    schema = f"{kinds}, replicate int, n long, " + ", ".join(f"{n} double" for n in names)
    each = ranked.mapInArrow(run, schema).where("n > 0")
    gathered = lambda some: F.array(*[F.sum(n) for n in some])
    return each.groupBy(*[col(k) for k in keys], "replicate").agg(F.sum("n").alias("n"), gathered(names[:ranks]).alias("sums"), gathered(names[ranks:]).alias("products"))


def _solved(sums: DataFrame, controls: int, least: int) -> DataFrame:
    """marginal and conditional correlations of rows of sums and products: arm, outcome, then the controls."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.drop("sums", "products").schema)

    def solve(batches):
        for pdf in batches:
            marginal, conditional = [], []
            for row in pdf[["n", "sums", "products"]].to_dict("records"):
                corr = correlations(row) if row["n"] >= max(least, 4) else None
                plain = math.nan if corr is None else float(corr[0, 1])
                given = partial_from(corr, 0, 1, tuple(range(2, 2 + controls))) if corr is not None and row["n"] >= 5 and row["n"] > 3 + controls else math.nan
                marginal.append(None if math.isnan(plain) else plain)
                conditional.append(None if math.isnan(given) else given)
            yield pdf.drop(columns=["sums", "products"]).assign(marginal=marginal, conditional=conditional)

    return sums.mapInPandas(solve, f"{kinds}, marginal double, conditional double")


def trajectories(cells: DataFrame, mediators: list[str], outcome: str, by: list[str], cell: str, arm: str = "arm_key", min_n: int = 5, replicates: int = 0, seed: int = SEED) -> DataFrame:
    """(by, burst, replicate, n, marginal, conditional): per burst the rank correlation of the arm (its code in name order) with the outcome,
    and the same given all mediators; replicate 0 is the sample, 1 to ``replicates`` its resamples by ``cell``.

    Arrays may be of any length: a cell counts in the bursts where the outcome and all mediators are finite. Correlations are null where n (the
    sum of weights) is under ``min_n`` or under 4, where a side is constant, and the conditional one where n is at most 3 + mediators or
    mediators are collinear. Rows that repeat a cell are resampled together. An empty table gives an empty one.
    """
    names = [f"m{k}" for k in range(len(mediators))]
    arrays = {**dict(zip(names, mediators, strict=True)), "o": outcome}
    held = arm_codes(cells, by, arm)
    held = held.select(*[col(b) for b in by], col(cell).cast("string").alias("_cell"), "_code", *[col(a).alias(n) for n, a in arrays.items()])
    # a number of its own, as few bytes of cells make many rows of bursts and weights
    held = cut(held.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cell"))
    x, parts = ["_code", "o", *names], []
    for first in range(0, replicates + 1, BLOCK):
        size = min(BLOCK, replicates + 1 - first)
        one = F.array(F.lit(1).cast("byte"))
        drawn = replicate_weights(F.col("_cell"), max(first, 1), size - (first == 0), seed) if first or size > 1 else None
        # drawn before the arrays are taken apart, once a cell
        long = exploded(held.withColumn("_w", drawn if first else one if drawn is None else F.concat(one, drawn)), dict(zip(arrays, arrays, strict=True)), [*by, "_code", "_w"])
        for n in ("o", *names):
            long = long.where(finite(n)).withColumn(n, number(n) + 0.0)
        keys = [*by, "burst"]
        tuples = long.groupBy(*[col(b) for b in keys], *x).agg(F.array(*[F.sum(F.get("_w", F.lit(i))) for i in range(size)]).alias("_weights"))
        parts.append(_summed(weighted_ranks(cut(tuples), x, keys, "_weights", size), keys, len(x), size, first))
    return _solved(reduce(DataFrame.unionByName, parts), len(mediators), min_n)


def with_edges(rows: DataFrame, mediators: int, alpha: float = 0.05, min_n: int = 20) -> DataFrame:
    """With p_marginal (t test), p_conditional (normal, Fisher's z with n - 3 - mediators), and booleans edge (the arm and the outcome depend on
    each other at ``alpha``), separated (they don't given the mediators; so too where that can't be tested) and direct; under
    ``min_n`` there are neither p nor edges."""
    r, n = F.col("marginal"), F.col("n")
    t = r * F.sqrt(F.try_divide(n - 2, (1 - r) * (1 + r)))
    plain = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(special.t_p_column(t, (n - 2).cast("double")))
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("conditional")))) * F.sqrt((n - 3 - mediators).cast("double"))
    out = rows.withColumn("p_marginal", F.when((n >= min_n) & r.isNotNull(), plain)).withColumn("p_conditional", F.when((n >= min_n) & (n > 3 + mediators) & F.col("conditional").isNotNull(), special.normal_p_exact(z)))
    edge, direct = F.coalesce(F.col("p_marginal") < alpha, F.lit(False)), F.coalesce(F.col("p_conditional") < alpha, F.lit(False))
    return out.withColumn("edge", edge).withColumn("separated", edge & ~direct).withColumn("direct", edge & direct)


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def pooled(rows: DataFrame, rho: str, offset: int, by: list[str], name: str) -> DataFrame:
    """(by, <name>_bursts, <name>_fixed, <name>_dl, <name>_tau2, <name>_i2): a stratum's bursts pooled by Fisher's z, with weights n - offset and by
    DerSimonian-Laird (from two bursts on). A stratum's bursts are no more than a cell's array has."""
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col(rho))))
    entry = F.when(F.col(rho).isNotNull() & (F.col("n") > offset), F.struct(z.alias("z"), (F.col("n") - offset).cast("double").alias("w")))
    out = rows.groupBy(*[col(b) for b in by]).agg(F.collect_list(entry).alias("_e"))
    out = out.withColumn("_sw", _total("_e", lambda e: e["w"])).withColumn("_fixed", F.try_divide(_total("_e", lambda e: e["w"] * e["z"]), F.col("_sw")))
    out = out.withColumn("_q", F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["w"] * F.pow(e["z"] - F.col("_fixed"), 2))).withColumn("_k", F.size("_e"))
    c = F.col("_sw") - F.try_divide(_total("_e", lambda e: e["w"] * e["w"]), F.col("_sw"))
    out = out.withColumn("_tau2", F.when(F.col("_k") >= 2, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("_q") - (F.col("_k") - 1), c), F.lit(0.0)))))
    again = F.aggregate("_e", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, e: F.struct((acc["a"] + e["z"] / (1 / e["w"] + F.col("_tau2"))).alias("a"), (acc["b"] + 1 / (1 / e["w"] + F.col("_tau2"))).alias("b")), lambda acc: F.try_divide(acc["a"], acc["b"]))
    i2 = F.when(F.col("_k") >= 2, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("_q") - (F.col("_k") - 1), F.col("_q")), F.lit(0.0))))
    return out.select(*[col(b) for b in by], F.col("_k").alias(f"{name}_bursts"), F.tanh("_fixed").alias(f"{name}_fixed"), F.when(F.col("_k") >= 2, F.tanh(again)).alias(f"{name}_dl"), F.col("_tau2").alias(f"{name}_tau2"), i2.alias(f"{name}_i2"))


def statuses(rows: DataFrame, by: list[str], min_n: int = 5, ratio: float = 2.0, floor: float = 0.05) -> DataFrame:
    """(by, status) of the marginal correlations along the bursts: UNDERPOWERED_BURSTS (none was measured), SIGN_FLIP_DETECTED (both signs among those of
    at least ``floor``), WEAK_TIME_VARYING (the largest of those is over ``ratio`` times the smallest), else CONSISTENT_DIRECTION."""
    size = F.abs("marginal")
    loud = F.col("marginal").isNotNull() & (F.col("n") >= min_n) & (size >= floor)
    out = rows.groupBy(*[col(b) for b in by]).agg(
        F.count_if(F.col("marginal").isNotNull() & (F.col("n") >= min_n)).alias("_valid"),
        F.count_if(loud & (F.col("marginal") > 0)).alias("_up"),
        F.count_if(loud & (F.col("marginal") < 0)).alias("_down"),
        F.max(F.when(loud, size)).alias("_most"),
        F.min(F.when(loud, size)).alias("_least"),
    )
    varying = (F.col("_up") + F.col("_down") >= 2) & (F.col("_least") > 0) & (F.try_divide("_most", "_least") > ratio)
    status = F.when(F.col("_valid") == 0, "UNDERPOWERED_BURSTS").when((F.col("_up") > 0) & (F.col("_down") > 0), "SIGN_FLIP_DETECTED").when(varying, "WEAK_TIME_VARYING").otherwise("CONSISTENT_DIRECTION")
    return out.select(*[col(b) for b in by], status.alias("status"))


def _together(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    named = right.select(*[col(b).alias(f"_j{k}") for k, b in enumerate(by)], *[c for c in right.columns if c not in by])
    same = reduce(Column.__and__, [col(b).eqNullSafe(F.col(f"_j{k}")) for k, b in enumerate(by)], F.lit(True))
    return left.join(named, same, "left").drop(*[f"_j{k}" for k in range(len(by))])


def mediation(cells: DataFrame, mediators: list[str], outcome: str, by: list[str], cell: str, arm: str = "arm_key", min_n: int = 5, replicates: int = 0, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """One row per stratum: status, pooled marginal and conditional correlations (rho_marginal and rho_partial are null under SIGN_FLIP_DETECTED; the
    DerSimonian-Laird ones aren't), heterogeneity, and the interval of each DerSimonian-Laird correlation over the replicates."""
    rows = trajectories(cells, mediators, outcome, by, cell, arm, min_n, replicates, seed)
    keys = [*by, "replicate"]
    pools = _together(pooled(rows, "marginal", 3, keys, "marginal"), pooled(rows, "conditional", 3 + len(mediators), keys, "partial"), keys)
    resampled = F.col("replicate") > 0
    own = lambda c: F.max(F.when(~resampled, F.col(c))).alias(c)
    spread = [F.percentile(F.when(resampled, F.col(f"{m}_dl")), F.array(*[F.lit(q) for q in (alpha / 2, 0.5, 1 - alpha / 2)])).alias(f"_{m}") for m in ("marginal", "partial")]
    points = [c for c in pools.columns if c not in keys]
    out = _together(pools.groupBy(*[col(b) for b in by]).agg(*map(own, points), *spread), statuses(rows.where(~resampled), by, min_n), by)
    clear = F.col("status") != "SIGN_FLIP_DETECTED"
    out = out.withColumn("rho_marginal", F.when(clear, F.col("marginal_fixed"))).withColumn("rho_partial", F.when(clear, F.col("partial_fixed")))
    bounds = [F.get(f"_{m}", F.lit(i)).alias(f"{m}_{n}") for m in ("marginal", "partial") for i, n in enumerate(("lower", "median", "upper"))]
    return out.select(*[col(b) for b in by], "status", "rho_marginal", "rho_partial", *[c for c in points if not c.endswith("_fixed")], *bounds)


def edge_counts(cells: DataFrame, mediators: list[str], outcome: str, by: list[str], cell: str, arm: str = "arm_key", alpha: float = 0.05, min_n: int = 20, replicates: int = 0, seed: int = SEED, level: float = 0.05) -> DataFrame:
    """One row per stratum: bursts, marginal_edges, separated and direct, and of each count its lower bound, median and upper bound over the
    replicates, rounded to even; null without replicates."""
    rows = with_edges(trajectories(cells, mediators, outcome, by, cell, arm, min_n, replicates, seed), len(mediators), alpha, min_n)
    names = {"marginal_edges": "edge", "separated": "separated", "direct": "direct"}
    each = rows.groupBy(*[col(b) for b in by], "replicate").agg(F.count(F.lit(1)).alias("bursts"), *[F.count_if(F.col(c)).alias(n) for n, c in names.items()])
    resampled = F.col("replicate") > 0
    out = each.groupBy(*[col(b) for b in by]).agg(
        *[F.max(F.when(~resampled, F.col(c))).alias(c) for c in ("bursts", *names)],
        *[F.percentile(F.when(resampled, F.col(n)), F.array(*[F.lit(q) for q in (level / 2, 0.5, 1 - level / 2)])).alias(f"_{n}") for n in names],
    )
    return out.select(*[col(b) for b in by], "bursts", *names, *[F.bround(F.get(f"_{n}", F.lit(i)), 0).cast("long").alias(f"{n}_{s}") for n in names for i, s in enumerate(("lower", "median", "upper"))])


def leak_adjudication(cells: DataFrame, mediator: str, siblings: list[str], outcome: str, by: list[str], cell: str, arm: str = "arm_key", min_n: int = 8, min_edges: int = 3, min_discordant: int = 5, z_genuine: float = 1.65, alpha: float = 0.05, strata: int | None = None) -> DataFrame:
    """Whether a mediator says more than its siblings: one row per stratum, over bursts with a marginal edge and at least ``min_n`` cells in the run given the
    siblings and in the run given the mediator and them.

    marginal_edges; separated_siblings and separated_joint, per cent of those bursts; b (separated by the joint set alone) and c (by the siblings alone);
    z, McNemar's with Edwards' correction; p, the exact one-sided one of b; and disposition: UNDERPOWERED (under ``min_edges`` edges; then the rest is null and
    b and c are 0), UNDERPOWERED_FOR_GENUINE (under ``min_discordant`` discordant bursts), GENUINE (p at most that of ``z_genuine``, divided by ``strata`` if
    given), else LEAK."""
    runs = []
    for name, given in (("_s", siblings), ("_j", [mediator, *siblings])):
        rows = with_edges(trajectories(cells, given, outcome, by, cell, arm, min_n), len(given), alpha, min_n)
        runs.append(rows.select(*[col(b) for b in by], "burst", F.col("n").alias(f"{name}_n"), F.col("edge").alias(f"{name}_edge"), F.col("separated").alias(name)))
    both = _together(runs[0], runs[1].withColumn("_met", F.lit(True)), [*by, "burst"])
    held = F.coalesce((F.col("_s_n") >= min_n) & (F.col("_j_n") >= min_n) & F.col("_s_edge") & F.col("_j_edge"), F.lit(False))
    out = both.groupBy(*[col(b) for b in by]).agg(
        F.count_if(held).alias("marginal_edges"),
        F.count_if(held & F.col("_s")).alias("_ns"),
        F.count_if(held & F.col("_j")).alias("_nj"),
        F.count_if(held & F.col("_j") & ~F.col("_s")).alias("b"),
        F.count_if(held & ~F.col("_j") & F.col("_s")).alias("c"),
        F.max("_met").alias("_met"),
    ).where("_met")
    enough = F.col("marginal_edges") >= min_edges
    b, c, n = F.col("b"), F.col("c"), F.col("b") + F.col("c")
    z = F.when(n > 0, F.try_divide((b - c - F.signum(b - c)).cast("double"), F.sqrt(n.cast("double"))))
    p = special.binomial_tail_column(b, n, 0.5)
    most = (1 - special.normal_cdf(z_genuine)) / max(strata or 1, 1)
    disposition = F.when(~enough, "UNDERPOWERED").when(n < min_discordant, "UNDERPOWERED_FOR_GENUINE").when(p <= most, "GENUINE").otherwise("LEAK")
    share = lambda k: F.when(enough, F.col(k) * 100.0 / F.col("marginal_edges"))
    return out.select(*[col(x) for x in by], "marginal_edges", share("_ns").alias("separated_siblings"), share("_nj").alias("separated_joint"), F.when(enough, b).otherwise(0).alias("b"), F.when(enough, c).otherwise(0).alias("c"), F.when(enough, z).alias("z"), F.when(enough & (n > 0), p).alias("p"), disposition.alias("disposition"))

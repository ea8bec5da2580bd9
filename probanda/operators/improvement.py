"""Probability of improvement with its interval: a stratified two-sample U statistic and its weighted resamples.

Each cell has a Poisson(1) weight per replicate, drawn from a hash. Cells are placed and sorted by stratum and value, and each batch of them is summed up for all
replicates of a block together, so few rows are left however many values differ. A batch's first and last value may go on in others: their counts stay apart
until they meet. So neither a stratum nor a value has to fit one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col, cut, finite, number
from .mediation import SEED, replicate_weights

#: Replicates of one pass.
BLOCK = 128


def _same(by: list[str], names: list[str]) -> Column:
    return reduce(Column.__and__, [col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)], F.lit(True))


def enough(cells: DataFrame, source: str, by: list[str], arm: str, treatment: str, baseline: str, min_seeds: int) -> DataFrame:
    """The cells of both arms with a finite value, in strata (null is one) that have ``min_seeds`` of either arm."""
    rows = cells.where(col(arm).isin(treatment, baseline) & finite(source))
    names = [f"_s{k}" for k in range(len(by))]
    held = rows.groupBy(*[col(b).alias(n) for b, n in zip(by, names, strict=True)]).agg(F.count_if(col(arm) == treatment).alias("_nt"), F.count_if(col(arm) == baseline).alias("_nb"))
    return rows.join(held.where((F.col("_nt") >= min_seeds) & (F.col("_nb") >= min_seeds)).select(*names), _same(by, names), "left_semi")


def _tallied(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, _v, _at, u, t, b, alone) of rows (keys, _v, _treated, _w) sorted by keys and value: for each weight, t and b count the weights of either arm over a run of
    values of one stratum in one batch, u counts the run's own pairs that the treated win. A run ``alone`` is the first or last value of a batch; its u is 0."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys, "_v").schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(range(len(keys) + 1))
            stratum = own.to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(batch.num_rows)
            v, treated = (batch.column(len(keys) + k).to_numpy(zero_copy_only=False) for k in range(2))
            w = batch.column(len(keys) + 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(stratum) != 0) | (np.diff(v) != 0))))
            t, b = (np.add.reduceat(w * side[:, None], starts) for side in (treated, ~treated))
            alone = np.zeros(len(starts), dtype=bool)
            alone[[0, -1]] = True
            heads = np.flatnonzero(np.concatenate(([True], (np.diff(stratum[starts]) != 0) | alone[1:] | alone[:-1])))
            before = np.cumsum(b, axis=0) - b
            before -= np.repeat(before[heads], np.diff(np.append(heads, len(starts))), axis=0)
            u = np.add.reduceat(np.where(alone[:, None], 0.0, t * (before + b / 2.0)), heads)
            found = [u, np.add.reduceat(t, heads), np.add.reduceat(b, heads), np.repeat(alone[heads], size)]
            groups = own.take(pa.array(np.repeat(starts[heads], size)))
            at = np.tile(np.arange(size, dtype=np.int32), len(heads))
            yield pa.RecordBatch.from_arrays([*groups.columns, pa.array(at), *[pa.array(x.ravel()) for x in found]], names=[*keys, "_v", "_at", "u", "t", "b", "alone"])

    return rows.select(*keys, "_v", "_treated", "_w").mapInArrow(run, f"{kinds}_at int, u double, t long, b long, alone boolean")


def replicates(cells: DataFrame, source: str, by: list[str], cell: str, arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", min_seeds: int = 5, count: int = 0, seed: int = SEED) -> DataFrame:
    """(by, replicate, n_t, n_b, p): P(treatment > baseline), ties half, per stratum; replicate 0 is the sample, 1 to ``count`` its resamples, each cell
    being drawn within its arm and stratum. p is null where a resample has no cell of an arm. Rows that repeat a cell are drawn together."""
    rows = enough(cells, source, by, arm, treatment, baseline, min_seeds)
    keys = [f"_k{k}" for k in range(len(by))]
    rows = cut(rows.select(*[col(b).alias(k) for b, k in zip(by, keys, strict=True)], (number(source) + 0.0).alias("_v"), (col(arm) == treatment).alias("_treated"), col(cell).cast("string").alias("_cell")))
    # a number of its own, as few bytes of cells make many weights; the cell's name, so that a frequent value is dealt over tasks
    rows = rows.repartitionByRange(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_v", "_cell").sortWithinPartitions(*keys, "_v")
    earlier = W.partitionBy(*keys, "_at").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)  # of few rows per batch
    parts = []
    for first in range(0, count + 1, BLOCK):
        size = min(BLOCK, count + 1 - first)
        one = F.array(F.lit(1).cast("byte"))
        drawn = replicate_weights(F.col("_cell"), max(first, 1), size - (first == 0), seed) if first or size > 1 else None
        weights = drawn if first else one if drawn is None else F.concat(one, drawn)
        runs = _tallied(rows.withColumn("_w", weights), keys, size).groupBy(*keys, "_at", "_v").agg(*[F.sum(c).alias(c) for c in "utb"], F.max("alone").alias("_alone"))
        met = F.when(F.col("_alone"), F.col("t") * F.col("b") / 2.0).otherwise(0.0)
        won = runs.withColumn("u", F.col("u") + met + F.col("t") * F.coalesce(F.sum("b").over(earlier), F.lit(0)))
        each = won.groupBy(*keys, "_at").agg(*[F.sum(c).alias(c) for c in "utb"])
        p = F.try_divide(F.col("u"), (F.col("t") * F.col("b")).cast("double"))
        parts.append(each.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], (F.col("_at") + first).alias("replicate"), F.col("t").alias("n_t"), F.col("b").alias("n_b"), p.alias("p")))
    return reduce(DataFrame.unionByName, parts)


def sign_flips(values: DataFrame, value: str, key: Column, most: int = 16_384, draws: int = 10_000, seed: int = SEED) -> DataFrame:
    """One row (p, flips, exact): how often the sum of ``value`` is reached or passed when its rows' signs are flipped. All flips where there are at most
    ``most`` of them, else ``draws`` flips by a hash of seed, ``key`` and number. Each row makes one term per flip, summed up before the shuffle."""
    rows = cut(values.where(col(value).isNotNull()).select(key.cast("string").alias("_key"), col(value).alias("_d")))
    n = rows.count()
    exact = 2**n <= most
    if exact:  # at most 14 rows
        rows, flips = rows.orderBy("_key").coalesce(1).withColumn("_bit", F.monotonically_increasing_id().cast("int")), 2**n
        signs = lambda m: F.when(F.expr("shiftright(_m, _bit) & 1") == 1, -1.0).otherwise(1.0)
    else:
        flips = draws
        signs = lambda m: F.when(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key"), F.lit("null")), F.lit(":"), m.cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    sums = rows.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(flips - 1)))).groupBy("_m").agg(F.sum(F.col("_d") * signs(F.col("_m"))).alias("_s"))
    own = rows.agg(F.sum("_d").alias("_own"))
    out = sums.join(F.broadcast(own)).agg(F.avg((F.col("_s") >= F.col("_own") - 1e-12).cast("double")).alias("p"))  # ``own`` is one row
    return out.select("p", F.when(F.col("p").isNotNull(), F.lit(flips)).otherwise(0).cast("long").alias("flips"), F.lit(exact).alias("exact"))


def mean_improvement(cells: DataFrame, source: str, by: list[str], cell: str, arm: str = "arm_key", treatment: str = "treatment", baseline: str = "baseline", min_seeds: int = 5, count: int = 2000, seed: int = SEED, alpha: float = 0.05, most: int = 16_384, draws: int = 10_000) -> DataFrame:
    """One row: strata, mean (of their probabilities), lower and upper (percentiles of the replicates' means), p, flips and exact (one-sided, by flips of
    the signs of probability - 1/2). Without a stratum: 0, nulls and no flips."""
    rows = cut(replicates(cells, source, by, cell, arm, treatment, baseline, min_seeds, count, seed))
    sample = rows.where("replicate = 0")
    means = rows.groupBy("replicate").agg(F.avg("p").alias("mean"), F.count("p").alias("strata"))
    spread = F.percentile(F.when(F.col("replicate") > 0, F.col("mean")), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = means.agg(F.coalesce(F.max(F.when(F.col("replicate") == 0, F.col("strata"))), F.lit(0)).alias("strata"), F.max(F.when(F.col("replicate") == 0, F.col("mean"))).alias("mean"), spread.alias("_q"))
    flipped = sign_flips(sample.withColumn("_d", F.col("p") - 0.5), "_d", F.to_json(F.struct(*[col(b) for b in by])), most, draws, seed)
    return out.join(F.broadcast(flipped)).select("strata", "mean", F.get("_q", F.lit(0)).alias("lower"), F.get("_q", F.lit(1)).alias("upper"), "p", "flips", "exact")  # one row each

"""Column helpers: quoting of dotted names, and comparisons and aggregates that treat null, NaN and infinities alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its whole name; dots in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str | Column) -> Column:
    """As double; null where missing, NaN or infinite. Booleans become 0 and 1."""
    c = (col(name) if isinstance(name, str) else name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite(name: str | Column) -> Column:
    return number(name).isNotNull()


def _held(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def finite_gt(name, bound: float) -> Column:
    return _held(number(name) > bound)


def finite_ge(name, bound: float) -> Column:
    return _held(number(name) >= bound)


def finite_lt(name, bound: float) -> Column:
    return _held(number(name) < bound)


def finite_le(name, bound: float) -> Column:
    return _held(number(name) <= bound)


def finite_between(name, low: float, high: float) -> Column:
    return _held(number(name).between(low, high))


AGGREGATES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}


def partition_aggregate(name: str, by: list[str], op: str) -> Column:
    """The aggregate of a column over each row's partition, non-finite values left out. Put it in a column before filtering."""
    return AGGREGATES[op](number(name)).over(W.partitionBy(*[col(b) for b in by]))


def padded(df: DataFrame, names: list[str]) -> DataFrame:
    """With a null column for each name that is missing, so that predicates on it drop rows instead of failing."""
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def shared_dir(spark) -> str:
    """The folder of reliable checkpoints: spark.checkpoint.dir; where it is unset one under /tmp in local mode, ValueError on a cluster."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or "/tmp/checkpoints")
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint: what is read twice, such as range partitions, is then the same twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def running(table: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """With ``<value>_before``: the sum of each value over the rows of the same stratum that come earlier in ``order``.

    Rows must be unique in (by, order). They are range-partitioned, summed up inside each partition, and get the totals of earlier
    partitions of their stratum; so no stratum has to fit one task, however few strata there are.
    """
    keys = [col(b) for b in by]
    placed = cut(table.repartitionByRange(*keys, col(order)).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *keys).orderBy(col(order)).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # of one row per partition and stratum
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(col(v)).alias(f"_t_{v}") for v in values])
    names = [f"_key{k}" for k in range(len(by))]
    starts = totals.select(F.col("_part").alias("_of"), *[k.alias(n) for k, n in zip(keys, names, strict=True)], *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values])
    same = F.col("_part") == F.col("_of")
    for k, n in zip(keys, names, strict=True):
        same &= k.eqNullSafe(F.col(n))
    out = placed.withColumns({f"_i_{v}": F.coalesce(F.sum(col(v)).over(inside), F.lit(0)) for v in values}).join(starts, same)
    return out.select(*[col(c) for c in table.columns], *[(F.col(f"_i_{v}") + F.col(f"_s_{v}")).alias(f"{v}_before") for v in values])


def with_aggregates(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """The rows with aggregates of their stratum (null is a stratum): one row per stratum is summed up and joined back, so that no
    stratum is pulled into one task as a window would."""
    names = [f"_by{k}" for k in range(len(by))]
    small = df.groupBy(*[col(b).alias(n) for b, n in zip(by, names, strict=True)]).agg(*[v.alias(n) for n, v in aggregates.items()])
    same = F.lit(True)
    for b, n in zip(by, names, strict=True):
        same = same & col(b).eqNullSafe(F.col(n))
    return (df.join(small, same) if by else df.crossJoin(F.broadcast(small))).drop(*names)


def steady_sums(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """(by, <name>, <name>_n): sum (null without any) and count of the finite numbers of each value per stratum (null is one).

    Equal numbers give equal sums in whatever order and tasks they come, so sums of strata with equal rows tie, as ranks of them need.
    Numbers are cut into three whole ones, in units of their stratum's largest, down to 2^-89 of it; whole ones are summed up exactly.
    """
    keys = [f"_y{k}" for k in range(len(by))]
    rows = df.select(*[col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[number(v).alias(n) for n, v in values.items()])
    rows = with_aggregates(rows, keys, **{f"_top_{n}": F.max(F.abs(col(n))) for n in values})
    sums = []
    for n in values:
        top = F.col(f"_top_{n}")
        unit = F.when(top > 0, F.pow(F.lit(2.0), F.floor(F.log2(top)))).otherwise(1.0)
        rest, parts = col(n) / unit * 2.0**29, []
        for _ in range(3):
            parts.append(rest.cast("long"))
            rest = (rest - parts[-1]) * 2.0**30
        sums += [F.count(col(n)).alias(f"{n}_n"), F.max(unit).alias(f"_unit_{n}"), *[F.sum(q).alias(f"_{k}_{n}") for k, q in enumerate(parts)]]
    out = rows.groupBy(*keys).agg(*sums)
    for n in values:
        high, middle, low = (F.col(f"_{k}_{n}") for k in range(3))
        carried = lambda c: (F.shiftright(c, 30), c.bitwiseAND(F.lit((1 << 30) - 1)))
        more, low = carried(low)
        more, middle = carried(middle + more)
        out = out.withColumn(n, (high + more + (middle + low * 2.0**-30) * 2.0**-30) * 2.0**-29 * F.col(f"_unit_{n}"))
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *[col(c) for n in values for c in (n, f"{n}_n")])

"""Unions, duplicates, audits and outcome derivation on whole frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col, number

# Provenance columns of a run row.
PROVENANCE = ("id", "parent_id", "cycle_id", "timestamp", "verdict", "substrate_commit_sha", "corpus")


def diagonal_union(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null, types are widened."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _key(df: DataFrame, names: list[str]):
    """One text for a row's content; columns of object addresses are volatile and left out."""
    shown = [F.when(col(n).cast("string").rlike("<.* object at 0x[0-9a-f]+>"), F.lit(None)).otherwise(col(n).cast("string")) if t == "string" else F.to_json(F.struct(col(n).alias("v"))) for n, t in df.dtypes if n in names]
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(x, F.lit("\u0000")) for x in shown]), 256)


def dedup_by_content(df: DataFrame, provenance: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """One row of those that are equal but for provenance: that with the smallest id (null last), then the smallest provenance as text.
    Rows are compared by one partial aggregation, so repeats of any number meet as one row per task."""
    names = [c for c in df.columns if c not in provenance]
    order = F.struct(col("id").isNull(), col("id"), F.to_json(F.struct(*[col(c) for c in df.columns if c in provenance])))
    first = df.select(F.struct(*[col(c) for c in df.columns]).alias("_row"), _key(df, names).alias("_key"), order.alias("_order")).groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def distinguishing_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """(column, buckets): columns that differ within rows of an equal key, and in how many keys."""
    rest = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(F.coalesce(col(c).cast("string"), F.lit("\u0000"))).alias(c) for c in rest]).where("_n > 1")
    long = counts.agg(*[F.count_if(col(c) > 1).alias(c) for c in rest]).unpivot([], rest, "column", "buckets")
    return long.where("buckets > 0")


def contamination(traces: DataFrame, runs: DataFrame, key: str = "id") -> DataFrame:
    """Trace ids without a run, and runs without traces."""
    a, b = traces.select(col(key).alias("id")).distinct(), runs.select(col(key).alias("id")).distinct()
    return a.join(b, "id", "left_anti").select("id", F.lit("trace_without_run").alias("kind")).unionByName(b.join(a, "id", "left_anti").select("id", F.lit("run_without_trace").alias("kind")))


def flattened(df: DataFrame, name: str) -> DataFrame:
    """A struct column as one column per leaf, named by its dotted path; arrays as JSON text."""
    out = []

    def walk(path: list[str], kind):
        where = reduce(lambda c, p: c[p], path[1:], col(path[0]))
        if kind.typeName() == "struct":
            for f in kind.fields:
                walk([*path, f.name], f.dataType)
        else:
            out.append((where if kind.typeName() != "array" else F.to_json(where)).alias(".".join(path[1:])))

    walk([name], df.schema[name].dataType)
    names = [c for c in df.columns if c != name]
    made = df.select(*[col(c) for c in names], *out)
    if len(set(made.columns)) < len(made.columns):
        raise ValueError("two leaves have one path")
    return made


def merged_shards(shards: list[DataFrame]) -> DataFrame:
    """The union of shards; ValueError where it has other rows than its shards together or an id twice."""
    whole = diagonal_union(shards)
    rows, ids = whole.agg(F.count(F.lit(1)), F.count_distinct(col("id"))).first()
    if rows != sum(s.count() for s in shards):
        raise ValueError("the merged rows are not those of the shards")
    if ids != rows:
        raise ValueError("an id is missing or repeated in the merged rows")
    return whole


def not_yet(fresh: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """Rows that a cache doesn't have by key; rows without a key count as new."""
    return fresh.join(cache.select(col(key)).distinct(), key, "left_anti")


def without(cache: DataFrame, again: DataFrame, key: str = "corpus") -> DataFrame:
    """A cache without what is taken in again: the rows whose corpus ``again`` has."""
    return cache.join(again.select(col(key)).distinct(), key, "left_anti")


def cache_against_sources(cache: DataFrame, sources: DataFrame, key: str = "corpus") -> DataFrame:
    """(corpus, cached, current, state) of a full outer join on corpus: fresh, stale (other row counts), gone or new."""
    a = cache.groupBy(col(key).alias(key)).agg(F.count(F.lit(1)).alias("cached"))
    b = sources.groupBy(col(key).alias(key)).agg(F.count(F.lit(1)).alias("current"))
    state = F.when(F.col("current").isNull(), "gone").when(F.col("cached").isNull(), "new").when(F.col("cached") == F.col("current"), "fresh").otherwise("stale")
    return a.join(b, key, "full_outer").withColumn("state", state)


def put_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With a column; one of that name may be there only if it has the same values (null and NaN equal themselves), else ValueError."""
    if name not in df.columns:
        return df.withColumn(name, value)
    if df.where(~col(name).eqNullSafe(value)).limit(1).count():
        raise ValueError(f"{name} is there with other values")
    return df


OUTCOME = re.compile(r"(?P<outcome>.+?)_(?:mean_at_(?P<checkpoint>\d+)|mean|terminal_n|terminal_attempted|auc)")


def outcome_family(columns: list[str]) -> dict[str, list[str]]:
    """Columns by the outcome that they are derived from."""
    out: dict[str, list[str]] = {}
    for c in columns:
        if m := OUTCOME.fullmatch(c):
            out.setdefault(m["outcome"], []).append(c)
    return {k: sorted(v) for k, v in sorted(out.items())}


def terminal_checkpoints(columns: list[str]) -> dict[str, int]:
    """The last checkpoint that each outcome has a mean at."""
    out: dict[str, int] = {}
    for c in columns:
        if (m := OUTCOME.fullmatch(c)) and m["checkpoint"]:
            out[m["outcome"]] = max(int(m["checkpoint"]), out.get(m["outcome"], 0))
    return dict(sorted(out.items()))


def derived_outcomes(samples: DataFrame, key: str, checkpoint: str, values: list[str]) -> DataFrame:
    """All outcomes at once, one row per run: for each outcome o the columns o_mean, o_terminal_n, o_terminal_attempted, o_auc and
    o_mean_at_<checkpoint>. Checkpoints are few, as they name columns; samples are summed up per run and checkpoint first."""
    points = [r[0] for r in samples.select(col(checkpoint)).where(col(checkpoint).isNotNull()).distinct().orderBy(col(checkpoint)).limit(1001).collect()]
    if len(points) > 1000:
        raise ValueError("over 1000 checkpoints")
    each = samples.groupBy(col(key).alias("id"), col(checkpoint).alias("_c")).agg(*[f.alias(f"_{k}{i}") for i, v in enumerate(values) for k, f in (("n", F.count(number(v))), ("m", F.avg(number(v))))], F.count(F.lit(1)).alias("_rows"))
    last, out = points[-1] if points else None, []
    for i, v in enumerate(values):
        at = lambda p, i=i: F.max(F.when(F.col("_c") == p, F.col(f"_m{i}")))
        end = F.col("_c") == F.lit(last)
        area = sum(((float(b) - float(a)) * (at(a) + at(b)) / 2 for a, b in zip(points, points[1:])), F.lit(0.0))
        span = float(points[-1]) - float(points[0]) if points else 0.0
        out += [at(last).alias(f"{v}_mean"), F.coalesce(F.max(F.when(end, F.col(f"_n{i}"))), F.lit(0)).alias(f"{v}_terminal_n"), F.coalesce(F.max(F.when(end, F.col("_rows"))), F.lit(0)).alias(f"{v}_terminal_attempted"), (area / span if span > 0 else F.lit(None).cast("double")).alias(f"{v}_auc"), *[at(p).alias(f"{v}_mean_at_{p}") for p in points]]
    return each.groupBy("id").agg(*out)


def outcomes(samples: DataFrame, key: str, checkpoint: str, value: str) -> DataFrame:
    """Per run: samples and finite ones at the record-wide last checkpoint, their mean there, and the normalised area under the
    checkpoint means where the run has all checkpoints."""
    last = samples.agg(F.max(col(checkpoint)).alias("_last"), F.count_distinct(col(checkpoint)).alias("_all"))
    each = samples.groupBy(col(key).alias("id"), col(checkpoint).cast("double").alias("c")).agg(F.count(F.lit(1)).alias("attempted"), F.count(number(value)).alias("n"), F.avg(number(value)).alias("m"))
    w = W.partitionBy("id").orderBy("c")
    step = (F.col("c") - F.lag("c").over(w)) * (F.col("m") + F.lag("m").over(w)) / 2
    rows = each.withColumn("_area", step).join(F.broadcast(last))
    end = F.col("c") == F.col("_last")
    out = rows.groupBy("id").agg(F.max(F.when(end, F.col("attempted"))).alias("attempted"), F.max(F.when(end, F.col("n"))).alias("n"), F.max(F.when(end, F.col("m"))).alias("mean"), F.count("m").alias("_have"), F.max("_all").alias("_all"), F.sum("_area").alias("_area"), (F.max("c") - F.min("c")).alias("_span"))
    auc = F.when((F.col("_have") == F.col("_all")) & (F.col("_span") > 0), F.col("_area") / F.col("_span"))
    return out.select("id", F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("n", F.lit(0)).alias("n"), "mean", auc.alias("auc"))

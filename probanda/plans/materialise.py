"""A store of measurements that grows by parts: what is missing is computed, written beside what is there, and merged when read.

A part is a Parquet table of (id, some metrics); the manifest lists the parts in order with the hash of each metric's definition. Of a metric the latest
part that has a value for an id counts, and parts written under another definition don't. A part is written before the manifest that names it, each
by Spark's commit protocol, so a lost job leaves an unlisted part and the store as it was. Nothing is overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.runs import escaped
from .panel import METRICS, closure, with_metrics


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, root: str) -> list[dict]:
    """The parts in order: path and hashes (of each of its metrics); none where there is no store yet."""
    files, at = _files(spark, f"{root}/measurements/manifest")
    if not files.exists(at):
        return []
    done = sorted(s.getPath().getName() for s in files.listStatus(at) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return json.loads("".join(r[0] for r in spark.read.text(f"{escaped(root)}/measurements/manifest/{done[-1]}", wholetext=True).collect())) if done else []


def _list(spark: SparkSession, root: str, parts: list[dict], number: int) -> None:
    """The next manifest; an error where another writer made one of that number meanwhile."""
    spark.createDataFrame([(json.dumps(parts, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{root}/measurements/manifest/{number:08d}")


def _number(spark: SparkSession, root: str) -> int:
    files, at = _files(spark, f"{root}/measurements/manifest")
    return 1 + max((int(s.getPath().getName()) for s in files.listStatus(at)), default=0) if files.exists(at) else 1


def valid(name: str, kind: str) -> Column:
    """Whether a cell holds a value: not null, and not NaN."""
    return col(name).isNotNull() & ~F.isnan(col(name)) if kind in ("double", "float") else col(name).isNotNull()


def stored(spark: SparkSession, root: str, names: list[str] | None = None, current: bool = True) -> DataFrame | None:
    """(id, metrics) of the store, one row an id; null where no part has a value. ``names`` narrows the columns that are read; with ``current`` only
    values of today's definitions count. None where the store has none of them. One aggregation by id merges all parts."""
    frames: list[DataFrame] = []
    for k, part in enumerate(manifest(spark, root)):
        mine = [n for n, h in part["hashes"].items() if (names is None or n in names) and (not current or n in METRICS and METRICS[n].hash() == h)]
        if mine:
            frames.append(spark.read.parquet(escaped(part["path"])).select("id", *[col(n) for n in mine], F.lit(k).alias("_part")))
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    kinds = dict(out.dtypes)
    found = [n for n in out.columns if n not in ("id", "_part")]
    return out.groupBy("id").agg(*[F.max_by(col(n), F.when(valid(n, kinds[n]), F.col("_part"))).alias(n) for n in found])


def drifted(spark: SparkSession, root: str) -> list[str]:
    """Registered metrics that the store has, but under no part of today's definition."""
    parts = manifest(spark, root)
    held = {n for p in parts for n in p["hashes"]}
    fresh = {n for p in parts for n, h in p["hashes"].items() if n in METRICS and METRICS[n].hash() == h}
    return sorted(n for n in held - fresh if n in METRICS)


def _filled(spark: SparkSession, root: str, cells: DataFrame, names: list[str], force: frozenset[str]) -> tuple[DataFrame, list[str]]:
    """The cells with what is known of the metrics: their own values first, then the store's, neither for ``force``; and the metrics, each after those
    that it reads."""
    wanted = [m.name for m in closure(names, set(cells.columns) - force)]
    cells = cells.drop(*[n for n in wanted if n in force]).where(F.col("id").isNotNull())
    store = stored(spark, root, [n for n in wanted if n not in force])
    if store is not None:
        there = [n for n in store.columns if n != "id"]
        store = store.select(F.col("id").alias("_sid"), *[col(n).alias(f"_s_{n}") for n in there])
        kinds = dict(cells.dtypes)
        cells = cells.join(store, F.col("id") == F.col("_sid"), "left")
        cells = cells.withColumns({n: F.coalesce(F.when(valid(n, kinds[n]), col(n)), col(f"_s_{n}")) if n in kinds else col(f"_s_{n}") for n in there}).drop("_sid", *[f"_s_{n}" for n in there])
    return cells, wanted


def _missing(cells: DataFrame, name: str) -> Column:
    return ~valid(name, dict(cells.dtypes)[name]) if name in cells.columns else F.lit(True)


def gaps(spark: SparkSession, root: str, cells: DataFrame, names: list[str], force: frozenset[str] = frozenset()) -> DataFrame:
    """(id, metric): what ``materialise`` would compute."""
    filled, wanted = _filled(spark, root, cells, names, frozenset(force))
    return filled.select("id", F.explode(F.array_compact(F.array(*[F.when(_missing(filled, n), F.lit(n)) for n in wanted]))).alias("metric"))


def materialise(spark: SparkSession, root: str, cells: DataFrame, names: list[str], force=()) -> dict[str, int]:
    """Compute the metrics of ``names``, and those that they read, for the cells (column id) that neither have them nor find them in the store: null, NaN,
    absent, or written under another definition; those of ``force`` for all cells. Returns how many cells of each metric were computed.

    A part is written of the cells and metrics with a gap alone; nothing is written where there is none. A cell that stays null (what it reads is null) is
    a gap again the next time. Cells without an id are left out; of cells that repeat an id one counts; an empty table has no gaps. KeyError for a name that is
    neither column nor metric.
    """
    force = frozenset(force)
    filled, wanted = _filled(spark, root, cells, names, force)
    if not wanted:
        return {}
    found = filled.agg(*[F.count_if(_missing(filled, n)).alias(n) for n in wanted]).first()
    counts = {n: found[k] for k, n in enumerate(wanted) if found[k]}
    if not counts:
        return {}
    anywhere = F.lit(False)
    for n in counts:
        anywhere = anywhere | _missing(filled, n)
    part = with_metrics(filled.where(anywhere), names).select("id", *[col(n) for n in counts])
    path = f"{root}/measurements/parts/{uuid.uuid4().hex}"
    part.write.parquet(path)
    number = _number(spark, root)
    _list(spark, root, [*manifest(spark, root), {"path": path, "hashes": {n: METRICS[n].hash() for n in counts}}], number)
    return counts


def recoverable(spark: SparkSession, root: str, cells: DataFrame, names: list[str]) -> list[str]:
    """Metrics of ``names`` that the store has under today's definition without a single value, though ``cells`` now have all the columns that they read in turn."""
    store = stored(spark, root, names)
    if store is None:
        return []
    kinds = dict(store.dtypes)
    have = set(cells.columns) - set(names)
    ready = []
    for n in [n for n in names if n in kinds]:
        try:
            closure([n], have)
            ready.append(n)
        except KeyError:
            continue
    if not ready:
        return []
    held = store.agg(*[F.count_if(valid(n, kinds[n])).alias(n) for n in ready]).first()
    return [n for k, n in enumerate(ready) if not held[k]]


def compact(spark: SparkSession, root: str) -> None:
    """One part of today's definitions instead of many; the parts before stay on disk for readers that have begun."""
    store = stored(spark, root)
    if store is None:
        return
    path = f"{root}/measurements/parts/{uuid.uuid4().hex}"
    store.write.parquet(path)
    _list(spark, root, [{"path": path, "hashes": {n: METRICS[n].hash() for n in store.columns if n != "id"}}], _number(spark, root))

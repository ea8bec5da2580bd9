"""Readers of run records: JSON folders and Parquet corpora, and the store of measured columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators import frames


def escaped(path: str) -> str:
    """A path whose brackets are no patterns."""
    return "".join(f"\\{c}" if c in "[]{}*?" else c for c in path)


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per line of runs.jsonl with its run_id as id; ValueError where an id is missing or repeated."""
    runs = spark.read.json(f"{escaped(root)}/runs.jsonl")
    if "run_id" not in runs.columns:
        raise ValueError("runs.jsonl has no run_id")
    bad = runs.groupBy("run_id").count().where("run_id is null or count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"run ids are missing or repeated: {[r[0] for r in bad]}")
    return runs.withColumnRenamed("run_id", "id")


def load_evaluations(spark: SparkSession, root: str, runs: DataFrame) -> DataFrame:
    """Rows of evaluations.jsonl; ValueError for a repeated (run, checkpoint, seed) or an unknown run."""
    rows = spark.read.json(f"{escaped(root)}/evaluations.jsonl")
    again = rows.groupBy("run_id", "checkpoint", "evaluation_seed").count().where("count > 1").limit(1).count()
    if again:
        raise ValueError("an evaluation is repeated")
    if rows.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti").limit(1).count():
        raise ValueError("an evaluation is of an unknown run")
    return rows


def _paths(kind, path: str = "") -> list[str]:
    """Dotted paths of the leaves of a struct type; arrays are leaves."""
    if kind.typeName() != "struct":
        return [path]
    return [p for f in kind.fields for p in _paths(f.dataType, f"{path}.{f.name}" if path else f.name)]


def config_table(spark: SparkSession, root: str) -> DataFrame:
    """(id, config.<path> columns): configs/<id>.json of every run, one column per leaf path; null leaves stay null."""
    read = spark.read.text(f"{escaped(root)}/configs", wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    found = read.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0] or "VOID"
    if not found.startswith("OBJECT<"):
        return spark.createDataFrame([], "id string")
    kind = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<")).replace("VOID", "STRING")
    parsed = read.select("_path", F.from_json("value", kind).alias("_c"))
    run = F.regexp_extract(F.url_decode("_path"), r"([^/]+)\.json$", 1).alias("id")
    where = lambda p: F.col(".".join(["_c", *(f"`{x}`" for x in p.split("."))]))
    return parsed.select(run, *[where(p).alias(f"config.{p}") for p in _paths(parsed.schema["_c"].dataType)])


def config_columns(spark: SparkSession, root: str) -> frozenset[str]:
    """The union of the flattened configuration paths: the leaf registry. Only the schema is needed."""
    return frozenset(c for c in config_table(spark, root).columns if c != "id")


def load_folder(spark: SparkSession, root: str) -> DataFrame:
    """Runs with their configurations, and the means of their evaluations' outcomes at the last checkpoint: one row per run.

    ValueError where a configuration's path is a run's column already. The producer named in provenance.json, if there, is a column.
    """
    out = load_runs(spark, root)
    configs = config_table(spark, root)
    clash = sorted(set(configs.columns) & set(out.columns) - {"id"})
    if clash:
        raise ValueError(f"configuration paths are columns of the runs already: {clash}")
    rows = load_evaluations(spark, root, out)
    outcomes = [n for n, t in rows.dtypes if t in ("double", "bigint") and n not in ("checkpoint", "evaluation_seed")]
    out = out.join(configs, "id", "left").join(frames.derived_outcomes(rows, "run_id", "checkpoint", outcomes), "id", "left")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/provenance.json")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    held = spark.read.text(f"{escaped(root)}/provenance.json", wholetext=True).select(F.get_json_object("value", "$.producer")).first() if there else None
    return out.withColumn("producer", F.lit(held[0] if held else None).cast("string"))


def measurement_store(spark: SparkSession, root: str, schema: str = "id string") -> DataFrame:
    """measurements.parquet of a corpus; an empty table of ``schema`` where there is none yet."""
    path = f"{root}/measurements.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(escaped(path))


def write_reduced(traces: DataFrame, path: str, add: dict, drop: list[str]) -> None:
    """Traces with reductions added and raw series dropped: the series are read once and never written."""
    traces.withColumns(add).drop(*drop).write.mode("overwrite").parquet(path)


def load_corpus(spark: SparkSession, root: str, measurements: bool = False, traces: bool = False, prefer: str = "measurements") -> DataFrame:
    """runs.parquet with measurements (none where the store is absent) and traces joined on id; of columns in both, ``prefer`` wins.
    Column pruning reaches the scans."""
    out = spark.read.parquet(f"{escaped(root)}/runs.parquet")
    for wanted, name in ((measurements, "measurements"), (traces, "traces")):
        if wanted:
            more = measurement_store(spark, root) if name == "measurements" else spark.read.parquet(f"{escaped(root)}/{name}.parquet")
            both = [c for c in more.columns if c in out.columns and c != "id"]
            more, out = (more.drop(*both), out) if name == "traces" or prefer != "measurements" else (more, out.drop(*both))
            out = out.join(more, "id", "left")
    return out.withColumn("corpus", F.lit("/".join(root.rstrip("/").split("/")[-2:])))


def tightened(df: DataFrame) -> DataFrame:
    """Arrays of doubles and longs as floats and ints."""
    narrow = {"array<double>": "array<float>", "array<bigint>": "array<int>"}
    return df.select(*[col(n).cast(narrow[t]).alias(n) if t in narrow else col(n) for n, t in df.dtypes])


def write_measurements(df: DataFrame, root: str, hashes: dict[str, str]) -> None:
    """The store and then its hashes, both through Spark's commit protocol, so that a half-written store has no hashes."""
    df.write.mode("overwrite").parquet(f"{root}/measurements.parquet")
    df.sparkSession.createDataFrame([(json.dumps(hashes, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/measurements.hashes")


def drifted(spark: SparkSession, root: str, hashes: dict[str, str]) -> list[str]:
    """Metrics whose definition is not the one that the store was written with."""
    held = json.loads("".join(r[0] for r in spark.read.text(f"{escaped(root)}/measurements.hashes").collect()) or "{}")
    return sorted(n for n, h in hashes.items() if held.get(n) != h)

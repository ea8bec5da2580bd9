"""Evidence from results: levels of edges, clusters by extent and their composed verdict, walks on the small claim graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tiers from weakest to strongest.
TIERS = ("correlational", "observational", "interventional")


def edges(spark, results: list, claims: dict) -> DataFrame:
    """One row per result: source, target, extent, verdict, tier and level."""
    rows = [(claims[r.name].source, claims[r.name].target, r.extent, r.verdict, claims[r.name].tier) for r in results]
    df = spark.createDataFrame(rows, "source string, target string, extent string, verdict string, tier string")
    return stamped(df)


def stamped(df: DataFrame) -> DataFrame:
    """With the level that a verdict gives its edge."""
    held = F.col("verdict").startswith("held")
    level = F.when(held & (F.col("tier") == "interventional"), "causal_one_sided").when(held, "correlational").when(F.col("verdict").isin("no_effect", "sign_flip"), "refuted").otherwise("unevaluated")
    return df.withColumn("level", level)


def clusters(df: DataFrame) -> DataFrame:
    """Per (source, target, extent): empty extent, refuted, underpowered or supported, in this order of precedence."""
    out = df.groupBy("source", "target", "extent").agg(F.count(F.lit(1)).alias("claims"), F.bool_or(F.col("level") == "refuted").alias("_refuted"), F.bool_or(F.col("verdict") == "power_insufficient").alias("_weak"))
    verdict = F.when(F.col("extent").isNull(), "empty_extent").when(F.col("_refuted"), "refuted").when(F.col("_weak"), "underpowered").otherwise("supported")
    return out.withColumn("cluster_verdict", verdict).drop("_refuted", "_weak")


def chain_tier(tiers: list[str]) -> str | None:
    """The weakest tier of a walk, invariants skipped."""
    known = [t for t in tiers if t in TIERS]
    return min(known, key=TIERS.index) if known else None


def compose_direction(signs: list[str]) -> str:
    if any(s not in ("positive", "negative") for s in signs):
        return "either"
    return "negative" if sum(s == "negative" for s in signs) % 2 else "positive"


def first_path(pairs: list[tuple[str, str]], start: str, end: str) -> list[str] | None:
    """A path of the directed pairs, depth first in their order."""
    stack, seen = [[start]], {start}
    while stack:
        path = stack.pop()
        if path[-1] == end:
            return path
        for a, b in reversed(pairs):
            if a == path[-1] and b not in seen:
                seen.add(b)
                stack.append([*path, b])
    return None


def to_dot(pairs: list[tuple[str, str, str]]) -> str:
    """Graphviz text of (source, target, level)."""
    lines = [f'  "{a}" -> "{b}" [label="{level}"];' for a, b, level in sorted(pairs)]
    return "\n".join(["digraph evidence {", *lines, "}"])


def explained(correlations: DataFrame, claims: DataFrame, least: float = 0.3) -> DataFrame:
    """Correlated pairs (a, b, r) beyond ``least``: explained where a claim links them either way, else unmapped."""
    both = claims.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(claims.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct().withColumn("_claimed", F.lit(True))
    out = correlations.where(F.abs("r") >= least).join(both, ["a", "b"], "left")
    return out.withColumn("status", F.when(F.col("_claimed"), "explained").otherwise("unmapped")).drop("_claimed")

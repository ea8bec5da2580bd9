"""Mixing sources to target weights: targets per source, repetition rates, and copies of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged

#: Weights that sources take in turn, in code-point order.
CYCLE = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and the most that a source may be repeated.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """The rows with ``_rank`` from 0 in code-point order, null last; range partitions are sorted and counted, none holds all rows."""
    placed = sources.orderBy(F.col(name).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("_part", F.shiftright("_at", 33)), "mix-sources")
    counts = sorted(placed.groupBy("_part").count().collect())  # one row per range partition
    starts, n = {}, 0
    for part, rows in counts:
        starts[part] = n
        n += rows
    if not starts:
        return placed.withColumn("_rank", F.lit(0).cast("long")).drop("_at", "_part")
    start = F.create_map([F.lit(x) for kv in starts.items() for x in kv])
    return placed.withColumn("_rank", start[F.col("_part")].cast("long") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size) to (source, source_size, target): weighted shares of ``share`` of all words, none above
    ``most`` times its source; what is above goes to the others by weight, again until none is above.

    The fill level rises from round to round; each round is one aggregation over the sources, of which the driver gets sums.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int"))
    rows = ranked(sizes, "source").withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = F.col("_weight") * F.lit(level) >= F.col("_cap")
        n, caps, weights = rows.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))).first()
        if n is None or n == held or not weights:
            break
        level, held = max(level, (share * total - caps) / weights), n
    return rows.withColumn("target", F.least("_cap", F.col("_weight") * F.lit(level))).drop("_weight", "_cap", "_rank")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _drawn(docs: DataFrame, keep: Column, key: str, text: str, source: str, seed: str, **targets) -> DataFrame:
    """(_row: ``keep`` of a document, _size, _source, _source_size, _target, _copies); no document is shuffled where sources are few."""
    rows = docs.select(keep.alias("_row"), draw(F.col(f"`{key}`"), seed).alias("_draw"), word_count(F.col(f"`{text}`")).alias("_size"), F.col(f"`{source}`").cast("string").alias("_source"))
    lean = docs.select(word_count(F.col(f"`{text}`")).alias("_size"), F.col(f"`{source}`").cast("string").alias("source"))
    sizes = lean.groupBy("source").agg(F.sum("_size").cast("long").alias("source_size"))
    wanted = staged(source_targets(sizes, **targets), "mix-targets")
    wanted = small_side(wanted.select(F.col("source").alias("_name"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")), wanted.count(), 50_000)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    out = rows.join(wanted, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    return out.withColumn("_copies", (F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long")).cast("long"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **targets) -> DataFrame:
    """Per document: ``key``, size, source, source_size, target, copies (how often the mix takes it) and taken (words).

    The rate of a source is its target over its size; a document is taken floor(rate) times and once more with the
    fraction as probability, by a hash of its key. Null and empty texts have size 0. Null is a source of its own, last in
    order. A source without words has target 0. Rows that repeat a key are drawn alike if they share a source. An empty table
    gives an empty one; other columns are left out, so extra columns cannot clash. Sources of any number or size are fine: sizes are
    summed before they are shuffled, and the per-source figures are joined back by broadcast only where few, else with a
    join that splits hot sources.
    """
    out = _drawn(docs, F.col(f"`{key}`"), key, text, source, seed, **targets)
    return out.select(F.col("_row").alias(key), F.col("_size").alias("size"), F.col("_source").alias("source"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, copy_no: str | None = None, **targets) -> DataFrame:
    """The rows of the mix, all columns kept whatever their names, each row as often as ``plan`` draws it: rows that repeat a key follow
    their own source. ``copy_no`` names a column more that counts the copies of a row from 0. Nulls, empty texts and empty tables as in ``plan``."""
    if copy_no in docs.columns:
        raise ValueError(f"{copy_no} is a column of the documents already")
    taken = _drawn(docs, F.struct("*"), key, text, source, seed, **targets).where("_copies > 0")
    taken = taken.select("_row", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("_copy"))
    names = [F.col("_row")[c].alias(c) for c in docs.columns]
    return taken.select(*names, *([F.col("_copy").alias(copy_no)] if copy_no else []))

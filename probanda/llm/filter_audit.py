"""How filters that run one after the other share their removals: Walsh-Hadamard audit.

A document's failures are a mask, one bit a filter. Per part and label the mask counts are gathered as signed parity sums, one for each set of
filters: +1 for documents that fail an even number of the set's filters, -1 for the others. The sums are partial aggregates
of one pass, so no part is brought together; the transform inverts them exactly (its sums are whole numbers, divisible by their
count), and every order of the filters is worked out from the mask counts alone.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that isn't null: too short, repetitive, mostly capitals, odd characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.char_length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def marked_copies(rows: DataFrame, key: str, digest: str, name: str, heavy: int = 1_000) -> DataFrame:
    """The rows with a boolean column ``name``: whether a smaller ``key`` has the same ``digest``; never for null keys.

    Digests that more than a ``heavy``-th of all rows share are fewer than ``heavy``, so they are broadcast; all others meet their least
    key by a join whose groups are that small at most.
    """
    held = rows.groupBy(F.col(digest).alias("_d")).agg(F.count("*").alias("_c"), F.min(key).alias("_least"), F.max(key).alias("_most"))
    held = staged(held.where("_most > _least").select("_d", "_c", "_least"), "audit-copies")
    most = rows.count() / heavy
    frequent = F.broadcast(held.where(F.col("_c") > most).select(F.col("_d").alias("_f"), F.col("_least").alias("_floor")))
    rare = held.where(F.col("_c") <= most).select("_d", "_least")
    near = rows.join(frequent, F.col(digest) == F.col("_f"), "left")
    hot = near.where(F.col("_f").isNotNull()).withColumn(name, F.coalesce(F.col(key) > F.col("_floor"), F.lit(False)))
    cold = near.where(F.col("_f").isNull()).join(rare, F.col(digest) == F.col("_d"), "left").withColumn(name, F.coalesce(F.col(key) > F.col("_least"), F.lit(False)))
    return hot.drop("_f", "_floor").unionByName(cold.drop("_f", "_floor", "_d", "_least"))


def parity_sums(rows: DataFrame, by: list[str], mask: str, filters: int) -> DataFrame:
    """``by`` and _sums, the signed parity sum of each set of filters in the order of its mask."""
    signs = [F.sum(F.lit(1) - F.bit_count(F.col(mask).bitwiseAND(s)) % 2 * 2).cast("long").alias(f"_s{s}") for s in range(1 << filters)]
    out = rows.groupBy(*by).agg(*signs)
    return out.select(*by, F.array(*[f"_s{s}" for s in range(1 << filters)]).alias("_sums"))


def butterfly(x: Column, bit: int) -> Column:
    """One step of the transform: sums and differences of the entries that differ in ``bit``."""

    def entry(v: Column, i: Column) -> Column:
        upper = i.bitwiseAND(bit) != 0
        other = F.element_at(x, F.when(upper, i - bit + 1).otherwise(i + bit + 1).cast("int"))
        return F.when(upper, other - v).otherwise(v + other)

    return F.transform(x, entry)


def inverted(sums: DataFrame, column: str, filters: int) -> DataFrame:
    """``column`` of parity sums turned into the number of rows of each mask, by one butterfly a filter."""
    for k in range(filters):
        sums = sums.withColumn(column, butterfly(F.col(column), 1 << k))
    return sums.withColumn(column, F.transform(column, lambda v: F.shiftright(v, filters)))


def passing(counts: str, filters: int) -> Column:
    """For each set of filters the number of rows that fail none of them, from the mask counts."""
    n = 1 << filters
    return F.array(*[sum((F.col(counts)[m] for m in range(1, n) if not m & s), F.col(counts)[0]) for s in range(n)])


def audit(masks: DataFrame, letters: str, part: str = "part", mask: str = "mask", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """From a table of rows (part, mask of the failed filters, good and toxic booleans) one row per part, order of the filters and step.

    Columns: part, filter_order, step (from 1), kept, removed, redundant (failing the step's filter but removed earlier), unique_fails
    (failing that filter only), good_lost, toxic_lost (of the removed), shapley: what the filter removes over all orders, which is
    orders / failures for each row that fails it, since each of its failed filters is the first in as many orders. An empty table gives an
    empty one; null booleans count as false. ``letters`` may be up to six, as there are factorial(letters) orders.
    """
    n, orders = len(letters), factorial(len(letters))
    rows = masks.select(F.col(part).alias("part"), F.col(mask).cast("int").alias("_mask"), F.coalesce(F.col(good), F.lit(False)).alias("_good"), F.coalesce(F.col(toxic), F.lit(False)).alias("_toxic"))
    cells = inverted(parity_sums(rows, ["part", "_good", "_toxic"], "_mask", n), "_sums", n)
    each = lambda when: F.array(*[F.sum(F.when(when, F.col("_sums")[m]).otherwise(0)).cast("long") for m in range(1 << n)])
    parts = cells.groupBy("part").agg(each(F.lit(True)).alias("_n"), each(F.col("_good")).alias("_g"), each(F.col("_toxic")).alias("_t"))
    share = F.array(*[sum((F.col("_n")[m] * (orders // m.bit_count()) for m in range(1 << n) if m >> k & 1), F.lit(0).cast("long")) for k in range(n)])
    alone = F.array(*[F.col("_n")[1 << k] for k in range(n)])
    parts = parts.select("part", share.alias("_share"), alone.alias("_alone"), *[passing(c, n).alias(f"_pass{c}") for c in ("_n", "_g", "_t")])
    every = F.array(*[F.lit("".join(o)) for o in permutations(letters)])
    steps = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = F.array(*[F.lit(1 << k) for k in range(n)])
    places = F.transform(F.split("filter_order", ""), lambda c: F.position(c, F.lit(letters)))
    steps = steps.withColumn("_at", F.element_at(places, F.col("step"))).withColumn("_before", F.aggregate(F.slice(places, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, at: acc.bitwiseOR(F.element_at(bits, at))))
    this = F.element_at(bits, F.col("_at"))
    after = F.col("_before").bitwiseOR(this)
    taken = lambda c: F.get(c, F.col("_before")) - F.get(c, after)
    removed = taken(F.col("_pass_n"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("_pass_n", after).alias("kept"),
        removed.alias("removed"),
        (F.get("_pass_n", F.lit(0)) - F.get("_pass_n", this) - removed).alias("redundant"),
        F.element_at("_alone", F.col("_at")).alias("unique_fails"),
        taken(F.col("_pass_g")).alias("good_lost"),
        taken(F.col("_pass_t")).alias("toxic_lost"),
        F.element_at("_share", F.col("_at")).alias("shapley"),
    )


def labelled(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """The rows with booleans _good and _toxic: some label of their ``key`` has quality 1, or toxic 1; false without a label or key."""
    flags = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "_good"), ("toxic", "_toxic"))])
    met = rows.where(F.col(key).isNotNull()).join(flags, F.col(key) == F.col("_id"), "left").drop("_id")
    bare = rows.where(F.col(key).isNull()).withColumn("_good", F.lit(False)).withColumn("_toxic", F.lit(False))
    return met.unionByName(bare)


def audit_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", filters=text_filters) -> DataFrame:
    """The audit of ``filters`` on whole texts and, as the last filter, of copies: texts that a smaller ``key`` has anywhere in the table.

    Null texts count as empty and null parts as the empty string. Rows without a key are no copies and have no label; rows that repeat a
    key are rows each, and the same text under one key twice is no copy; a key labelled more than once has what any of its labels says. Texts are
    read once: what is shuffled is a digest, the mask and the key of each. An empty table gives an empty one; other columns are
    left out, so their names cannot clash.
    """
    held = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    fails = filters(F.col("_text"))
    letters = "".join(fails)
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    lean = staged(held.select("_key", "part", mask.alias("_fails"), F.unhex(F.sha2(F.encode("_text", "UTF-8"), 256)).alias("_digest")), "audit-masks")
    rows = labelled(marked_copies(lean, "_key", "_digest", "_copy"), "_key", labels)
    rows = rows.withColumn("mask", F.col("_fails") + F.when(F.col("_copy"), 1 << len(letters)).otherwise(0))
    return audit(rows, letters + chr(ord(letters[-1]) + 1), good="_good", toxic="_toxic")

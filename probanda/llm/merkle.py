"""Merkle manifest of a table: a tree per group of rows and one over the groups' roots, built and proved level by level.

A tree's nodes have an index in their group; every ``FANOUT`` consecutive ones are hashed into a parent until one is left. All that is
joined or grouped is keyed by (group, index), so no task holds more than a run of nodes of a group, however large that is. Proofs are made
from the top: each level's runs meet the path of their parent, and each child puts its siblings before it, so that a path
is shuffled once for a run and not once for each leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_side, staged

FANOUT = 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A path: what stands left and right of the node in its run, for each level from the node to the root.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' UTF-8 bytes one after the other, in lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf has it: - if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tampered_with(key: Column) -> Column:
    """Whether the tampering of a test changes the row: 5 divides the CRC-32 of its decimal key; never for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(nodes: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows, staged, with ``_index`` from 0 within their group (null is one, and first) by ``order``, nulls first, and the group's size
    ``_n``.

    The table is dealt by range and each range is numbered alone; a table of one row per (range, group) has the numbers before it. Rows
    that are equal in group and order are dealt by their place in the input, so that a group of repeated rows spans ranges too.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    spread = nodes.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.orderBy(*by, F.col("_tie")).withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
    ranged = staged(ranged.withColumn("_range", F.shiftright("_at", 33)), name)
    each = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_g")  # one row for each range that the group spans
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = staged(each.select("_g", "_r", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n")), f"{name}-ranges")
    each = small_side(each, each.count(), 50_000)
    met = ranged.join(each, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return met.withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_g", "_r", "_shift")


def parents(nodes: DataFrame, kept: tuple[str, ...], fanout: int, name: str) -> DataFrame:
    """The runs of nodes whose group has more than one: (_group, _index of the parent, _n of its level, _kids in their order)."""
    kid = F.struct("_index", "_digest", *kept)
    runs = nodes.where("_n > 1").groupBy("_group", F.floor(F.col("_index") / fanout).cast("long").alias("_parent"), "_n").agg(F.sort_array(F.collect_list(kid)).alias("_kids"))
    return staged(runs.select("_group", F.col("_parent").alias("_index"), F.ceil(F.col("_n") / fanout).cast("long").alias("_n"), "_kids"), name)


def tree(nodes: DataFrame, kept: tuple[str, ...] = (), fanout: int = FANOUT, name: str = "merkle") -> tuple[list[DataFrame], DataFrame]:
    """From (_group, _index, _n, _digest, kept columns) the runs of each level and (_group, _digest, _level) of each group's root."""
    levels, tops, now = [], [nodes.where("_n = 1").select("_group", "_digest", F.lit(0).alias("_level"))], nodes
    while True:
        runs = parents(now, kept if not levels else (), fanout, f"{name}-{len(levels)}")
        most = runs.agg(F.max("_n")).first()[0]
        if most is None:
            discard(runs)
            break
        levels.append(runs)
        now = runs.select("_group", "_index", "_n", F.sha2(F.array_join(F.transform("_kids", lambda k: k["_digest"]), "").cast("binary"), 256).alias("_digest"))
        tops.append(now.where("_n = 1").select("_group", "_digest", F.lit(len(levels)).alias("_level")))
        if most == 1:
            break
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return levels, roots


def paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """(_group, _digest, _path, kept columns, columns of the group) of every node of the lowest level. ``tops`` has _group, _level, the
    _path above the group's root and any columns more, which all of the group's nodes get."""
    more = [c for c in tops.columns if c not in ("_group", "_level", "_path")]
    lists = tops.select(F.col("_group").alias("_g"), "_level", F.lit(0).cast("long").alias("_i"), "_path", *more)
    above = None
    for level in range(len(levels), 0, -1):
        here = lists.where(F.col("_level") == level).drop("_level")
        above = here if above is None else above.unionByName(here)
        met = levels[level - 1].drop("_n").join(above, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_index") == F.col("_i"))).select("_group", "_kids", "_path", *more)
        hashes = F.transform("_kids", lambda k: k["_digest"])
        one = met.withColumn("_hashes", hashes).select("*", F.posexplode("_kids").alias("_k", "_kid"))
        left = F.array_join(F.slice("_hashes", 1, F.col("_k")), "")
        right = F.array_join(F.slice("_hashes", F.col("_k") + 2, F.size("_hashes")), "")
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "_path").cast(PATH)
        if level > 1:
            above = one.select(F.col("_group").alias("_g"), F.col("_kid._index").alias("_i"), path.alias("_path"), *more)
        else:
            below = one.select("_group", F.col("_kid._digest").alias("_digest"), path.alias("_path"), *[F.col(f"_kid.{c}").alias(c) for c in kept], *more)
    lone = nodes.where("_n = 1").select("_group", "_digest", *kept)
    flat = lone.join(lists.where("_level = 0").drop("_level", "_i"), F.col("_group").eqNullSafe(F.col("_g"))).select("_group", "_digest", "_path", *kept, *more)
    return flat if not levels else below.unionByName(flat)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = FANOUT, tamper=tampered_with) -> DataFrame:
    """One row per row of ``docs``: ``key``, leaf, subroot (of its group), root, path (siblings), proof_sha256, folded_root and verified.

    Leaves of a group ascend by ``key``, null keys first and equal keys by leaf; groups ascend by their bytes, null first. ``folded_root`` is
    recomputed from the leaf of the row as ``tamper`` leaves it (A-Z of its text lower-cased where ``tamper(key)`` holds) and the
    siblings as they were; ``verified`` says whether it is the root. Null texts and other nulls count as ``-``, so null and empty differ.
    Repeated rows are leaves each. A table of one row has that leaf as root and no siblings; an empty table gives an empty one; columns
    outside ``fields`` are left out, so their names cannot clash.
    """
    at = {c: F.col(f"`{c}`") for c in dict.fromkeys((*fields, key, group, text))}
    changed = F.when(tamper(at[key]), F.translate(at[text], CAPITALS, SMALL)).otherwise(at[text])
    leaf, other = (digest(*[field(x if c == text else at[c]) for c in fields]) for x in (at[text], changed))
    # the changed text is hashed only where there is one
    leaves = docs.select(at[key].alias("_key"), at[group].cast("string").alias("_group"), leaf.alias("_digest"), F.when(tamper(at[key]), other).alias("_tampered"))
    leaves = staged(leaves, "merkle-leaves")
    nodes = numbered(leaves, "_group", ["_key", "_digest"], "merkle-order")
    levels, subroots = tree(nodes, ("_key", "_tampered"), fanout, "merkle-tree")
    subroots = staged(subroots, "merkle-subroots")
    listed = numbered(subroots.select(F.col("_group").alias("_name"), "_digest", "_level", F.lit(True).alias("_group")), "_group", ["_name"], "merkle-groups")
    upper, root = tree(listed, ("_name", "_level"), fanout, "merkle-upper")
    root = (root.first() or [None, ""])[1]
    top = docs.sparkSession.range(1).select(F.lit(True).alias("_group"), F.lit(len(upper)).alias("_level"), F.array().cast(PATH).alias("_path"))
    sources = paths(listed, upper, top, ("_name", "_level")).select(F.col("_name").alias("_group"), "_level", "_path", F.col("_digest").alias("subroot"))
    out = paths(nodes, levels, sources, ("_key", "_tampered"))
    back = folded(F.coalesce("_tampered", "_digest"), F.col("_path"))
    out = out.select(F.col("_key").alias(key), F.col("_digest").alias("leaf"), "subroot", F.lit(root).alias("root"), F.col("_path").alias("path"), proof(F.col("_path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""A directed multigraph as an edge table: source, target and any columns that tell parallel edges apart.

Nodes are the ends of edges and those of a table of their own. Walks go by frontiers: one join of the newly reached nodes with the edges a round, what has
been reached before left out, so that rounds grow with the depth and no node's edges meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut

#: Rows of a frontier up to which it is broadcast; a row is a node and its depth.
SMALL = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def nodes(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node): the ends of all edges, and the rows of ``more``; nulls are no nodes."""
    out = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return (out if more is None else out.unionByName(more.select("node"))).where("node is not null").distinct()


def successors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node, successor) of the nodes of a table, once however many edges join the two."""
    return edges.join(of.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select(F.col("source").alias("node"), F.col("target").alias("successor")).where("successor is not null").distinct()


def predecessors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node, predecessor), as ``successors``."""
    turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return successors(turned, of).withColumnRenamed("successor", "predecessor")


def between(edges: DataFrame, source, target) -> DataFrame:
    """All parallel edges of a pair."""
    return edges.where((F.col("source") == source) & (F.col("target") == target))


def levels(edges: DataFrame, starts: DataFrame, target=None) -> DataFrame:
    """(node, depth, parent) of every node that the nodes of ``starts`` reach: fewest edges from any of them, and the smallest node one edge nearer
    (null for starts). With ``target`` the walk ends with the round that reaches it. Loops and parallel edges change nothing; no starts reach nothing."""
    steps = cut(edges.select("source", "target").where("source is not null and target is not null and source <> target").distinct())
    kind = dict(edges.dtypes)["source"]
    front = cut(starts.where("node is not null").select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")).distinct())
    seen, depth = front, 0
    while (rows := front.count()) and (target is None or front.where(F.col("node") == target).isEmpty()):
        depth += 1
        met = steps.join(_small(front.select(F.col("node").alias("source")), rows), "source")
        met = met.groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent")).join(seen.select("node"), "node", "left_anti")
        front = cut(met.select("node", F.lit(depth).alias("depth"), "parent"))
        seen = cut(seen.unionByName(front))
    return seen


def reachable(edges: DataFrame, source, target, more: DataFrame | None = None) -> bool:
    """Whether a directed walk leads from one node to the other; a node reaches itself if it is one."""
    start = nodes(edges, more).where(F.col("node") == source)
    return not levels(edges, start, target).where(F.col("node") == target).isEmpty()


def first_path(edges: DataFrame, source, target, more: DataFrame | None = None) -> DataFrame | None:
    """A shortest walk as (step from 0, the columns of the edges), of parallel edges the first by their other columns; without a row where source is target,
    None where there is none. The walk back asks for one row a step."""
    held = levels(edges, nodes(edges, more).where(F.col("node") == source), target)
    at = held.where(F.col("node") == target).first()
    if at is None:
        return None
    pairs = []
    while at["parent"] is not None:
        pairs.append((at["depth"] - 1, at["parent"], at["node"]))
        at = held.where(F.col("node") == at["parent"]).first()
    kinds = dict(edges.dtypes)
    way = edges.sparkSession.createDataFrame(pairs, f"step int, source {kinds['source']}, target {kinds['target']}")
    others = [c for c in edges.columns if c not in ("source", "target")]
    met = edges.join(F.broadcast(way), ["source", "target"])
    if not others:
        return met.distinct().select("step", "source", "target")
    first = met.groupBy("step", "source", "target").agg(F.min(F.struct(*others)).alias("_first"))
    return first.select("step", "source", "target", *[F.col(f"_first.{c}").alias(c) for c in others])


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges whose ends are both among the nodes of ``keep``, parallel ones all."""
    held = keep.select("node").distinct()
    return edges.join(held.select(F.col("node").alias("source")), "source", "left_semi").join(held.select(F.col("node").alias("target")), "target", "left_semi")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, the columns of the edges, n): edges that one graph has more often than the other, and by how many; side is left or right. Nulls are values."""
    names = left.columns
    both = left.select("*", F.lit(1).alias("_n")).unionByName(right.select(*names, F.lit(-1).alias("_n")))
    out = both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return out.select(F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), *names, F.abs("_n").alias("n"))


def node_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, node): nodes of one graph alone."""
    a, b = nodes(left), nodes(right)
    return a.join(b, "node", "left_anti").select(F.lit("left").alias("side"), "node").unionByName(b.join(a, "node", "left_anti").select(F.lit("right").alias("side"), "node"))


def conflicting(edges: DataFrame, by: str, between: tuple[str, str]) -> DataFrame:
    """(source, target, n of each kind): pairs whose edges say both of two things in the column ``by``."""
    first, second = (F.count_if(F.col(by) == v) for v in between)
    return edges.groupBy("source", "target").agg(first.alias("first"), second.alias("second")).where("first > 0 and second > 0")


def tree(edges: DataFrame, root=None) -> DataFrame:
    """(depth, node, edges): the nodes that ``root``, or every node without a predecessor, reaches, with each one's edges as structs in order; by levels, as a
    reader indents them. A node's edges are one row, as its reader sees them."""
    all_ = nodes(edges)
    starts = all_.where(F.col("node") == root) if root is not None else all_.join(edges.select(F.col("target").alias("node")), "node", "left_anti")
    held = levels(edges, starts)
    out = edges.groupBy(F.col("source").alias("node")).agg(F.sort_array(F.collect_list(F.struct("target", *[c for c in edges.columns if c not in ("source", "target")]))).alias("edges"))
    return held.join(out, "node", "left").select("depth", "node", "edges")


def to_text(rows: DataFrame, most: int = 1_000) -> str:
    """The first ``most`` nodes of ``tree`` as text, by depth and name; for people, so the driver gets no more than that."""
    lines = []
    for r in rows.orderBy("depth", "node").limit(most).collect():
        lines.append("  " * r["depth"] + str(r["node"]))
        lines += ["  " * r["depth"] + "  -> " + " ".join(str(x) for x in e) for e in r["edges"] or ()]
    return "\n".join(lines) or "(empty graph)"

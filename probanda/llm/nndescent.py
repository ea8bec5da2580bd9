"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, greedy search answers queries.

Vectors that are equal are one node. Each node starts with the nearest of those that share a random pivot or a cell dealt by
a hash with it, so that no node is left without a list; then rounds of neighbours of neighbours improve the lists until few
entries change: every node's forward and reverse neighbours meet at it, and each is told of the nearest others there. Rounds
are joins: node lists with vectors, and merges by node. A query walks the
graph from its own node and keeps a beam of the best nodes met; each step joins the beams' best unexpanded nodes with the
graph, for all queries at once. Lists and beams use vectors of one byte a component with a scale; the end of each beam is
measured again in double precision on the original vectors. Links between nodes that a hash deals together join the graph
up, and queries that still end with fewer results than asked for are compared with all nodes, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, small_batches, small_side, staged

#: Length of a node's list; neighbours of each direction that meet in a round; the nearest that each is told of.
NEIGHBOURS, MEET, TOLD = 32, 10, 10
#: Rounds go on until at most this share of all list entries is new.
SETTLED = 0.1
#: Reverse neighbours kept in the graph for the search.
REVERSE = 16
#: Random pivots, which are at least so many and twice the root of the nodes, pivots that each vector goes to, and rows of a pivot that
#: are compared with one another.
PIVOTS, NEAR, CELL = 128, 3, 512
#: Nodes of a beam, nodes expanded a step, and nodes measured again at the end.
BEAM, EXPAND, AGAIN = 320, 48, 64
#: Queries and nodes of a block of the exact pass.
ASKS, BLOCK = 512, 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, no component null or not finite, not all zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _packed(x: np.ndarray) -> list[bytes]:
    """One float32 scale and a byte per component. ``x`` are doubles whose largest is about 1; scales too small for products of floats are raised: such
    vectors are near nothing beside others, and what is near to them doesn't depend on their size."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    codes = np.rint(x / np.maximum(scale, np.finfo(float).tiny)).astype(np.int8)
    return [s + c for s, c in zip(map(bytes, np.maximum(scale, 1e-18).astype(np.float32)), map(bytes, codes), strict=True)]


def _unpacked(column) -> np.ndarray:
    rows = list(column)
    if not rows:
        return np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _groups(batches, key: str):
    """Whole groups of rows of a stream that is sorted by ``key``, many groups at a time."""
    held = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held = pdf.iloc[cut:]
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def _merged(lists: DataFrame, most: int) -> DataFrame:
    """(id, near, sims): per id the ``most`` nearest of all its lists, each node once."""

    def run(batches):
        for pdf in _groups(batches, "id"):
            ids, sims = pdf["near"].to_list(), pdf["sims"].to_list()
            size = np.array([len(x) for x in ids])
            of, near, sim = np.repeat(pdf["id"].to_numpy(), size), np.concatenate(ids).astype(np.int64), np.concatenate(sims)
            order = np.lexsort((near, of))
            of, near, sim = of[order], near[order], sim[order]
            once = np.ones(len(of), bool)
            once[1:] = (of[1:] != of[:-1]) | (near[1:] != near[:-1])
            once &= of != near
            of, near, sim = of[once], near[once], sim[once]
            order = np.lexsort((near, -sim, of))
            of, near, sim = of[order], near[order], sim[order]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, int)
            place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
            of, near, sim = of[place < most], near[place < most], sim[place < most]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, int)
            if len(of):
                yield pd.DataFrame({"id": of[starts], "near": np.split(near, starts[1:]), "sims": np.split(sim, starts[1:])})

    return lists.select("id", "near", "sims").repartition("id").sortWithinPartitions("id").mapInPandas(run, "id long, near array<long>, sims array<float>")


def _tops(ids: np.ndarray, x: np.ndarray, most: int):
    """For each of the rows its nearest others among them."""
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -np.inf
    k = min(most, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, at, 1)
    return [(ids[r][np.isfinite(v)], v[np.isfinite(v)]) for r, v in zip(at, sim, strict=True)]


def _cells(nodes: DataFrame, seed: int = 5) -> DataFrame:
    """First lists: vectors that share one of their nearest random pivots, or the pivot of all, in cells of bounded size."""
    first = nodes.select("vec").first()
    if first is None:
        return nodes.select("id", F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("sims"))
    most = max(PIVOTS, int(2 * nodes.count() ** 0.5))
    pivots = nodes.sparkSession.sparkContext.broadcast(np.random.default_rng(seed).normal(size=(most, len(first[0]) - 4)).astype(np.float32))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                s = _unpacked(pdf["vec"]) @ pivots.value.T
                at = np.argpartition(-s, NEAR, axis=1)[:, :NEAR]
                at = np.column_stack([at, np.full(len(at), most)])  # a pivot of all, so that nobody is alone
                yield pd.DataFrame({"pivot": at.ravel(), "id": np.repeat(pdf["id"].to_numpy(), NEAR + 1), "vec": np.repeat(pdf["vec"].to_numpy(), NEAR + 1)})

    placed = staged(nodes.mapInPandas(assign, "pivot int, id long, vec binary"), "nn-placed")
    # a pivot's rows are dealt by a hash into cells of about CELL rows
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).alias("_g"))
    dealt = placed.join(F.broadcast(sizes), "pivot").withColumn("cell", F.xxhash64("pivot", F.pmod(F.xxhash64("id"), F.col("_g"))))

    def compare(batches):
        for pdf in _groups(batches, "cell"):
            for _, g in pdf.groupby("cell", sort=False):
                if len(g) > 1:
                    ids = g["id"].to_numpy()
                    found = _tops(ids, _unpacked(g["vec"]), NEIGHBOURS)
                    yield pd.DataFrame({"id": ids, "near": [f[0] for f in found], "sims": [f[1] for f in found]})

    lists = dealt.select("cell", "id", "vec").repartition("cell").sortWithinPartitions("cell").mapInPandas(compare, "id long, near array<long>, sims array<float>")
    return _merged(lists, NEIGHBOURS)


def _sampled(edges: DataFrame, by: str, other: str, most: int, salt: int) -> DataFrame:
    """At most ``most`` random rows of each ``by``; rows beyond are dropped before the shuffle already."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64(other, by, F.lit(salt))))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def _round(nodes: DataFrame, lists: DataFrame, salt: int) -> DataFrame:
    """One round: neighbours of both directions meet at each node, and each is told of its nearest there."""
    edges = lists.select("id", F.explode("near").alias("to"))
    ahead = _sampled(edges, "id", "to", MEET, salt).select(F.col("id").alias("at"), F.col("to").alias("id"))
    back = _sampled(edges, "to", "id", MEET, salt).select(F.col("to").alias("at"), "id")
    meet = ahead.unionByName(back).distinct().join(nodes, "id")

    def run(batches):
        for pdf in _groups(batches, "at"):
            at, ids, x = pdf["at"].to_numpy(), pdf["id"].to_numpy(), _unpacked(pdf["vec"])
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            size = np.diff(np.append(starts, len(at)))
            out = []
            for n in np.unique(size[size > 1]):  # groups of one size at once
                rows = starts[size == n][:, None] + np.arange(n)
                for some in np.array_split(rows, max(1, len(rows) // 2000)):
                    y = x[some]
                    s = y @ y.transpose(0, 2, 1)
                    s[:, np.arange(n), np.arange(n)] = -np.inf
                    k = min(TOLD, n - 1)
                    top = np.argpartition(-s, k - 1, axis=2)[:, :, :k] if k < n - 1 else np.argsort(-s, axis=2)[:, :, :k]
                    sim = np.take_along_axis(s, top, 2).reshape(-1, k)
                    near = np.take_along_axis(np.broadcast_to(ids[some][:, None, :], s.shape), top, 2).reshape(-1, k)
                    out.append(pd.DataFrame({"id": ids[some].ravel(), "near": list(near), "sims": list(sim)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    told = meet.repartition("at").sortWithinPartitions("at").mapInPandas(run, "id long, near array<long>, sims array<float>")
    return _merged(lists.unionByName(told), NEIGHBOURS)


def _rings(nodes: DataFrame) -> DataFrame:
    """(id, to): each node's successor in its cell, of two deals by different hashes; cells of two deals overlap at random."""
    cells = max(1, -(-nodes.count() // CELL))
    out = []
    for salt in (1, 2):
        w = W.partitionBy("_cell").orderBy("id")
        dealt = nodes.select("id", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(cells)).alias("_cell"))
        out.append(dealt.select("id", F.coalesce(F.lead("id").over(w), F.first("id").over(w)).alias("to")))
    return out[0].unionByName(out[1]).where("id <> to")


def _changed(before: DataFrame, after: DataFrame) -> float:
    """Share of the list entries that are new."""
    old = before.select("id", F.col("near").alias("_old"))
    new = F.size(F.array_except("near", "_old"))
    gone, entries = after.join(old, "id").agg(F.sum(new), F.sum(F.size("near"))).first()
    return (gone or 0) / max(entries or 0, 1)


def build(vectors: DataFrame, settled: float = SETTLED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, graph) of (vec_id, embedding) rows that take part: members (node, vec_id), nodes (id, embedding, vec), and
    graph (id, near, vecs), where vecs are the packed vectors of the neighbours."""
    classes = staged(vectors.groupBy("embedding").agg(F.min("vec_id").alias("id")), "nn-classes")

    largest = float(classes.agg(F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double")))))).first()[0] or 1.0)

    def pack(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1) / largest if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(x) if len(x) else [], pa.binary())], names=["id", "vec"])

    nodes = staged(classes.select("id", "embedding").mapInArrow(pack, "id long, vec binary"), "nn-nodes")
    lists = staged(_cells(nodes), "nn-lists")
    share, k = 1.0, 0
    while share > settled:
        before, lists = lists, staged(_round(nodes, lists, k), "nn-lists")
        share, k = _changed(before, lists), k + 1
        discard(before)
    edges = lists.select("id", F.explode("near").alias("to"))
    back = _sampled(edges, "to", "id", REVERSE, 99).select(F.col("to").alias("id"), F.col("id").alias("to"))
    both = edges.unionByName(back).unionByName(_rings(nodes)).distinct().join(nodes.select(F.col("id").alias("to"), "vec"), "to")
    graph = staged(both.groupBy("id").agg(F.collect_list(F.struct("to", "vec")).alias("_n")).select("id", F.col("_n.to").alias("near"), F.col("_n.vec").alias("vecs")), "nn-graph")
    return classes, nodes, graph


def _walk(starts: DataFrame, graph: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, near) beams of (query, vec) rows whose query is a node; one join with the graph per step for all queries."""
    state = staged(starts.select("query", "vec", F.array("query").alias("near"), F.array(F.lit(float("inf")).cast("float")).alias("sims"), F.array(F.lit(False)).alias("done")), "nn-beam")

    def extend(batches):
        """Rows (query, ...) of the state and of what the step found, sorted by query: the new state."""
        for pdf in _groups(batches, "query"):
            out = []
            for q, g in pdf.groupby("query", sort=False):
                near, sims, done = (np.concatenate([np.asarray(x) for x in g[c]]) for c in ("near", "sims", "done"))
                order = np.argsort(near, kind="stable")
                near, sims, done = near[order], sims[order], done[order].astype(bool)
                once = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
                near, sims, done = near[once], np.maximum.reduceat(sims, once), np.logical_or.reduceat(done, once)
                top = np.lexsort((near, -sims))[:beam]
                vec = next(v for v in g["vec"] if v is not None)
                out.append((q, vec, near[top], sims[top], done[top]))
            yield pd.DataFrame(out, columns=["query", "vec", "near", "sims", "done"])

    def mark(batches):
        """Take the nodes to expand out of each beam."""
        for pdf in batches:
            out = []
            for q, vec, near, sims, done in zip(*(pdf[c] for c in ("query", "vec", "near", "sims", "done")), strict=True):
                at = np.flatnonzero(~np.asarray(done, bool))[:EXPAND]
                floor = float(sims[-1]) if len(near) >= beam else -np.inf
                out += [(int(near[k]), q, vec, floor) for k in at]
            yield pd.DataFrame(out, columns=["id", "query", "vec", "floor"])

    def reach(batches):
        for pdf in batches:
            out = []
            for near, vecs, query, vec, floor in zip(*(pdf[c] for c in ("near", "vecs", "query", "vec", "floor")), strict=True):
                x = _unpacked(vecs) @ _unpacked([vec])[0]
                fit = x > floor
                if fit.any():
                    out.append((query, np.asarray(near)[fit], x[fit], np.zeros(int(fit.sum()), bool)))
            yield pd.DataFrame(out, columns=["query", "near", "sims", "done"])

    kinds = "query long, vec binary, near array<long>, sims array<float>, done array<boolean>"
    while True:  # a beam's floor only rises, so no node is expanded twice and the walk ends
        front = staged(state.mapInPandas(mark, "id long, query long, vec binary, floor float"), "nn-front")
        n = front.count()
        if not n:
            break
        found = graph.join(small_side(front, n, 250_000), "id").mapInPandas(reach, "query long, near array<long>, sims array<float>, done array<boolean>")
        # expanded nodes come again as done
        expanded = front.groupBy("query").agg(F.collect_list("id").alias("near"))
        expanded = expanded.select("query", "near", F.transform("near", lambda x: F.lit(float("-inf")).cast("float")).alias("sims"), F.transform("near", lambda x: F.lit(True)).alias("done"))
        rows = state.unionByName(found, allowMissingColumns=True).unionByName(expanded, allowMissingColumns=True)
        before, state = state, staged(rows.repartition("query").sortWithinPartitions("query").mapInPandas(extend, kinds), "nn-beam")
        discard(before, front)
    return state


def _exact(short: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(query, near): of each node in ``short`` (query) itself and the ``most`` nearest of all others in ``nodes`` (id, embedding), by
    products of blocks."""

    def blocks(rows: DataFrame, key: str, size: int, names: tuple[str, str]) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // size))))
        held = rows.groupBy(part.alias("_part")).agg(F.collect_list(F.struct(key, "embedding")).alias("_b"))
        return held.select(F.col(f"_b.{key}").alias(names[0]), F.flatten("_b.embedding").alias(names[1]))

    def compare(batches):
        for pdf in batches:
            for asks, x, ids, y in zip(*(pdf[c] for c in ("asks", "x", "ids", "y")), strict=True):
                asks, ids = np.asarray(asks), np.asarray(ids)
                s = np.asarray(x, float).reshape(len(asks), -1) @ np.asarray(y, float).reshape(len(ids), -1).T
                s[asks[:, None] == ids[None, :]] = -np.inf
                k = min(most, len(ids))
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pd.DataFrame({"id": asks, "near": list(ids[top]), "sims": list(np.take_along_axis(s, top, 1).astype(np.float32))})

    asked = nodes.join(short.select(F.col("query").alias("id")), "id", "left_semi").select(F.col("id").alias("query"), "embedding")
    left = staged(blocks(asked, "query", ASKS, ("asks", "x")), "nn-short")
    right = staged(blocks(nodes, "id", BLOCK, ("ids", "y")), "nn-blocks")
    pairs = right.repartition(64).crossJoin(left)
    tops = _merged(pairs.mapInPandas(compare, "id long, near array<long>, sims array<float>"), most)
    return tops.select(F.col("id").alias("query"), F.explode("near").alias("near")).unionByName(short.select("query", F.col("query").alias("near")))


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``queries`` holds its ``k`` nearest found among all others.

    Nearness is the inner product in double precision; ties go to the smaller id. With fewer than ``k`` others all are
    given; a query never has fewer than ``k`` otherwise, as those that the graph leaves short get an exact pass. Vectors that are null
    or zero or hold null or non-finite components take no part; a shorter vector counts as followed by zeros. Equal vectors share a node and are listed one by one. Rows that repeat an id with one vector count once. An
    empty table gives an empty result; other columns are not read, so extra columns cannot clash.
    """
    small_batches(vectors.sparkSession)
    held = F.col(f"`{vector}`")
    if vectors.select(held).schema[0].dataType.simpleString() not in ("array<float>", "array<double>"):
        held = held.cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), held.alias("embedding"), queries.alias("_asks")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    least, most = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        zeros = F.array_repeat(F.lit(0), F.lit(most) - F.size("embedding")).cast(rows.schema["embedding"].dataType)
        rows = rows.withColumn("embedding", F.concat("embedding", zeros))
    rows = rows.dropDuplicates(["vec_id", "embedding"])
    classes, nodes, graph = build(rows.select("vec_id", "embedding"))
    member = rows.join(classes, "embedding").select("vec_id", F.col("id").alias("node"), "_asks")
    member = staged(member, "nn-members")
    asked = member.where("_asks").select("node").distinct()
    starts = nodes.join(asked, nodes["id"] == asked["node"], "left_semi").select(F.col("id").alias("query"), "vec")
    beams = _walk(starts, graph)
    # of each node only the k + 1 smallest ids can be among k nearest
    few = member.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("_n") <= k + 1).select(F.col("node").alias("near"), "vec_id")
    again = max(AGAIN, k + 1)
    ends = beams.select("query", F.explode(F.slice("near", 1, again)).alias("near"))
    exact = classes.select(F.col("id").alias("near"), F.col("embedding").alias("y"))
    asks = classes.select(F.col("id").alias("query"), F.col("embedding").alias("x"))
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def measured(ends: DataFrame) -> DataFrame:
        # k + 1 nearest nodes hold k nearest rows, as the query's own row doesn't count
        scored = ends.join(asks, "query").join(exact, "near").select("query", "near", product.alias("score"))
        scored = scored.join(few, "near").select("query", "vec_id", "score")
        best = scored.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
        return staged(best.select("query", "vec_id", "score"), "nn-best")

    best = measured(ends)
    found = best.groupBy("query").count().where(F.col("count") > k)
    short = staged(starts.select("query").join(found, "query", "left_anti"), "nn-short")
    if not short.isEmpty():
        best = best.join(short, "query", "left_anti").unionByName(measured(_exact(short, classes, again)))
    asked = member.where("_asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    out = asked.join(best, "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

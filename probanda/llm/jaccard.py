"""Exact Jaccard self-join on word n-grams by multiple-global-order filtering.

Two sets with a Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 of each, under any order
of all tokens. The join uses several orders at once: each puts frequent tokens last and deals the others by its own hash.
Pairs are found by a shared prefix token under the first order, and stay candidates only if they share one under every
other order too. Then come a bound on the symmetric difference from parity bitmaps and the count over whole sets. Equal
sets are one node from the start, so copies cost nothing but their row.

Tokens of a few documents give all their pairs. Among the documents of a token of many only a spanning forest of the
candidate pairs is sent on, best pairs first; pairs that fail the count are noted, and what they leave undecided is tried
again, so no link is lost and no large group is expanded into all its pairs. A pair is made under its smallest common token alone, as far as
documents tell theirs, so links cost no row for each token that they share. The documents of a token are dealt into blocks
by size class, of which only neighbouring ones can link, and by a hash. Each block meets the next one of a ring first; after
that only pairs of blocks that don't share one component already are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, most_frequent, shingle_sets, slices, small_batches, small_side, staged, text_buffers, word_hashes
from .components import components

#: Token orders whose filters are intersected.
ORDERS = 3
#: At most so many of the most frequent tokens have a rank of their own in the orders; others count as rare. Ranks change speed alone.
RANKED = 262_144
#: Rows of one Arrow batch that a token must have to be reported as frequent.
LEAST_ROWS = 3
#: Rows that a task describes at once.
ROWS = 2500
#: Documents of one prefix token up to which all its pairs are made at once; of larger ones a forest at first, and then so many
#: pairs of a document in a round as join it to other components.
FEW, EACH = 24, 128
#: Such pairs of a document in the first of these rounds, eight times as many in each next one: what these link needs no more pairs.
FIRST = 4
#: Documents of one prefix token and size class that are compared in one block.
BLOCK = 1024
#: Of so many of its smallest tokens of many each document tells the others, so that a pair is made for its smallest common token alone.
TOLD = 16
#: The turn that compares all blocks: the first goes along rings of blocks, later ones settle what failed.
FULL = 1
#: Bits of a token's place among the ranked ones in its order key, below its count.
PLACE_BITS = 20
_SEEDS = [np.uint64(0x5851F42D4C957F2D * (2 * k + 1) % (1 << 64)) for k in range(8)]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(batch: pa.RecordBatch, text: str, width: int):
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    for first, last in slices(offsets):
        yield from shingle_sets(*word_hashes(data, offsets[first : last + 1]), width)


def _parts(batches):
    """Arrow batches in parts of ROWS rows, which bounds what a task holds."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def frequent_tokens(docs: DataFrame, text: str, width: int, most: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all documents, sorted, and their counts. Counts are made in each batch and summed."""

    def count(batches):
        for batch in batches:
            found = [s for s in _sets(batch, text, width) if len(s)]
            if found:
                tokens = np.concatenate(found)
                del found
                tokens.sort()
                starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                n = np.diff(np.append(starts, len(tokens)))
                held = n >= LEAST_ROWS
                yield pa.RecordBatch.from_pydict({"token": tokens[starts[held]].view(np.int64), "n": n[held].astype(np.int64)})

    counted = docs.select(F.col(f"`{text}`").alias(text)).mapInArrow(count, "token long, n long")
    top = most_frequent(staged(counted.groupBy("token").agg(F.sum("n").alias("n")), "jaccard-frequent"), most)
    tokens, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by = np.argsort(tokens)
    return tokens[by], n[by]


def _prefix(tokens: np.ndarray, order: int, percent: int, ranked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of a set under one order: those of few documents as far as is known, and those of many."""
    key = mix(tokens ^ _SEEDS[order]) >> np.uint64(1)
    hot = np.zeros(len(tokens), bool)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, tokens), len(ranked) - 1)
        hot = ranked[at] == tokens
        key[hot] = (np.uint64(1) << np.uint64(63)) + (counts[at[hot]].astype(np.uint64) << np.uint64(PLACE_BITS)) + at[hot].astype(np.uint64)
    p = prefix_length(len(tokens), percent)
    first = np.argpartition(key, p - 1)[:p]
    tokens = tokens[first]
    if not hot[first].any():
        return tokens, tokens[:0]
    many = hot[first] & (counts[at[first]] > FEW)
    return tokens[~many], tokens[many]


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each different set (but for a chance of about 2**-64 a pair); 0 for empty ones."""
    with np.errstate(over="ignore"):
        out = np.array([mix(s ^ _SEEDS[5]).sum(dtype=np.uint64) ^ mix(mix(s ^ _SEEDS[6]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0] if len(s) else 0 for s in sets], np.uint64)
        return np.where(out == 0, out, mix(out)).view(np.int64)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)))


def parity_bits(tokens: np.ndarray) -> bytes:
    """Per bit, whether an odd number of tokens falls on it. Two such maps differ in at most as many bits as the sets in tokens."""
    size = max(256, 1 << int(len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens ^ _SEEDS[7]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _few_and_many(postings: DataFrame, percent: int) -> DataFrame:
    """From (token, id, n): pairs (token null, id, other) of the tokens of few rows, sizes apart no further than links allow; and
    (token, id, other null) of those of many. Rows are sorted by token in each partition and read as a stream."""

    def close(t, i, n):
        """Of whole groups."""
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(start, len(t)))
        each = np.repeat(size, size)
        many = each > FEW
        tokens, ids, others = [t[many]], [i[many]], [np.zeros(int(many.sum()), np.int64)]
        left = np.flatnonzero(~many & (each > 1))
        t, i, n = t[left], i[left], n[left]
        for d in range(1, FEW):
            at = np.flatnonzero(t[d:] == t[:-d]) if len(t) > d else np.empty(0, int)
            if not len(at):
                break
            a, b = i[at], i[at + d]
            low, high = np.minimum(n[at], n[at + d]), np.maximum(n[at], n[at + d])
            fit = (100 * low >= percent * high) & (a != b)
            tokens.append(np.zeros(int(fit.sum()), np.int64))
            ids.append(np.minimum(a, b)[fit])
            others.append(np.maximum(a, b)[fit])
        kinds = np.concatenate([np.full(len(x), k > 0) for k, x in enumerate(ids)])
        table = pa.table({"pair": kinds, "token": np.concatenate(tokens), "id": np.concatenate(ids), "other": np.concatenate(others)})
        pairs = table.filter(table["pair"]).group_by(["pair", "token", "id", "other"]).aggregate([])  # once per batch
        for x in (table.filter(pa.array(~kinds)), pairs):
            yield from x.combine_chunks().to_batches()

    def run(batches):
        held = [np.empty(0, np.int64)] * 3  # rows of the last token, of which more may come
        for batch in batches:
            t, i, n = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1])) if t[0] != t[-1] else 0
            if cut:
                yield from close(t[:cut], i[:cut], n[:cut])
            t, i, n = t[cut:], i[cut:], n[cut:]
            if len(t) > 64 * FEW:  # surely of many: let all but FEW + 1 go on, the rest still counts as many
                keep = len(t) - FEW - 1
                yield pa.RecordBatch.from_pydict({"pair": np.zeros(keep, bool), "token": t[:keep], "id": i[:keep], "other": np.zeros(keep, np.int64)})
                t, i, n = t[keep:], i[keep:], n[keep:]
            held = [t, i, n]
        if len(held[0]):
            yield from close(*held)

    sorted_ = postings.repartition("token").sortWithinPartitions("token")
    return sorted_.mapInArrow(run, "pair boolean, token long, id long, other long")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits.reshape(2, -1)
        bits = bits[0] ^ bits[1]
    return bits


def _forest(group: pd.DataFrame, percent: int, later: int = 0) -> list[tuple[int, int]]:
    """Candidate pairs among the rows of one token that are in different components, best first: a spanning forest, or up to
    ``later`` of each row."""
    group = group.sort_values(["n", "id"], kind="stable")
    ids, n, label = group["id"].to_numpy(np.int64), group["n"].to_numpy(np.int64), group["component"].to_numpy(np.int64).copy()
    if (label == label[0]).all():
        return []
    own, split = group["own"].to_numpy(), bool((group["b1"] != group["b2"]).any())
    bits = [np.frombuffer(b, np.uint8) for b in group["bits"]]
    width = np.array([len(b) for b in bits])
    plain = {w: np.stack([bits[k] for k in np.flatnonzero(width == w)]) for w in np.unique(width)}
    folded = {w: np.stack([_fold(bits[k], w // 2) for k in np.flatnonzero(width == w)]) for w in plain if w // 2 in plain}
    place = {w: np.flatnonzero(width == w) for w in plain}
    failed = {k: frozenset(map(int, x)) for k, x in enumerate(group["failed"]) if x is not None and len(x)}
    # tokens below this one that a document has; pairs that share one of them are made there
    token = int(group["token"].iloc[0])
    below = [x[x < token] for x in group["low"]]
    lower = np.full((len(below), max(map(len, below), default=0)), np.iinfo(np.int64).max)
    for k, x in enumerate(below):
        lower[k, : len(x)] = x
    out = []
    for i in range(len(ids) - 1):
        last = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
        if last <= i + 1 or (label[i + 1 : last] == label[i]).all():
            continue
        js, gaps = [], []
        for w, table in ((width[i], plain), (2 * width[i], folded)):
            if w in table:
                at = place[w]
                a, b = np.searchsorted(at, i + 1), np.searchsorted(at, last)
                if a < b:
                    js.append(at[a:b])
                    gaps.append(np.bitwise_count(table[w][a:b] ^ bits[i]).sum(1, dtype=np.int64))
        if not js:
            continue
        js, gaps = np.concatenate(js), np.concatenate(gaps)
        # |x & y| >= t |x or y| holds just where the difference is at most (1 - t) / (1 + t) of both sizes
        slack = (100 - percent) * (n[i] + n[js]) - (100 + percent) * gaps
        fit = (slack >= 0) & (label[js] != label[i])
        if split:
            fit &= own[js] != own[i]
        js = js[fit][np.argsort(-slack[fit], kind="stable")]
        if len(below[i]) and len(js):
            js = js[~np.isin(lower[js], below[i]).any(1)]
        if i in failed:
            js = js[~np.isin(ids[js], list(failed[i]))]
        if later:
            out += [(int(ids[i]), int(ids[j])) for j in js[:later]]
            continue
        while len(js):
            j = js[0]
            out.append((int(ids[i]), int(ids[j])))
            label[label == label[j]] = label[i]
            js = js[label[js] != label[i]]
    return out


def _meet(x: bytes, y: bytes) -> bool:
    return not frozenset(np.frombuffer(x, np.uint16).tolist()).isdisjoint(np.frombuffer(y, np.uint16).tolist())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _filtered(pairs: DataFrame, about: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) that pass the bitmap bound and then share a prefix token under every further order. Bitmaps alone are
    shuffled for all pairs; the longer prefixes follow for those that pass."""

    def kept(pairs: DataFrame, names: list[str], run) -> DataFrame:
        own = about.select("id", *names).join(small_side(_ends(pairs), pairs.count(), 500_000), "id", "left_semi")
        sides = [own.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").mapInPandas(run, "a long, b long")

    def near(batches):
        for pdf in batches:
            keep = []
            for r in pdf.itertuples(index=False):
                x, y = np.frombuffer(r.bits_a, np.uint8), np.frombuffer(r.bits_b, np.uint8)
                size = min(len(x), len(y))
                gap = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum(dtype=np.int64))
                keep.append((100 - percent) * (r.n_a + r.n_b) >= (100 + percent) * gap)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    def meet(batches):
        for pdf in batches:
            keep = [all(_meet(getattr(r, f"short{k}_a"), getattr(r, f"short{k}_b")) for k in range(1, orders)) for r in pdf.itertuples(index=False)]
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    passed = staged(kept(pairs, ["n", "bits"], near).distinct(), "jaccard-near")
    return kept(passed, [f"short{k}" for k in range(1, orders)], meet).distinct()


def _candidates(dealt: DataFrame, percent: int, later: int) -> DataFrame:
    """(a, b) from rows (token, b1, b2, own, id, n, bits, low, component, failed) of tokens of many documents."""

    def pair(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["token", "b1", "b2"]].to_numpy()
            found, first = [], 0
            for last in np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1:
                if last - first > 1:
                    found += _forest(pdf.iloc[first:last], percent, later)
                first = last
            held = pdf.iloc[first:]
            yield pd.DataFrame(sorted({(min(p), max(p)) for p in found}), columns=["a", "b"], dtype="int64")
        if held is not None and len(held) > 1:
            found = _forest(held, percent, later)
            yield pd.DataFrame(sorted({(min(p), max(p)) for p in found}), columns=["a", "b"], dtype="int64")

    sorted_ = dealt.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")
    return sorted_.mapInPandas(pair, "a long, b long").where("a <> b").distinct()


def _between(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of components (a, b) that pairs of documents join."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("component").alias("_ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("_cb"))
    both = pairs.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b"))
    return both.where("a <> b").distinct()


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after more links: only the components that the new links join are walked again."""
    if labels is None:
        return staged(components(links), "jaccard-labels")
    moved = staged(components(_between(labels, links)), "jaccard-moved").select(F.col("id").alias("_old"), F.col("component").alias("_new"))
    known = labels.select("id", F.col("component").alias("_at"))
    alone = moved.select(F.col("_old").alias("id"), F.col("_old").alias("_at")).join(known.select("id"), "id", "left_anti")
    out = known.unionByName(alone).join(moved, F.col("_at") == F.col("_old"), "left")
    return staged(out.select("id", F.coalesce("_new", "_at").alias("component")), "jaccard-labels")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, orders: int = ORDERS) -> DataFrame:
    """Per document: ``key``, n_shingles (size of its set of ``width``-word shingles) and component_id (smallest key reachable by links).

    Words are runs other than space and U+0009 to U+000D, with A-Z in lower case; with fewer than ``width`` words the whole
    sequence is the one shingle. Null, empty and blank texts have an empty set and are linked with nothing, so each is its
    own component. Two documents link when 100 |x & y| >= ``percent`` |x or y|. Repeated rows each give a row, which follows
    its own text, so two texts under one key have each their own links; a null key gets no links and a null component. An empty
    table gives an empty one. Columns other than key and text are not read, so extra columns cannot clash.
    """
    return _linked(docs, key, text, width, percent, orders).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _linked(docs: DataFrame, key: str, text: str, width: int, percent: int, orders: int = ORDERS) -> DataFrame:
    """(id, n, node, label, component_id) of every row; rows with equal sets have one node."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    ranked, counts = frequent_tokens(rows, "text", width)
    shared = spark.sparkContext.broadcast((ranked, counts))

    def describe(batches):
        for batch in _parts(batches):
            sets = list(_sets(batch, "text", width))
            rare, hot = zip(*[_prefix(s, 0, percent, *shared.value) if len(s) else (s, s) for s in sets], strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(_nodes(sets)), _longs(list(rare)), _longs(list(hot))], names=["row", "id", "n", "node", "rare0", "hot0"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    table = staged(numbered.mapInArrow(describe, "row long, id long, n long, node long, rare0 array<long>, hot0 array<long>"), "jaccard-docs")
    usable = table.where("n > 0 and id is not null")
    classes = staged(usable.groupBy("node").agg(F.min("id").alias("rep"), F.min("row").alias("_first"), F.count(F.lit(1)).alias("_copies")), "jaccard-classes")
    several = classes.where("_copies > 1").select("node", "_first")
    copies = staged(usable.select("row", "node").join(several, "node").where("row <> _first").select("row"), "jaccard-copies")
    reps = usable.join(small_side(copies, copies.count()), "row", "left_anti").select(F.col("node").alias("id"), "n", "rare0", "hot0")
    postings = reps.select(F.explode("rare0").alias("token"), "id", "n")
    met = staged(_few_and_many(postings, percent), "jaccard-met")
    few = staged(met.where("pair").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "jaccard-few")
    many = met.where("not pair").select("token", "id").unionByName(reps.select(F.explode("hot0").alias("token"), "id"))

    # bitmaps and the other orders' prefixes are made for those alone that met another, whole sets for those whose pairs pass both
    named = staged(_ends(few).unionByName(many.select("id")).distinct(), "jaccard-named")
    if named.isEmpty():
        return _in_classes(table, classes, None)

    def again(nodes: DataFrame, run, kinds: str, name: str) -> DataFrame:
        """What ``run`` makes of the texts of these nodes, once for each."""
        count = nodes.count()
        ids = classes.join(small_side(nodes, count), classes["node"] == nodes["id"], "left_semi").select(F.col("rep").alias("id")).distinct()
        made = rows.join(small_side(ids, count), "id", "left_semi").mapInArrow(run, kinds).join(small_side(nodes, count), "id", "left_semi")
        made = staged(made, name)
        return made if made.count() == count else staged(made.dropDuplicates(["id"]), name)  # rows repeat, or other texts share their key

    def more(batches):
        short = lambda tokens: (mix(tokens) >> np.uint64(48)).astype(np.uint16).tobytes()
        for batch in _parts(batches):
            sets = [s for s in _sets(batch, "text", width) if len(s)]
            columns, names = [pa.array(_nodes(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_bits(s) for s in sets], pa.binary())], ["id", "n", "bits"]
            for order in range(1, orders):
                columns.append(pa.array([short(np.concatenate(_prefix(s, order, percent, *shared.value))) for s in sets], pa.binary()))
                names.append(f"short{order}")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "id long, n long, bits binary" + "".join(f", short{k} binary" for k in range(1, orders))
    about = again(named, more, kinds, "jaccard-about")

    def whole(batches):
        for batch in _parts(batches):
            sets = [s for s in _sets(batch, "text", width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets)), _longs(sets)], names=["id", "members"])

    # sizes that differ by a class or less may link; the classes are a little wider than that, for rounding
    size_class = F.floor(F.log("n") / F.lit(1.0001 * float(np.log(100 / percent)))).cast("int") if percent < 100 else F.col("n").cast("int")
    many = many.join(many.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("token"), "token")
    placed = many.join(about.select("id", "n", "bits"), "id").withColumn("size", size_class)
    groups = many.join(about.select("id", "n"), "id").withColumn("size", size_class).groupBy("token", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_g"))
    placed = placed.join(groups, ["token", "size"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int"))
    # at first each document takes part in one token alone, so that a family of copies gives one forest and not one per token
    least = many.groupBy(F.col("id").alias("_id")).agg(F.slice(F.array_sort(F.collect_set("token")), 1, TOLD).alias("low"))
    placed = placed.join(least, F.col("id") == F.col("_id")).withColumn("once", F.col("token") == F.col("low")[0])
    placed = staged(placed.select("token", "size", "own", "_g", "id", "n", "bits", "low", "once"), "jaccard-placed")
    members = staged(placed.select("id").distinct(), "jaccard-members")
    none = F.array().cast("array<long>")

    def facing(state: DataFrame | None, turn: int) -> DataFrame:
        """(token, b1, b2, own, id, n, bits, low, component, failed): the rows of the pairs of blocks that a turn compares."""
        names = ["token", "b1", "b2", "own", "id", "n", "bits", "low", "component", "failed"]
        held = placed if turn >= FULL else placed.where("once")
        held = held.withColumn("block", F.concat_ws("/", "size", "own"))
        if not turn:
            # block k meets block k + 1 under the name of block k
            before = F.pmod(F.col("own") - F.lit(1), F.col("_g"))
            held = held.withColumn("b1", F.explode(F.when(F.col("_g") > 2, F.array("own", before)).otherwise(F.array(F.lit(0))))).withColumn("b1", F.concat_ws("/", "size", "b1"))
            return held.select("token", "b1", F.col("b1").alias("b2"), "own", "id", "n", "bits", "low", F.col("id").alias("component"), none.alias("failed"))
        held = held.join(small_side(state, state.count(), 200_000), "id")
        blocks = staged(held.groupBy("token", "size", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")), "jaccard-blocks")
        x, y = (blocks.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("size", "block", "lo", "hi", "rows")]) for k in (1, 2))
        apart = (F.least("lo1", "lo2") < F.greatest("hi1", "hi2")) & ((F.col("block1") != F.col("block2")) | (F.col("rows1") > 1))
        meets = x.join(y, "token").where(((F.col("size1") == F.col("size2")) & (F.col("block1") <= F.col("block2")) | (F.col("size1") + 1 == F.col("size2"))) & apart)
        sides = meets.select("token", F.col("block1").alias("b1"), F.col("block2").alias("b2"), F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
        return held.join(sides, ["token", "block"]).withColumn("own", F.xxhash64("block")).select(*names)

    def counted_pairs(pairs: DataFrame) -> DataFrame:
        sets = again(_ends(pairs), whole, "id long, members array<long>", "jaccard-sets")
        a, b = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        fits = pairs.join(a, "a").join(b, "b").select("a", "b", (100 * both >= percent * (F.size("x") + F.size("y") - both)).alias("fits"))
        out = staged(fits, "jaccard-counted")
        discard(sets)
        return out

    labels = failures = state = None
    turn = 0
    while True:
        pairs = _candidates(facing(state, turn), percent, min(EACH, FIRST * 8 ** (turn - FULL - 1)) if turn > FULL else 0).withColumn("many", F.lit(True))
        if not turn:
            pairs = pairs.unionByName(few.withColumn("many", F.lit(False))).groupBy("a", "b").agg(F.max("many").alias("many"))
        pairs = staged(pairs, "jaccard-pairs")
        if turn > FULL and pairs.isEmpty():
            break
        counted = counted_pairs(staged(_filtered(pairs.select("a", "b"), about, percent, orders), "jaccard-filtered"))
        new = counted.where("fits").select("a", "b")
        failed = staged(pairs.where("many").join(new, ["a", "b"], "left_anti").select("a", "b"), "jaccard-failed")
        before, failures = failures, failed if failures is None else staged(failures.unionByName(failed), "jaccard-failures")
        held, labels = labels, _relabelled(labels, new)
        discard(before, held, state, pairs, counted)
        turn += 1
        if turn == FULL + 1 and failed.isEmpty():
            break
        ids = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if turn > FULL:
            # undecided: components that failed pairs would have held together
            bridges = _between(labels, failures)
            undecided = bridges.select(F.col("a").alias("_open")).unionByName(bridges.select(F.col("b").alias("_open"))).distinct()
            ids = ids.join(undecided, F.col("component") == F.col("_open"), "left_semi")
        noted = failures.select(F.col("a").alias("id"), F.col("b").alias("x")).unionByName(failures.select(F.col("b").alias("id"), F.col("a").alias("x"))).groupBy("id").agg(F.collect_set("x").alias("failed"))
        state = staged(ids.join(noted, "id", "left").select("id", "component", F.coalesce("failed", none).alias("failed")), "jaccard-state")
    return _in_classes(table, classes, labels)


def _in_classes(table: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(id, n, node, label, component_id) from the rows, the classes of equal sets and the labels of linked nodes. The component of a
    node is the smallest key of all rows that its links reach; its label tells components apart that share such a key."""
    belongs = classes.select(F.col("node").alias("_node"), F.col("node").alias("label"), F.col("rep").alias("component_id"))
    if labels is not None:
        known = classes.select("node", "rep").join(labels, classes["node"] == labels["id"])
        least = known.groupBy("component").agg(F.min("rep").alias("_least"))
        known = known.join(least, "component").select(F.col("node").alias("_known"), F.col("component").alias("_label"), "_least")
        belongs = belongs.join(known, F.col("_node") == F.col("_known"), "left").select("_node", F.coalesce("_label", "label").alias("label"), F.coalesce("_least", "component_id").alias("component_id"))
    out = table.select("id", "n", "node").join(belongs, (F.col("node") == F.col("_node")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select("id", "n", "node", "label", F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose text is linked to none under a smaller key, all columns kept.

    Of rows with one key that are linked with one another, that with the first text in byte order stays; rows with one key that are not
    linked all stay. Texts without words and rows without a key stay. Only rows of repeated keys are shuffled with their texts.
    """
    found = staged(_linked(docs, key, text, width, percent), "jaccard-linked")
    keyed = found.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max((F.col("component_id") == F.col("id")).cast("int")).alias("stays"))
    keyed = staged(keyed.where("rows > 1 or stays = 0"), "jaccard-keyed")
    several, gone = keyed.where("rows > 1").select(F.col("id").alias("_id")), keyed.where("rows = 1").select(F.col("id").alias("_id"))
    repeated = several.count()
    same = F.col(f"`{key}`").cast("long") == F.col("_id")
    kept = docs.join(small_side(gone, gone.count()), same, "left_anti")
    if not repeated:
        return kept
    several = small_side(several, repeated)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def mark(batches):
        for batch in _parts(batches):
            sets = list(_sets(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"]), "text", width))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, names=batch.schema.names), pa.array(_nodes(sets))], names=["_row", "_node"])

    marked = docs.join(several, same, "left_semi").mapInArrow(mark, f"_row struct<{kinds.replace('` ', '`:')}>, _node long")
    worded = marked.where("_node <> 0").join(found.where("label is not null").select(F.col("node").alias("_n"), "label", F.col("component_id").alias("_component")).distinct(), F.col("_node") == F.col("_n"))
    own = F.col("_row")[key]
    worded = worded.where(own.cast("long") == F.col("_component")).groupBy(own.alias("_own"), "label").agg(F.min_by("_row", F.struct(F.col("_row")[text], F.to_json("_row"))).alias("_row"))
    chosen = worded.select("_row").unionByName(marked.where("_node = 0").select("_row"))
    return kept.join(several, same, "left_anti").unionByName(chosen.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))

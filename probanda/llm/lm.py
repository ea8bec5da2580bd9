"""Language-model scores of whole texts: an add-one unigram base and a log-bilinear model with normalised probabilities.

Word counts are made in each batch and summed by a shuffle over all training words. The most frequent words are broadcast
with their counts and vectors (a bounded table); the others of each document meet the count table in a join, so no vocabulary
has to fit anywhere. The log-bilinear model predicts a word from the two before it. Each word of the table has a vector of its
own, as context and as target; the words outside share one, and among them a word has its add-one share. Probabilities are
normalised exactly in two steps, both batched matrix products: the class given the context, then the word within its class.
Classes are runs of words of like frequency, and their number grows with the root of the vocabulary. Class sums are computed once
for each context of a batch.

The model learns by noise-contrastive estimation in numpy on every training token: texts become chunks of word numbers, equal
chunks are counted, and a hash deals them to groups of bounded size, each learned by one task. Groups return the rows that they
changed, and one aggregation by row averages these, so neither a group nor the driver holds more than one set of parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, most_frequent, slices, small_batches, staged, text_buffers, word_hashes

#: Words in the broadcast table, all with vectors of their own: at most 16 MB with the vectors.
FREQUENT = 131_072
#: Size of word vectors, rounds that share out the chunks, tokens of a step, noise classes of a step, and step size.
VECTOR, ROUNDS, STEP_ROWS, NOISE, RATE = 24, 2, 4096, 48, 0.1
#: Tokens of a chunk, chunks that are mixed before steps are taken, tokens of a training group, and partitions of a round at most.
CHUNK, MIXED, GROUP_TOKENS, PARTITIONS = 512, 128, 1 << 22, 1 << 14
#: Scores held at a time while normalising, and bytes of text that are scored at once.
CELLS, SCORE_BYTES = 1 << 18, 1 << 20
END = np.uint64(1)
FOLDS, HELD = 7, 2


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of the key as text leaves 2 when divided by 7."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD, F.lit(False))


def _token_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """(hashes of all tokens with each text's end, start of each text, texts) by slices of the batch."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    for first, last in slices(offsets, most):
        words, bounds = word_hashes(data, offsets[first : last + 1])
        rows = last - first
        tokens = np.full(len(words) + rows, END, np.uint64)
        of = np.repeat(np.arange(rows), np.diff(bounds))
        tokens[np.arange(len(words)) + of] = words
        yield tokens, bounds[:-1] + np.arange(rows), rows


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all tokens; a word is given by its hash."""

    def count(batches):
        for batch in batches:
            found = [t for t, _, _ in _token_slices(batch, text)]
            if found:
                words, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n.astype(np.int64)})

    return docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_edges(counts: np.ndarray) -> np.ndarray:
    """First word of each class and the end, for words in order of falling count: about the root of their number, with equal
    sums of roots of counts, so that frequent words are in small classes and no class has much over twice the mean size."""
    if not len(counts):
        return np.zeros(1, np.int64)
    mass = np.sqrt(counts)
    k = int(np.ceil(np.sqrt(len(counts))))
    of = np.floor((np.cumsum(mass) - mass / 2) * (k / mass.sum()))
    return np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(counts)]])


@dataclass
class Model:
    """Counts of the training tokens and the parameters of the log-bilinear model.

    Word numbers go by falling count; ``rest`` is the number of all words outside the table, in a class of its own, and the next number
    stands for the place before a text. ``p`` has a row for each of these, then for each class, then the two matrices that take a
    context word to the prediction, from one and from two words back; its last column has the biases of words and classes.
    """

    tokens: int  # N
    distinct: int  # V
    words: np.ndarray  # words of the table, sorted
    counts: np.ndarray
    number: np.ndarray  # number of each word of the table
    edges: np.ndarray  # first number of each class, and the end
    rest_tokens: int
    rest_distinct: int
    p: np.ndarray

    @property
    def rest(self) -> int:
        return len(self.words)

    def lookup(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether in the table, count, number) of tokens."""
        if not len(self.words):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64), np.full(len(tokens), self.rest)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        known = self.words[at] == tokens
        return known, np.where(known, self.counts[at], 0), np.where(known, self.number[at], self.rest)

    def log_probabilities(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each word number after those two and one before it. Equal cases are computed once, classes once for each
        context, words class by class."""
        code, back = np.unique((two << 36) | (one << 18) | word, return_inverse=True)
        new = np.diff(code >> 18, prepend=-1) != 0
        word, context, at = code & 0x3FFFF, np.cumsum(new) - 1, code[new]
        k, base = len(self.edges) - 1, self.rest + 2
        near, far = self.p[base + k : base + k + VECTOR, :VECTOR], self.p[base + k + VECTOR :, :VECTOR]
        h = np.ones((len(at), VECTOR + 1), np.float32)
        h[:, :VECTOR] = self.p.take(at >> 18 & 0x3FFFF, axis=0)[:, :VECTOR] @ near + self.p.take(at >> 36, axis=0)[:, :VECTOR] @ far
        of = np.searchsorted(self.edges, word, "right") - 1
        out = _dots(h.take(context, axis=0), self.p.take(base + of, axis=0)) - _log_sums(h, self.p[base : base + k])[context]
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(k + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            a, b = int(self.edges[c]), int(self.edges[c + 1])
            if b - a > 1:
                at = order[bounds[c] : bounds[c + 1]]
                held = h.take(context[at], axis=0)
                out[at] += _dots(held, self.p.take(word[at], axis=0)) - _log_sums(held, self.p[a:b])
        return out[back] / np.log(10)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row."""
    return np.einsum("ij,ij->i", a, b)


def _log_sums(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Natural log of the sum of exponentials of the inner products of each row of ``h`` with all rows of ``to``, in double precision."""
    out = np.empty(len(h))
    rows, ones = max(1, CELLS // len(to)), np.ones(len(to), np.float32)
    for first in range(0, len(h), rows):
        logits = h[first : first + rows] @ to.T
        with np.errstate(over="ignore", divide="ignore"):
            total = np.exp(logits) @ ones
            part = out[first : first + rows]
            np.log(total, out=part)
        beyond = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # exponentials left the range of single precision
        if len(beyond):
            top = logits[beyond].max(1, keepdims=True)
            part[beyond] = top[:, 0] + np.log(np.exp(logits[beyond] - top).sum(1))
    return out


def contexts(numbers: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers two back and one back; ``begin`` before the start of a text."""
    one, two = np.full(len(numbers), begin), np.full(len(numbers), begin)
    one[1:], two[2:] = numbers[:-1], numbers[:-2]
    one[starts] = begin
    two[starts] = begin
    two[starts[starts + 1 < len(two)] + 1] = begin
    return two, one


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nce_step(p, sums, touched, edges, log_q, two, one, word, weight, noise, draw) -> None:
    """One Adagrad step of noise-contrastive estimation on weighted trigrams, for classes and for words within their class.

    ``noise`` classes are shared by the step and drawn by frequency, whose logs are ``log_q``; ``draw`` has a uniform number for each
    token that picks its noise word evenly within its class. Only rows that take part are read and changed; ``touched`` adds up the
    weight that went into each.
    """
    d, m, k, base = VECTOR, len(word), len(edges) - 1, edges[-1] + 1
    of = np.searchsorted(edges, word, "right") - 1
    size = edges[of + 1] - edges[of]
    other = edges[of] + (draw * size).astype(np.int64)
    rows = np.concatenate([word, other, base + of, one, two, base + noise])
    held = p.take(rows, axis=0)
    t, o, c, a, b, nc = np.split(held, [m, 2 * m, 3 * m, 4 * m, 5 * m])
    near, far = p[base + k : base + k + d, :d], p[base + k + d :, :d]
    h = np.ones((m, d + 1), np.float32)
    h[:, :d] = a[:, :d] @ near + b[:, :d] @ far
    shift, many = np.log(size).astype(np.float32), np.float32(np.log(len(noise)))
    inner = np.where(size > 1, weight, 0)
    gw = (_sigmoid(_dots(h, t) + shift) - 1) * inner
    go = _sigmoid(_dots(h, o) + shift) * inner
    gc = (_sigmoid(_dots(h, c) - many - log_q[of]) - 1) * weight
    gn = _sigmoid(h @ nc.T - many - log_q[noise]) * weight[:, None]
    gh = (gn @ nc + gc[:, None] * c + gw[:, None] * t + go[:, None] * o)[:, :d]
    g = np.zeros((len(rows), d + 2), np.float32)  # gradient of vector and bias, and weight
    for x, by in enumerate((gw, go, gc)):
        np.multiply(by[:, None], h, out=g[x * m : (x + 1) * m, : d + 1])
    g[3 * m : 4 * m, :d], g[4 * m : 5 * m, :d] = gh @ near.T, gh @ far.T
    g[5 * m :, : d + 1] = gn.T @ h
    g[: 5 * m, d + 1].reshape(5, m)[:] = weight * np.float32([1, 1 / 64, 1, 1, 1])[:, None]
    g[5 * m :, d + 1] = 1 / 64
    order = np.argsort(rows)
    ids = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    times = np.diff(first, append=len(ids))
    at, ids, several = order[first], ids[first], times > 1
    total = g.take(at, axis=0)  # a row that takes part once needs no sum
    if several.any():
        total[several] = np.add.reduceat(g.take(order[np.repeat(several, times)], axis=0), np.cumsum(times[several]) - times[several], axis=0)
    touched[ids] += total[:, d + 1]
    matrices = np.concatenate([a[:, :d].T @ gh, b[:, :d].T @ gh])
    touched[base + k :] += weight.sum()
    last = np.arange(base + k, len(p))
    for at, before, step in ((ids, held.take(at, axis=0), total[:, : d + 1]), (last, p[last], np.pad(matrices, ((0, 0), (0, 1))))):
        total_square = sums.take(at, axis=0) + step**2
        sums[at] = total_square
        p[at] = before - RATE * step / np.sqrt(total_square)


def train(chunks: DataFrame, edges: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Parameters from (ids, n) chunks: word numbers as 32-bit integers, the first two of them context only, and how often they occur.

    A hash of its contents shares out each chunk to one of ROUNDS rounds, and there to one of as many groups as the tokens ask for. A
    group is learned in order of that hash; at the end of a round the changes of a row are averaged by the weights that went into it.
    So the result doesn't depend on how texts or groups were partitioned, and the changes sent grow with the groups, not with the
    partitions. ``mass`` has the counts of the word numbers.
    """
    spark, d, k, v = chunks.sparkSession, VECTOR, len(edges) - 1, int(edges[-1])
    tokens = chunks.agg(F.coalesce(F.sum(F.length("ids") / 4 - 2), F.lit(0))).first()[0]
    groups = max(1, -(-int(tokens) // (ROUNDS * GROUP_TOKENS)))
    by_class = np.add.reduceat(mass + 1.0, edges[:-1])
    q = by_class / by_class.sum()
    log_q = np.log(q).astype(np.float32)
    p = np.random.default_rng(11).normal(0, 0.1, (v + 1 + k + 2 * d, d + 1)).astype(np.float32)
    p[:v, d] = np.log((mass + 1.0) / np.repeat(by_class, np.diff(edges)))
    p[v, d], p[v + 1 : v + 1 + k, d] = 0, log_q
    p[v + 1 + k :] = np.eye(d, d + 1)[np.tile(np.arange(d), 2)] * np.repeat([0.5, 0.25], d)[:, None]
    columns = [f"d{x}" for x in range(d + 1)]
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast(p)

        def run(pdf):
            before = held.value  # noqa: B023  (each round's job ends within its turn)
            p, sums, touched = before.copy(), np.full_like(before, 1e-4), np.zeros(len(before))
            pdf = pdf.sort_values(["deal", "ids"])
            for first in range(0, len(pdf), MIXED):
                lists = [np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["ids"].iloc[first : first + MIXED]]
                two, one, word = (np.concatenate([x[s : len(x) - 2 + s] for x in lists]) for s in range(3))
                n = np.repeat(pdf["n"].to_numpy(float)[first : first + MIXED], [len(x) - 2 for x in lists])
                rng = np.random.default_rng([len(word), *word[:8]])
                order = rng.permutation(len(word))
                for at in np.split(order, range(STEP_ROWS, len(order), STEP_ROWS)):
                    weight = n[at].astype(np.float32)
                    nce_step(p, sums, touched, edges, log_q, two[at], one[at], word[at], weight / weight.mean(), rng.choice(k, NOISE, p=q), rng.random(len(at), np.float32))
            ids = np.flatnonzero(touched)
            change = (p[ids] - before[ids]) * touched[ids, None]
            return pd.DataFrame({"row": ids, "w": touched[ids]} | {c: change[:, x].astype(np.float32) for x, c in enumerate(columns)})

        dealt = chunks.withColumn("deal", F.xxhash64("ids")).where(F.pmod("deal", F.lit(ROUNDS)) == turn)
        dealt = dealt.withColumn("of", F.pmod(F.shiftright("deal", 8), F.lit(groups))).repartition(min(4 * groups, PARTITIONS), "of")
        changed = dealt.groupBy("of").applyInPandas(run, "row long, w double, " + ", ".join(f"{c} float" for c in columns))
        mean = changed.groupBy("row").agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in columns]).toArrow()
        w = mean["w"].to_numpy()
        p = p.copy()
        for x, c in enumerate(columns):
            p[mean["row"].to_numpy(), x] += mean[c].to_numpy() / w
        held.destroy()
    return p


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of the texts in ``docs``, and their word counts (word, n)."""
    small_batches(docs.sparkSession)
    counts = staged(word_counts(docs, text), "lm-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, FREQUENT).sort_values(["n", "word"], ascending=[False, True])
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by = np.argsort(words)
    edges = np.append(class_edges(n), len(words) + 1)
    rest_tokens = int(tokens - n.sum())
    model = Model(tokens, distinct, words[by], n[by], by, edges, rest_tokens, distinct - len(words), np.zeros((0, VECTOR + 1), np.float32))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def cut(batches):
        begin = np.full(2, held.value.rest + 1, np.int32)
        for batch in batches:
            for t, starts, _ in _token_slices(batch, text):
                numbers = held.value.lookup(t)[2].astype(np.int32)
                found = []
                for first, last in zip(starts.tolist(), np.append(starts[1:], len(t)).tolist(), strict=True):
                    one = np.concatenate([begin, numbers[first:last]])
                    found += [one[x : x + CHUNK + 2].tobytes() for x in range(0, last - first, CHUNK)]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(found, pa.binary())})

    chunks = staged(docs.select(text).mapInArrow(cut, "ids binary").groupBy("ids").agg(F.count(F.lit(1)).alias("n")), "lm-chunks")
    model.p = train(chunks, edges, np.append(n, rest_tokens))
    discard(chunks)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of each whole text, in log10.

    Null, empty and blank texts have one token, the end. Unknown words have count 0 in the base and the share of one unseen
    word among those outside the table. With no training text every count is 0. Repeated rows score alike; an empty table
    gives an empty one; columns outside ``keep`` are left out, so extra columns cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = float(model.tokens + model.distinct + 1)
    rest_size = float(model.rest_tokens + model.rest_distinct + 1)

    def run(batches):
        m = shared.value
        for batch in batches:
            parts, lists, times = [], [], []
            for t, starts, rows in _token_slices(batch, "_text", SCORE_BYTES):
                known, c, number = m.lookup(t)
                two, one = contexts(number, starts, m.rest + 1)
                of = np.repeat(np.arange(rows), np.diff(np.append(starts, len(t))))
                lm = m.log_probabilities(two, one, number)
                base = np.where(known, np.log10((c + 1) / size), 0.0)
                parts.append(np.stack([np.bincount(of, minlength=rows), np.bincount(of, known, rows), np.bincount(of, base, rows), np.bincount(of, lm, rows)], 1))
                missed = np.flatnonzero(~known)
                bounds = np.searchsorted(missed, np.append(starts, len(t)))
                for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                    w, n = np.unique(t[missed[first:last]], return_counts=True)
                    lists.append(w.view(np.int64))
                    times.append(n)
            x = np.concatenate(parts) if parts else np.zeros((0, 4))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int32))
            flat = lambda rows, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(kind)))  # noqa: B023, E731
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64)), pa.array(x[:, 2]), pa.array(x[:, 3]), flat(lists, np.int64), flat(times, np.int32)], names=[*batch.schema.names[:-1], "_tokens", "_known", "_base", "_lm", "_words", "_times"])

    held = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_text")
    rows = staged(held.mapInArrow(run, f"{kinds}, _tokens long, _known long, _base double, _lm double, _words array<long>, _times array<int>"), "lm-rows")
    missed = rows.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("x")).select("_row", F.col("x._words").alias("word"), F.col("x._times").alias("times"))
    met = missed.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_more"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(size))).alias("_base2"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(rest_size))).alias("_lm2"),
    )
    none = F.lit(0.0)
    return rows.drop("_words", "_times").join(sums, "_row", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_base2", none)).alias("base_score"),
        (F.col("_lm") + F.coalesce("_lm2", none)).alias("score"),
    )


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document scored by a model of those that are not held out."""
    model, counts = fit(docs.where(~held_out(F.col(f"`{key}`"))).select(F.col(f"`{text}`").alias("text")))
    return score(docs, model, counts, text, (key,)).withColumn("held_out", held_out(F.col(f"`{key}`")))

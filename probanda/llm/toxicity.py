"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier on its posteriors.

Voters come from two sides: fixed patterns and word lists, and a lexicon of words and word beginnings that labelled
training rows show to mark toxic texts far beyond chance. The label model gets votes only: EM estimates how often each
voter votes what for toxic and for clean texts, and voters that stay correlated given the class share one vote between
them. A logistic regression on how often each voter's words occur then learns the posterior labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, small_batches, small_side

#: The classifier is fitted on about so many labelled rows at most, picked by a hash of their key; everything else covers all rows.
FIT_ROWS = 20_000
#: Size of the model: its lexicon entries, which are picked from so many times as many; the lengths of word beginnings that are tried
#: besides whole words; and bytes of words with their entries that a worker keeps.
ENTRIES, PICKED_FROM, BEGINNINGS, CACHE_BYTES = 300, 20, (3, 4, 5, 6), 12 << 20
#: A lexicon entry must be in so many toxic training texts and in this part of them (words that only one family of copies
#: shares are not), and be there by chance with at most this probability over all tried.
LEAST_TEXTS, LEAST_PART, CHANCE = 3, 0.01, 0.01
GROUPS = 6

# Insults of everyday English, German, French and Spanish.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers scum trash pathetic disgusting worthless clown dumb imbecile bastard jerk fool vermin filth arsch dummkopf trottel abschaum wertlos idioten connard salaud abruti crétin ordure estúpido imbécil basura escoria inútil asqueroso".split())
WORD = re.compile(r"[^\W\d_]+")
# Patterns over the whole text.
PATTERNS = tuple(re.compile(p, f) for p, f in ((r"!{2,}", 0), (r"\b(?:you|u)(?:'re| are| r)? (?:an? |such an? |so )?(?:%s)\b" % "|".join(sorted(INSULTS)), re.I), (r"\b[A-Z]{4,}\b", 0), (r"\b(?:shut up|go away|get lost|hate you|kill yourself)\b", re.I), (r"[*#@$%]{3,}", 0)))


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from all learning: crc32 of the key as text is divisible by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(folds)) == 0, F.lit(False))


@dataclass
class Model:
    """Lexicon entries (a word, or a beginning with * at its end) and the weights of the linear classifier."""

    entries: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(PATTERNS)))
    bias: float = -10.0
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def index(self) -> "_Hits":
        return _Hits(self.entries)


class _Hits(Kept):
    """Word to the numbers of the entries it matches."""

    def __init__(self, entries: list[str]):
        super().__init__(self.matched, CACHE_BYTES)
        self.at = {e: k for k, e in enumerate(entries)}

    def matched(self, word: str) -> tuple[int, ...]:
        found = [self.at[x] for x in (word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)) if x in self.at]
        return tuple([*found, len(self.at)] if word in INSULTS else found)


def features(text: str, hits: _Hits) -> dict[int, float]:
    """Feature number to log(1 + distinct words or matches): the entries, then the insults, then the patterns."""
    n: Counter = Counter()
    for found in map(hits.__getitem__, set(WORD.findall(text.lower()))):
        if found:
            n.update(found)
    base = len(hits.at) + 1
    for k, p in enumerate(PATTERNS):
        if c := sum(1 for _ in p.finditer(text)):
            n[base + k] = c
    return {k: math.log1p(c) for k, c in n.items()}


def chance(toxic: int, texts: int, share: float) -> float:
    """log10 of the probability that so many of the texts are toxic, if each is with probability ``share``."""
    terms = [math.lgamma(texts + 1) - math.lgamma(k + 1) - math.lgamma(texts - k + 1) + k * math.log(share) + (texts - k) * math.log1p(-share) for k in range(toxic, texts + 1)]
    top = max(terms)
    return (top + math.log(sum(math.exp(t - top) for t in terms))) / math.log(10)


def lexicon(rows: DataFrame, share: float, texts: int) -> list[str]:
    """Entries that mark toxic training texts (text, toxic); counted in tasks, summed by entry. This picks the voters by the labels of
    training rows, so it is supervised; the label model after it sees votes only.
    ``texts`` is how many rows there are and ``share`` the part that is toxic."""

    def count(batches):
        for pdf in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = set(WORD.findall(text.lower()))
                found = set(words)
                for k in BEGINNINGS:
                    found.update([w[:k] + "*" for w in words if len(w) >= k])
                n[int(toxic)].update(found)
            names = list(n[0].keys() | n[1].keys())
            if names:
                yield pd.DataFrame({"entry": names, "clean": [n[0][e] for e in names], "toxic": [n[1][e] for e in names]})

    summed = rows.mapInPandas(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    tried = summed.where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    marked = (F.col("toxic") >= max(LEAST_TEXTS, LEAST_PART * share * texts)) & (F.col("toxic") >= 4 * F.col("clean"))
    top = tried.count()
    found = tried.where(marked).orderBy(F.desc(F.col("toxic") - 2 * F.col("clean")), "entry").limit(PICKED_FROM * ENTRIES).collect()
    bound = math.log10(CHANCE / max(top, 1))
    worth = {r["entry"]: r["toxic"] - 2 * r["clean"] for r in found if chance(r["toxic"], r["toxic"] + r["clean"], share) <= bound}
    # of nested entries the longest that still has nearly all texts of the shorter ones stands for them
    nearly: dict[str, int] = {}
    for e, n in worth.items():
        for k in BEGINNINGS:
            if k < len(e.rstrip("*")) or k == len(e) and not e.endswith("*"):
                nearly[e[:k] + "*"] = max(nearly.get(e[:k] + "*", 0), n)
    left = {e: n for e, n in worth.items() if nearly.get(e, 0) < 0.9 * n}
    kept: list[str] = []
    for e in sorted(left, key=lambda e: (-left[e], len(e), e)):
        word = e.rstrip("*")
        if len(kept) < ENTRIES and not any(word[:k] + "*" in kept for k in BEGINNINGS if k < len(word)):
            kept.append(e)
    return kept


def votes(x: np.ndarray, entries: int) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) from the features: entries, groups of them and patterns vote toxic, their absence clean."""
    some = x > 0
    out = [some[:, k].astype(int) for k in range(x.shape[1])]
    words = some[:, : entries + 1]
    for g in range(GROUPS if entries else 0):
        out.append(words[:, g::GROUPS].any(1).astype(int))
    out.append((words.sum(1) >= 2).astype(int))
    out.append(np.where(words.any(1), 0, -1))
    out.append(np.where(some.any(1), 0, -1))
    return np.stack(out, 1)


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, accuracy of each voter, correlations of voters given the class) from votes and the class balance, by EM.

    The correlations are parameters as the accuracies are: they are estimated from the residuals that the classes leave, and the
    E-step weighs each voter by 1 / (1 + sum of its squared correlations), so a block of voters that say the same thing counts about
    once. No vote is no evidence.
    """
    n, m = v.shape
    share, corr = np.ones(m), np.zeros((m, m))
    p = np.clip((v.sum(1) > 0).astype(float), 0.05, 0.9)
    onehot = np.stack([v == -1, v == 0, v == 1], 2).astype(float)
    for k in range(rounds):
        toxic = (np.einsum("n,nmk->mk", p, onehot) + 0.1) / (p.sum() + 0.3)
        clean = (np.einsum("n,nmk->mk", 1 - p, onehot) + 0.1) / ((1 - p).sum() + 0.3)
        if k in (4, 12):
            residual = v - (p[:, None] * (toxic[:, 2] - toxic[:, 0]) + (1 - p[:, None]) * (clean[:, 2] - clean[:, 0]))
            sd = residual.std(0) + 1e-9
            corr = np.clip(residual.T @ residual / n / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + (corr**2).sum(0))
        odds = np.einsum("nmk,mk->n", onehot, (np.log(toxic) - np.log(clean)) * share[:, None] * [1.0, 0.0, 1.0]) + math.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    accuracy = (np.einsum("n,nm->m", p, onehot[:, :, 2]) + np.einsum("n,nm->m", 1 - p, onehot[:, :, 0])) / np.maximum((v != 0).sum(0), 1)
    return p, accuracy, corr


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels; Newton steps with an L2 penalty."""
    weight = np.full(len(x), 1 / max(len(x), 1))
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty / max(len(x), 1))
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h + 1e-10 * np.eye(len(w)), g)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The model, learned from labelled rows that are not held out. Without toxic and clean rows it calls every text clean."""
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("toxic")).where(~held_out(F.col("_key")) & F.col("_key").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("_key").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    part = min(1.0, fit_rows / max(total, 1))
    known = known.where(F.pmod(F.xxhash64("_key", F.lit("fit")), F.lit(1_000_000)) < round(part * 1_000_000))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.join(small_side(known, min(total, fit_rows)), "_key").select("_key", "text", "toxic")
    texts, share = known.agg(F.count("toxic"), F.avg("toxic")).first()
    if not share or share >= 1:
        return Model()
    entries = lexicon(rows.select("text", "toxic").dropDuplicates(), share, texts)

    def describe(batches):
        hits = _Hits(entries)
        for pdf in batches:
            found = [features(t, hits) for t in pdf["text"]]
            if found:
                yield pd.DataFrame({"key": pdf["_key"], "at": [list(f) for f in found], "x": [list(f.values()) for f in found]})

    kind = rows.schema["_key"].dataType.simpleString()
    got = rows.mapInPandas(describe, f"key {kind}, at array<int>, x array<double>").toPandas().sort_values("key", kind="stable")
    x = np.zeros((len(got), len(entries) + 1 + len(PATTERNS)))
    for k, (at, values) in enumerate(zip(got["at"], got["x"], strict=True)):
        x[k, np.asarray(at, int)] = values
    posterior, accuracy, correlations = label_model(votes(x, len(entries)), share)
    weights, bias = logistic(x, posterior)
    return Model(entries, weights, bias, accuracy, correlations)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` columns and ``out``: the classifier's probability that the whole text is toxic.

    Null and empty texts have no features, so their score is that of the bias. Repeated rows score alike; an empty table
    gives an empty one; columns outside ``keep`` are left out, so extra columns cannot clash; ``out`` may not be one of ``keep``.
    """
    if out in keep:
        raise ValueError(f"the score can't be called {out}, which is a column that is kept")
    small_batches(docs.sparkSession)
    # of a lean copy only what scoring needs goes to the workers
    lean = docs.sparkSession.sparkContext.broadcast((model.entries, model.weights.tolist(), model.bias))
    taken = "_text"
    while taken in keep:
        taken += "_"

    def run(batches):
        entries, weights, bias = lean.value
        hits = _Hits(entries)
        for batch in batches:
            at = batch.schema.get_field_index(taken)
            found = []
            for k in range(0, batch.num_rows, 256):
                for t in batch.column(at).slice(k, 256).to_pylist():
                    z = bias + sum(weights[k] * v for k, v in features(t, hits).items())
                    found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.float64())], names=[*[n for n in batch.schema.names if n != taken], out])

    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(taken))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != taken)
    return held.mapInArrow(run, f"{kinds}, `{out}` double")

"""Near copies, mixing, toxicity, language model, neighbours and audio against brute force or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.llm import audio, jaccard, lm, mixing, nndescent, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, variants=150, lines=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, line = rng.choices(vocabulary, k=100), rng.choices(vocabulary, k=12)
    out = []
    for _ in range(variants):
        w = list(base)
        for _ in range(rng.randint(0, 10)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(0, 9)) + line) for _ in range(lines)]
    out += [" ".join(base)] * 60 + [None, "", " \n", "One", "one", "ONE  two", "one two three", "one two  three"]
    out += [" ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 5, 30]))) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "width", "percent"), [(2048, 4, 85), (48, 5, 80)])
def test_jaccard_links_are_exact(spark, monkeypatch, block, width, percent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = family(block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, DOCS), width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_of_nothing(spark):
    assert jaccard.linked(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in jaccard.linked(spark.createDataFrame([(None, "a b c d e")], DOCS)).collect()] == [(None, 2, None)]


def test_mixing_targets_and_copies(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["b", "a", None, "ä", "z"] + ["big"] * 8)) for i in range(4000)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, budget = set(order), {}, 1.5 * sum(sizes.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= full
    target.update({s: weight[s] * level for s in left})
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] for s in order)
    again = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.plan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mix_emits_copies(spark):
    df = spark.createDataFrame([(i, "a b", f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    want = {r.doc_id: r.copies for r in mixing.plan(df).collect()}
    got = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.withColumn("score", F.lit("clash")), model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.02


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hello")], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, model).collect())


def test_base_scores_and_normalised_probabilities(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("the a Of to cat dog sun moon tree river".split() + [f"x{rng.randrange(200)}"], k=rng.randint(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "x" * 3000)]
    df = spark.createDataFrame(rows, DOCS)
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    for r in lm.score_documents(df).collect():
        tokens = [*words(dict(rows)[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    model, _ = lm.fit(df.select("text"))
    table = brute_log_probabilities(model)
    assert np.allclose((10.0**table).sum(2), 1)
    two, one, word = np.random.default_rng(1).integers(0, [[len(table)], [len(table)], [len(table) - 1]], (3, 500))
    assert np.allclose(model.log_probabilities(two, one, word), table[two, one, word], atol=1e-4)


def brute_log_probabilities(model):
    """log10 probability of every word number after every two, in double precision, one class at a time."""
    d, k, p = lm.VECTOR, len(model.edges) - 1, model.p.astype(float)
    r = p[: model.rest + 2]
    q, near, far = p[len(r) : len(r) + k], p[len(r) + k : len(r) + k + d, :d], p[len(r) + k + d :, :d]
    h = (r[:, :d] @ near)[None, :, :] + (r[:, :d] @ far)[:, None, :]
    e = np.exp(h @ q[:, :d].T + q[:, d])
    share = e / e.sum(2, keepdims=True)
    out = []
    for c in range(k):
        own = r[model.edges[c] : model.edges[c + 1]]
        e = np.exp(h @ own[:, :d].T + own[:, d])
        out.append(share[:, :, c : c + 1] * e / e.sum(2, keepdims=True))
    return np.log10(np.concatenate(out, axis=2))


def test_scores_of_rare_words_depend_on_context(spark):
    rng = random.Random(4)
    pairs = [(f"a{k}", f"b{k}") for k in range(400)]
    texts = [" ".join(w for p in rng.choices(pairs, k=60) for w in p) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    model, counts = lm.fit(df.select("text"))
    assert len(model.edges) - 1 > 20 and model.rest == 801
    score = lambda texts: np.array([r.score for r in lm.score(spark.createDataFrame(list(enumerate(texts)), DOCS), model, counts).orderBy("doc_id").collect()])
    right, wrong = score([f"{a} {b}" for a, b in pairs]), score([f"{a} b{(k + 7) % 400}" for k, (a, _) in enumerate(pairs)])
    assert np.mean(right > wrong) > 0.8
    swapped = score([f"{b} {a}" for a, b in pairs])
    assert np.mean(right > swapped) > 0.9


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=40))) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    one, two = ({r.doc_id: (r.score, r.base_score) for r in lm.score_documents(df.repartition(n)).collect()} for n in (1, 7))
    assert one == {i: pytest.approx(x) for i, x in two.items()}


def test_language_model_learns_order(spark):
    rows = [(i, "one two three four " * 30) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    model, counts = lm.fit(df.select("text"))
    right, wrong = (lm.score(spark.createDataFrame([(1, t)], DOCS), model, counts).first()["score"] for t in ("one two three four " * 5, "four three two one " * 5))
    assert right > wrong


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0, None])]
    got = nndescent.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    y = x.astype(float)
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = [int(k) for k in np.lexsort((np.arange(600), -s))[:20]]
        assert len(by[q]) == 20 and [p[1] for p in by[q]] == sorted((p[1] for p in by[q]), reverse=True)
        hits += len(set(want) & {p[0] for p in by[q]})
        total += 20
    assert set(by) == set(range(0, 600, 20)) and hits / total >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nndescent.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 0.5)]
    assert nndescent.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_opposite_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = nndescent.search(df, F.lit(True), 20).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, -1.0), (1, 1, 0, -1.0)]


def test_outliers_ask_and_are_found(spark):
    x = np.random.default_rng(4).normal(size=(700, 8)) * 0.1
    x[:, 0] += 10
    x[400] = [60, 1000, 0, 0, 0, 0, 0, 0]  # nearest of most, though it shares no pivot with them
    x[500] = [-1000, 0, 0, 0, 0, 0, 0, 0]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    by = {}
    for r in nndescent.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    y = x.astype(float)
    hits = 0
    for q in range(0, 700, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = [int(k) for k in np.lexsort((np.arange(700), -s))[:20]]
        assert len(by[q]) == 20 and (400 in by[q]) == (400 in want)
        hits += len(set(by[q]) & set(want))
    assert hits / (35 * 20) >= 0.9


def test_short_queries_are_finished_exactly(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    monkeypatch.setattr(nndescent, "ASKS", 4)
    monkeypatch.setattr(nndescent, "EXPAND", 0)
    x = np.random.default_rng(5).normal(size=(150, 6)).astype(np.float32)
    x[7] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nndescent.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    y = x.astype(float)
    for q in range(0, 150, 20):
        s = y @ y[q]
        s[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.lexsort((np.arange(150), -s))[:20].tolist()


def melody(seed, seconds=12):
    rng = np.random.default_rng(seed)
    notes = 220 * 2 ** (rng.integers(0, 24, seconds * 8) / 12)
    return np.sin(2 * np.pi * np.cumsum(np.repeat(notes, audio.RATE // 8)) / audio.RATE).astype(np.float32)


def test_excerpts_align():
    whole = melody(1)
    part = whole[audio.HOP * 15 : audio.HOP * 70] + np.random.default_rng(3).normal(0, 0.02, audio.HOP * 55).astype(np.float32)
    query = audio.fingerprint(part)
    found = audio.aligned(query, [audio.fingerprint(whole), audio.fingerprint(melody(2)), np.empty(0, np.uint32)])
    assert found[0] is not None and found[0][1] == 15 and found[0][0] < 0.1
    assert found[1] is None or found[1][0] > 0.3
    assert found[2] is None


def test_later_offsets_are_measured():
    query = np.random.default_rng(9).integers(0, 2**32, 40, dtype=np.uint32)
    row = np.concatenate([~query, np.zeros(10, np.uint32), query ^ np.uint32(1)])
    row[:40:8] = query[::8]  # five equal integers at offset 0, where all other bits differ
    row[50:90:15] = query[::15]  # three at offset 50, where one bit in 32 differs
    assert audio.aligned(query, [row])[0] == (37 / (32 * 40), 50, 3)


def test_every_link_of_a_family(spark):
    a = melody(5)
    rows = [(i, a[audio.HOP * skip :].tolist()) for i, skip in ((100, 0), (102, 10), (200, 20), (202, 20))] + [(103, melody(6).tolist())]
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec long, audio array<float>"), "audio", "rec", lambda x: np.asarray(x, np.float32))
    got = audio.match(prints, "rec", F.col("rec") % 100 == 0).collect()
    links = {(r.rec, r.class_id, r.query_class, r.offset) for r in got}
    assert links == {(100, 100, 200, 20), (102, 102, 100, -10), (102, 102, 200, 10), (200, 200, 100, -20), (202, 200, 100, -20), (103, 103, None, None)}
    assert len(got) == 6


def test_audio_columns(spark):
    import io
    import wave

    def wav(x):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(audio.RATE)
            f.writeframes((x * 30000).astype("<i2").tobytes())
        return bytearray(out.getvalue())

    a = melody(5)
    rows = [(100, wav(a)), (101, wav(a)), (102, wav(a[audio.HOP * 10 :])), (103, wav(melody(6))), (104, None), (105, wav(a[:50]))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "rec long, audio binary"), "audio", "rec")
    got = {r.rec: r for r in audio.match(prints, "rec", F.col("rec") % 100 == 0).collect()}
    assert len(got) == 6 and got[101].class_id == 100 and got[104].n_codes == 0 and got[105].class_id == 105
    assert got[102].query_class == 100 and got[102].offset == -10 and got[102].bit_error < 0.05
    assert got[103].query_class is None


def test_jaccard_rounds_start_with_few_pairs_of_a_document():
    import pandas as pd

    n, one = 40, np.packbits(np.ones(256, np.uint8)).tobytes()
    group = pd.DataFrame({"token": 9, "b1": "0", "b2": "0", "own": 0, "id": range(1, n + 1), "n": 50, "bits": [one] * n, "low": [np.array([9])] * n, "component": range(1, n + 1), "failed": [None] * n})
    pairs = jaccard._forest(group, 80, jaccard.FIRST)
    assert len(pairs) == sum(min(jaccard.FIRST, n - 1 - i) for i in range(n))
    assert len(jaccard._forest(group, 80)) == n - 1

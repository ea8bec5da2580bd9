"""Empty tables, nulls, odd texts, clashing names, repeated keys and unstable inputs of the training-data operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probanda.llm import audio, common, encoding, html_text, jaccard, lm, mixing, nndescent, token_counts, toxicity

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
DOCS = "doc_id long, text string, lang string, source string, score double, copy_no int, component_id string, n_tokens string"
LABELS = "doc_id long, toxic int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0.5, 7, "c", "n") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(params=["none", "odd"])
def odd(request, spark):
    texts = {"none": [], "odd": [None, None, "", " \n", "1 2 3 . !", "1 2 3 . !"]}[request.param]
    return docs_of(spark, texts).repartition(4)


def test_odd_tables_have_all_their_rows(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], LABELS)
    assert token_counts.count_tokens(odd, VOCABULARY).count() == n
    assert encoding.decode(encoding.encode(odd, VOCABULARY), VOCABULARY).count() == n
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == n
    assert lm.score_documents(odd).count() == n
    assert sorted(r.component_id for r in jaccard.linked(odd).collect()) == ([0, 1, 2, 3, 4, 4] if n else [])
    assert mixing.plan(odd).count() == n


def test_stages_keep_columns_of_any_name(spark, odd, tmp_path):
    n = odd.count()
    spark.createDataFrame([(i, i % 2) for i in range(n)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.schema == odd.schema or out.columns == odd.columns
        assert all(r.copy_no == 7 and r.score == 0.5 for r in out.collect())
    assert corpus_pipeline.encode(spark, odd, str(tmp_path)).count() == n


def test_rows_that_share_a_key(spark):
    a, b = "one two three four five six seven eight", "other words that are not linked with the rest at all"
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "y"), (2, a, "x"), (3, b, "y"), (None, a, "z"), (4, "", "w"), (4, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(str((r.doc_id, r.text)) for r in jaccard.one_of_each(docs).collect())
    # the texts of key 1 aren't linked with each other, and each is the least of its own group
    assert kept == sorted(map(str, [(1, a), (1, b), (None, a), (4, ""), (4, "")]))
    copies = mixing.mix(docs, copy_no="again").groupBy("doc_id", "source").count().collect()
    assert {(r.doc_id, r.source) for r in copies} <= {(i, s) for i, _, s in rows}
    with pytest.raises(ValueError):
        mixing.mix(docs, copy_no="source")


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_meet_their_own_row(spark, parts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(parts)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 999, rng.integers(1, 90))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: list(r.ids) for r in encoding.encode(docs, VOCABULARY, long_chars=100, piece_chars=64).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_indexed_matches_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**32, 30, dtype=np.uint32) for _ in range(6)]
    codes = {}
    for i in range(90):
        x = np.concatenate([rng.integers(0, 2**32, rng.integers(0, 8), dtype=np.uint32), base[i % 6]])
        off = rng.random(len(x)) < 0.4
        x[off] ^= np.uint32(1) << rng.integers(0, 32, off.sum(), dtype=np.uint32)
        codes[i] = x[: rng.integers(10, len(x))]
    codes |= {151: codes[10], 160: np.zeros(20, np.uint32), 200: np.zeros(25, np.uint32), 300: np.empty(0, np.uint32)}
    prints = spark.createDataFrame([(i, 1.0, bytearray(c.tobytes()), "k") for i, c in codes.items()], "rec long, seconds double, codes binary, votes string")
    got = {(r.rec, r.class_id, r.query_class, r.offset, r.votes, r.bit_error and round(r.bit_error, 9)) for r in audio.match(prints, "rec", F.col("rec") % 10 == 0).collect()}
    least: dict[bytes, int] = {}
    for i, c in sorted(codes.items()):
        least.setdefault(c.tobytes(), i)
    asked = {least[c.tobytes()] for i, c in codes.items() if i % 10 == 0 and len(c)}
    want = set()
    for i, c in codes.items():
        own = least[c.tobytes()]
        found = {(i, own, q, f[1], f[2], round(f[0], 9)) for q in asked - {own} if (f := audio.aligned(codes[q], [c])[0]) and f[0] <= audio.ERRORS}
        want |= found or {(i, own, None, None, None, None)}
    assert got == want
    assert audio.match(prints.limit(0), "rec", F.col("rec") % 10 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15])
def test_small_tables_have_all_their_neighbours(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x[-1, 40:] = 0
    rows = [(i, (v if i + 1 < n or n == 1 else v[:40]).tolist(), 1) for i, v in enumerate(x)]
    got = nndescent.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    s = x @ x[0]
    want = [int(k) for k in np.lexsort((np.arange(n), -s)) if k]
    assert [r.vec_id for r in got] == want and [r.score for r in got] == pytest.approx([s[k] for k in want], abs=1e-12)


def test_the_larger_text_is_the_page():
    long = "<p>" + "This is the long text of the page and it has to be read by all of us in the end. " * 5 + "</p>"
    page = f"<body><article><p>A teaser for the day.</p></article><div>{long}{long}</div><div class='ad'>Buy</div></body>"
    assert html_text.main_text(page).count("long text of the page") == 10


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a href=a>Start</a></nav><article><h1>Über uns</h1><p>Das ist ein Satz, der für uns und die anderen da ist.</p></article><footer>x</footer></body>", "Über uns\n\nDas ist ein Satz, der für uns und die anderen da ist."),
        ("<main><p>C'est une phrase qui est dans la page<p>et une autre &amp; plus</main><aside>non</aside>", "C'est une phrase qui est dans la page\n\net une autre & plus"),
        ("<article><p>Hola <b>mundo</p><ul class=related><li><a href=x>otra</a></ul><p>Una frase con la que se va</article>", "Hola mundo\n\nUna frase con la que se va"),
        ("<article><p>It is here</p><section id=comments><p>I am the first to say it</p></section><script>a<b</script></article>", "It is here"),
    ],
)
def test_labelled_pages(page, text):
    assert html_text.main_text(page) == text


def test_unmatched_end_tags_take_linear_time():
    began = time.time()
    html_text.main_text("<i>" * 40_000 + "</b>" * 40_000)
    assert time.time() - began < 5


def test_empty_pages_and_vectors(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_caches_are_bounded():
    kept = common.Kept(len, 4000, {"base": 9})
    assert [kept[w] for w in ["base", *(f"w{k}" for k in range(5000)), "base", "w4999"]][-2:] == [9, 5] and len(kept) + len(kept.old) < 40

"""Stages of the corpus pipeline against plain versions, each on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_corpus import brute_components, family


def test_one_of_each_group_stays(spark):
    rows = family(3, variants=40, lines=20)
    docs = spark.createDataFrame([(i, t, "x" * (i % 3)) for i, t in rows], "doc_id long, text string, component_id string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, least) in brute_components(rows, 5, 80).items() if i == least)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    left = {r.toxic: r["count"] for r in kept.join(labels, "doc_id").groupBy("toxic").count().collect()}
    whole = {r.toxic: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    assert left.get(1, 0) < 0.15 * whole[1] and left[0] > 0.98 * whole[0]


def test_tokens_are_the_library_s(spark):
    texts = [None, "", "A b  c\n", "naïve “quotes” <|endoftext|> x"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}

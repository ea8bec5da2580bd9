"""Extraction, tokens, archives: brute force, the libraries themselves, exact round trips."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from probanda.llm import encoding, html_text, token_counts, warc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = list("ab cdefg'\n\t  .,1ⅷ²é՘ 😀字\x1fĉALLs")
    odd = [None, "", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b", "x" * 30_000, "\n\n\n" * 3000 + "x" * 9000 + "  " * 4000 + "é" * 7777, "we'll  it's"]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.choice([5, 50, 500, 3000]))) for _ in range(120)] + ["".join(rng.choice("abcdeft") for _ in range(40_000))]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(("long_chars", "piece_chars"), [(400, 64), (50_000, 16_384)])
def test_encoding_is_the_librarys_and_decodes_back(spark, texts, library, long_chars, piece_chars):
    df = frame(spark, texts)
    got = {r.doc_id: r for r in encoding.decode(encoding.encode(df, VOCABULARY, long_chars=long_chars, piece_chars=piece_chars), VOCABULARY).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t or "", add_special_tokens=False).ids, i
        assert got[i].decoded == (t or "")


def test_decoding_bytes_that_are_not_utf8(spark, library):
    ids = library.encode("é", add_special_tokens=False).ids + library.encode("字", add_special_tokens=False).ids
    rows = [(0, ids[-1:]), (1, None), (2, [])]
    got = {r.k: r.decoded for r in encoding.decode(spark.createDataFrame(rows, "k int, ids array<int>"), VOCABULARY).collect()}
    assert got == {0: library.decode(ids[-1:], skip_special_tokens=False), 1: "", 2: ""}


def test_token_counts(spark, texts, library):
    df = frame(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts.count_tokens(df, VOCABULARY).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), i
        assert got[i].n_bytes == len((t or "").encode())
    assert token_counts.count_tokens(df.limit(0), VOCABULARY).count() == 0


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies and you are fine with that</div><div class="ad">Buy it now</div>
    <article><h1>A   title</h1><p><b>It is a fact that the dog &amp; the cat are in the garden.<br>Yes<p>Ok.</p><aside>side</aside><form>f<input></form>
    <p>No closing tag &lt;here&gt; and it&#39;s &eacute;<div id="comments"><p>First! I am here and it is the best</p></div></article><footer>&copy; x</footer>"""
    assert html_text.main_text(page) == "A title\n\nIt is a fact that the dog & the cat are in the garden. Yes\n\nOk.\n\nNo closing tag <here> and it's é"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<div class=", "<!-- never closed", "<script>x", "<p>" * 3000, "&" * 50, "</p></div>"])
def test_broken_pages_have_a_text(page):
    assert isinstance(html_text.main_text(page), str)


def test_extraction_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi there</p></article>", 3), (1, "u", "<article><p>Hi there</p></article>", 3), (2, None, None, 4)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "Hi there", 8), (1, "Hi there", 8), (2, "", 0)]


def test_archives_come_back_whole(spark, tmp_path):
    body = "<p>é" + "x" * 200
    rows = [(1, "http://a/é\n", body), (2, "b", body), (3, None, "short"), (4, "d", "short"), (5, "e", None), (6, "f", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    listed = spark.createDataFrame(warc.write(warc.with_revisits(df), str(tmp_path / "w"), archive_bytes=200).collect(), "path string, records long, bytes long")
    got = {r.page_id: r for r in warc.read(listed).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for i, url, html in rows:
        raw = (html or "").encode()
        assert got[i].url == url and got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i == 2 else ("response", None))
        assert i == 2 or bytes(got[i].payload) == raw
    one = listed.first()["path"]
    with gzip.open(one) as f:
        assert f.read().startswith(b"WARC/1.1\r\n")


def test_damaged_archives_are_found():
    good = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert [p for _, p in warc.records(io.BytesIO(good + good))] == [b"hello", b"hello"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.record(1, "u", b"hello", "0" * 64, None))))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(good[:-9])))

"""Ids beyond what floats hold, beside null ones, and odd tables, in the operators that write files, read pages and hear tunes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.llm import audio, common, html_text, nndescent, queries, warc

BIG = 1 << 53
PROSE = "<p>" + "The rain was on the hills and he had seen that it would be there for all of the day, as it is so often with them. " * 4 + "</p>"
PAGES = "page_id long, url string, html string, payload string, digest int, refers_to string, text string, n_chars string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "r", "t", "n") for r in rows], PAGES)


def test_archives_keep_ids(spark, tmp_path):
    same = "x" * 200
    rows = [(BIG + 1, "u", same), (BIG + 3, None, same), (None, "u", same), (BIG + 5, "u", None), (BIG + 5, "u", None), (BIG + 7, "u", ""), (BIG + 9, "u v\n", "short")]
    pages = pages_of(spark, rows).coalesce(1)
    listed = common.staged(warc.write(warc.with_revisits(pages), str(tmp_path / "a")), "warc-test")
    got = sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read(listed).collect()), key=str)
    want = [(BIG + 1, "u", "response", 200, None, same.encode()), (BIG + 3, None, "revisit", 200, BIG + 1, None), (None, "u", "response", 200, None, same.encode())]
    want += [(BIG + 5, "u", "response", 0, None, b"")] * 2 + [(BIG + 7, "u", "response", 0, None, b""), (BIG + 9, "u v\n", "response", 5, None, b"short")]
    assert got == sorted(want, key=str)
    empty = common.staged(warc.write(warc.with_revisits(pages_of(spark, [])), str(tmp_path / "b")), "warc-test")
    assert warc.read(empty).collect() == []


def test_extraction_keeps_ids(spark):
    rows = [(BIG + 3, "u", f"<body>{PROSE}</body>"), (None, "u", None), (BIG + 1, None, ""), (BIG + 1, None, "")]
    got = sorted((str(r.page_id), r.n_chars) for r in html_text.extract(pages_of(spark, rows).coalesce(1)).collect())
    n = len(html_text.main_text(f"<body>{PROSE}</body>"))
    assert n > 400 and got == sorted([(str(BIG + 3), n), ("None", 0), (str(BIG + 1), 0), (str(BIG + 1), 0)])
    assert html_text.extract(pages_of(spark, [])).collect() == []


def test_fingerprints_keep_ids(spark):
    rows = [(BIG + 1, [0.1, 0.9, -0.3] * 20), (None, None), (BIG + 3, [0.1, 0.9, -0.3] * 20)]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>").coalesce(1)
    prints = common.staged(audio.fingerprints(table, "v", "vec_id", queries.tune), "audio-test")
    got = {r.vec_id: r.class_id for r in audio.match(prints, "vec_id", F.col("vec_id").isNotNull()).collect()}
    assert got == {BIG + 1: BIG + 1, BIG + 3: BIG + 1, None: None}


def test_held_tones_count_as_all_pairs_would(spark):
    """Recordings with runs of one integer: the votes are those of every pair of places."""
    rng = np.random.default_rng(8)
    codes = {i: np.repeat(rng.integers(0, 3, 9), rng.integers(1, 12, 9)).astype(np.uint32) for i in range(24)}
    prints = spark.createDataFrame([(i, 1.0, bytearray(x.astype("<u4").tobytes())) for i, x in codes.items()], "vec_id long, seconds double, codes binary")
    got = {(r.vec_id, r.query_class): (r.bit_error, r.offset, r.votes) for r in audio.match(prints, "vec_id", F.col("vec_id") % 3 == 0).collect() if r.query_class is not None}
    want = {}
    for q in range(0, 24, 3):
        for i, found in enumerate(audio.aligned(codes[q], [codes[i] for i in range(24)])):
            if i != q and found is not None and found[0] <= audio.ERRORS:
                want[i, q] = found
    assert want and {k: (pytest.approx(v[0]), *v[1:]) for k, v in want.items()} == got


@pytest.mark.parametrize(
    "page, kept",
    [
        ("<nav>Menu</nav><div>" + "<p>La pioggia cadeva lenta sulle colline mentre il vecchio contadino guardava il cielo e pensava alla figlia, MARK, che viveva lontano, oltre il mare, in una grande città che non aveva mai visto davvero.</p>" * 2 + "</div>", True),
        ("<div>" + "<p>Дождь медленно падал на холмы, пока старый крестьянин смотрел в небо и думал о дочери, MARK, которая жила далеко за морем, в большом городе, которого он никогда не видел, хотя часто представлял его себе.</p>" * 2 + "</div>", True),
        (f"<div>{PROSE}<p>MARK, Aarlberg, Bertrand, Castillo, Dominguez, Eriksson, Ferreira, Gonzalez, Hoffmann, Ivanovic, Jorgensen, Kowalski, Lindqvist, Moretti, Nakamura, Oliveira, Petrenko, Quispe, Rodriguez, Svensson, Tanaka.</p>{PROSE}</div>", True),
        (f"<div class='post-comments-enabled'>{PROSE}<p>MARK was there and he had been with them for the whole of the day, as it is so often.</p></div>", True),
        (f"<div>{PROSE}</div><div class='kommentare'><p>MARK</p>{PROSE}</div>", False),
        (f"<div>{PROSE}</div><div class=werbung><p>MARK</p>{PROSE}</div>", False),
        (f"<div>{PROSE}<script src=https://a.b/c/>var x = 'MARK';</script>{PROSE}</div>", False),
        (f"<div>{PROSE}<svg/><p>MARK was there and he had been with them for the whole of the day, as it is so often.</p></div>", True),
    ],
)
def test_what_an_article_keeps(page, kept):
    text = html_text.main_text(f"<html><body>{page}</body></html>")
    assert len(text) > 200 and ("MARK" in text) == kept


@pytest.mark.parametrize("scale", [1e-60, 1e100])
def test_nearest_of_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 12)) * scale
    x[7] *= 1e-45  # one that is small beside the others has neighbours too
    got = nndescent.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 7, 10)
    near = {}
    for r in got.collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(near) == set(range(7, 400, 10))
    hits = [len(near[q] & set([j for j in np.argsort(-(x @ x[q])) if j != q][:10])) for q in near]
    assert np.mean(hits) >= 9

"""The transducer and its decoder against the library and plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from probanda.llm import queries, transducer

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=transducer.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return transducer.Ranked(PATH, PATTERN)


def plain(ranks, raw):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_runs_are_the_library_s(model, library):
    rng = random.Random(5)
    tokens = list(model.fst.ranks)
    for alphabet in ("ab", "thein gs", "лтоне ", "漢字的一是", "0123456789", "-=#*", "éèà "):
        for n in (3, 30, 300):
            for _ in range(40):
                s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, n)))
                assert np.frombuffer(model.ids_bytes(s), np.int32).tolist() == library.encode_ordinary(s)
    for _ in range(3000):
        raw = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5)))
        assert model.fst.encode(raw) == library._core_bpe.encode_single_piece(raw)


def test_any_code_point(model, library):
    """Also those that the two regular-expression libraries class differently."""
    rng = random.Random(6)
    odd = [chr(c) for c in model.differing[1]]
    for _ in range(2000):
        s = "".join(rng.choice([chr(rng.randrange(0x20, 0x3000)), chr(rng.randrange(0xE000, 0x110000)), rng.choice(odd or ["a"]), rng.choice("a 1'\n")]) for _ in range(rng.randrange(1, 20)))
        assert np.frombuffer(model.ids_bytes(s), np.int32).tolist() == library.encode_ordinary(s), s
    assert not [c for c in odd if not transducer.UNUSUAL.search(c)]


@pytest.mark.parametrize("states", [1, 7, 10_000])
def test_forgetting_states_changes_nothing(states):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258, b"abab": 259, b"aa": 260, b"aab": 261}
    fst, rng = transducer.Transducer(ranks, states), random.Random(states)
    for _ in range(300):
        raw = bytes(rng.choice(b"aabc") for _ in range(rng.randrange(0, 60)))
        assert fst.encode(raw) == ([ranks[raw]] if raw in ranks else plain(ranks, raw)), raw


def test_tokens_come_soon_and_chunks_do_not_matter(model):
    raw = ("na" * 3000 + "xyzzy" * 2000 + " the").encode()
    whole, seen = model.fst.encode(raw), 0
    most, out = 0, []

    def chunks():
        nonlocal seen
        for i in range(0, len(raw), 7):
            seen += len(raw[i : i + 7])
            yield raw[i : i + 7]

    for token in model.fst.stream(chunks()):
        out.append(token)
        most = max(most, seen - sum(len(model.fst.bytes_of[t]) for t in out[-1:]) - sum(map(model.fst.length.get, out[:-1])))
    assert out == whole and most < 20 * model.fst.longest


def test_stream_decoding_is_python_s(model):
    rng = random.Random(7)
    single = {b: model.fst.ranks[bytes([b])] for b in range(256)}
    for _ in range(3000):
        raw = bytes(rng.choice([rng.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0]) for _ in range(rng.randrange(0, 12)))
        assert model.decode(np.array([single[b] for b in raw], int)) == raw.decode("utf-8", "replace"), raw


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_fst_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_odd_tables(spark, library):
    kinds = "doc_id long, text string, ids string, decoded string, _text int"
    texts = [None, "", " ", "<|endoftext|>", "same", "same", "a" * 300_000, "x y " * 50_000, "é͸\U0001f600 "]
    for rows in ([], [(None if i == 4 else (1 << 53) + i, t, "i", "d", 3) for i, t in enumerate(texts)]):
        docs = spark.createDataFrame(rows, kinds)
        got = transducer.decode(transducer.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
        assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted((str(r[0]), library.encode_ordinary(r[1] or ""), r[1] or "") for r in rows)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in transducer.decode(nulls, PATH, PATTERN).collect()] == ["", ""]
    with pytest.raises(ValueError):
        transducer.decode(nulls, PATH, PATTERN, out="ids")

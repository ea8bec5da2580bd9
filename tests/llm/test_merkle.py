"""The Merkle manifest against a plain tree, and its proofs against tampering."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from probanda.llm import merkle, queries

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _index int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[1], row[2], row[3], text)])


def climb(digests, fanout):
    """The root of a list of digests and for each of them the siblings left and right, level by level."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, way in enumerate(ways):
            first = at[k] // fanout * fanout
            way.append(("".join(digests[first : at[k]]), "".join(digests[at[k] + 1 : first + fanout])))
        at = [i // fanout for i in at]
        digests = [sha(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
    return digests[0], ways


def plain(rows, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in order}
    root, tops = climb([trees[s][0] for s in order], fanout) if order else (None, [])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            acc = leaf_of(r, r[4].translate({c: c + 32 for c in range(65, 91)}) if hit and r[4] is not None else r[4])
            for a, b in way + top:
                acc = sha(a, acc, b)
            out.append((r[0], leaf, trees[s][0], root, sha(*[a + b for a, b in way + top]), acc, acc == root))
    return sorted(out, key=str)


def made(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 16])
def test_trees_of_many_sizes(spark, fanout):
    rows, i = [], (1 << 53) + 1
    for s, n in (("one", 1), ("two", 2), (None, 3), ("full", 16), ("more", 17), ("zé", 33), ("hot", 600), ("", 5)):
        for _ in range(n):
            rows.append((i, s, "en", 7, f"Text Of {i}", "x", 1, "p"))
            i += 1
    docs = spark.createDataFrame(rows, KINDS).repartition(5)
    got = made(merkle.manifest(docs, fanout=fanout))
    assert got == plain(rows, fanout)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_tables(spark):
    odd = [(None, None, None, None, None), (None, "a", "en", 0, ""), (1, "a", None, None, "Same"), (1, "a", None, None, "Same"), (1, "a", "de", 3, "Other"), (2, "b", "en", 1, "A" * 200_000), (3, "b", "en", -1, "é\n12:x")]
    for rows in ([], odd[:1], odd, odd[2:3] * 70):
        got = made(merkle.manifest(spark.createDataFrame([(*r, "x", 1, "p") for r in rows], KINDS)))
        assert got == plain(rows)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE["op12_merkle"]).df()
    got = queries.op12_merkle(spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(want.columns)
    assert sorted(map(tuple, got[key].values.tolist()), key=str) == sorted(map(tuple, want[key].values.tolist()), key=str)
    assert not want.verified.all()


def test_no_shuffle_of_texts(spark):
    """What is joined has digests only: the scan of the texts feeds the staged leaves alone."""
    plan = merkle.manifest(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan

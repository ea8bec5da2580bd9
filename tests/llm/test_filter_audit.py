"""The filter audit against running all orders of the filters, row by row."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb

from probanda.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, source string, mask int, part string, kept long"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, hit in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= x <= "Z" for x in t) > 5 * len(t), any(x in "#$%&*|" for x in t), i is not None and i > first[t]), strict=True) if hit}
        docs.append((s or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for k, c in enumerate(order, 1):
                lost = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                failing = [d for d in docs if d[0] == part and c in d[1]]
                out[part, order, k] = [len(left), len(lost), len(failing) - len(lost), sum(d[1] == {c} for d in failing), sum(d[2] for d in lost), sum(d[3] for d in lost)]
                shapley[part, c] += len(lost)
    return sorted((p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items())


def made(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def texts():
    good = " ".join(f"word{i}" for i in range(60))
    return [good, good, good + " 5%", "short", "short", "", None, "SHOUT " * 60, "a b " * 40, "A" * 100_000, good.upper(), "one | two", "\t \n", "é " * 60]


def test_all_orders_row_by_row(spark):
    rows = [((1 << 53) + i if i % 7 else i, t, (None, "", "a", "bé")[i % 4]) for i, t in enumerate(texts() * 3)]
    rows += [(None, "short", "a"), (None, "short", "a"), (5, "twice", "a"), (5, "twice", "a"), (5, "short", None)]
    labels = [(r[0], k % 3, k % 2) for k, r in enumerate(rows) if k % 5] + [(None, 1, 1), (rows[3][0], 1, None), (10**6, 1, 1)]
    docs = spark.createDataFrame([(*r, 3, "p", 9) for r in rows], KINDS).repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert made(filter_audit.audit_texts(docs, table)) == plain(rows, labels)
    # a group of copies that is broadcast and one that is joined give the same
    lean = docs.selectExpr("doc_id AS k", "coalesce(text, '') AS d")
    for heavy in (1, 5, 10**6):
        got = filter_audit.marked_copies(lean, "k", "d", "c", heavy).collect()
        assert len(got) == len(rows) and all(r.c == (r.k is not None and any(x[0] is not None and x[0] < r.k and (x[1] or "") == r.d for x in rows)) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KINDS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert made(filter_audit.audit_texts(docs, labels)) == []
    rows = [(1, None, None)]
    assert made(filter_audit.audit_texts(spark.createDataFrame([(*r, 3, "p", 9) for r in rows], KINDS), labels)) == plain(rows, [])


def test_sums_are_inverted_exactly(spark):
    huge = spark.range(1).selectExpr(f"array({','.join(str((1 << 58) - 32 * i * i if i else (1 << 60)) + 'L' for i in range(8))}) AS x")
    held = huge.first().x
    want = [sum(v * (-1) ** (s & m).bit_count() for s, v in enumerate(held)) for m in range(8)]
    assert filter_audit.inverted(huge, "x", 3).first().x == [w >> 3 for w in want]


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE["op11_filter_audit"]).df()[COLUMNS]
    got = made(queries.op11_filter_audit(spark, SF))
    assert got == sorted(map(tuple, want.values.tolist()))
    counts = defaultdict(int)
    for r in got:
        counts[r[0]] += 1
    assert set(counts.values()) == {600}

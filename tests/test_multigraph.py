"""Walks and differences of edge tables against plain graph code."""

from collections import Counter, deque

import numpy as np
import pytest

from probanda.plans import multigraph as graph

KINDS = "source long, target long, label string"


def table(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def starts(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "node long")


def plain(rows, begin):
    depth = dict.fromkeys(begin, 0)
    todo = deque(begin)
    while todo:
        a = todo.popleft()
        for x, y, _ in rows:
            if x == a and y is not None and y not in depth:
                depth[y] = depth[a] + 1
                todo.append(y)
    return {n: (d, min((x for x, y, _ in rows if y == n and depth.get(x, 99) == d - 1), default=None)) for n, d in depth.items()}


@pytest.mark.parametrize("small", [0, 10**6])
def test_levels_are_breadth_first(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), "xy"[i % 2]) for i, (a, b) in enumerate(rng.integers(0, 60, (90, 2)))] + [(0, 0, "loop"), (0, 1, "x"), (0, 1, "x"), (None, 3, "n"), (4, None, "n")]
    edges = table(spark, rows).repartition(3)
    for begin in ((0,), (0, 7), ()):
        got = {r.node: (r.depth, r.parent) for r in graph.levels(edges, starts(spark, *begin)).collect()}
        assert got == plain(rows, begin)


def test_paths(spark):
    rows = [(1, 2, "b"), (1, 2, "a"), (2, 3, "c"), (1, 4, "d"), (4, 5, "e"), (5, 3, "f"), (6, 1, "g"), (3, 3, "h"), (8, 9, "i")]
    edges = table(spark, rows)
    assert [tuple(r) for r in graph.first_path(edges, 1, 3).orderBy("step").collect()] == [(0, 1, 2, "a"), (1, 2, 3, "c")]
    assert graph.first_path(edges, 3, 1) is None and graph.first_path(edges, 77, 1) is None and graph.first_path(edges, 1, 77) is None
    assert graph.first_path(edges, 1, 1).collect() == [] and graph.first_path(edges, 77, 77) is None
    assert graph.first_path(edges, 77, 77, starts(spark, 77)).collect() == []
    pairs = [(1, 3), (6, 5), (3, 1), (9, 8), (1, 1), (77, 77), (1, 9)]
    assert [graph.reachable(edges, a, b) for a, b in pairs] == [True, True, False, False, True, False, False]
    assert {tuple(r) for r in graph.successors(edges, starts(spark, 1, 3, 9)).collect()} == {(1, 2), (1, 4), (3, 3)}
    assert {tuple(r) for r in graph.predecessors(edges, starts(spark, 3)).collect()} == {(3, 2), (3, 5), (3, 3)}
    assert graph.between(edges, 1, 2).count() == 2 and graph.nodes(edges, starts(spark, 77)).count() == 9


def test_long_chain(spark):
    rows = [(i, i + 1, "x") for i in range(12)]
    assert graph.first_path(table(spark, rows), 0, 12).count() == 12


def test_parts_and_differences(spark):
    a = [(1, 2, "x")] * 3 + [(2, 3, None), (3, 4, "z"), (None, 1, "n")]
    b = [(1, 2, "x")] + [(2, 3, None)] * 2 + [(5, 6, "w"), (None, 1, "n")]
    got = Counter({(r.side, r.source, r.target, r.label): r.n for r in graph.difference(table(spark, a), table(spark, b)).collect()})
    left, right = Counter(a), Counter(b)
    assert got == Counter({("left", *k): n for k, n in (left - right).items()} | {("right", *k): n for k, n in (right - left).items()})
    assert {tuple(r) for r in graph.node_difference(table(spark, a), table(spark, b)).collect()} == {("left", 4), ("right", 5), ("right", 6)}
    assert graph.difference(table(spark, a), table(spark, a)).collect() == []
    kept = graph.subgraph(table(spark, a), starts(spark, 1, 2, 4)).select("source", "target", "label")
    assert [tuple(r) for r in kept.collect()] == [(1, 2, "x")] * 3
    mixed = table(spark, [(1, 2, "up"), (1, 2, "down"), (1, 2, "up"), (2, 1, "up"), (3, 4, None)])
    assert [tuple(r) for r in graph.conflicting(mixed, "label", ("up", "down")).collect()] == [(1, 2, 2, 1)]


def test_tree(spark):
    rows = [(1, 2, "a"), (1, 3, "b"), (2, 4, "c"), (4, 2, "back")]
    assert graph.to_text(graph.tree(table(spark, rows))) == "1\n  -> 2 a\n  -> 3 b\n  2\n    -> 4 c\n  3\n    4\n      -> 2 back"
    assert graph.to_text(graph.tree(table(spark, rows), 4)) == "4\n  -> 2 back\n  2\n    -> 4 c"
    assert graph.to_text(graph.tree(table(spark, []))) == "(empty graph)"

"""Constraint-based structure discovery over named columns: one job adds up the products, the small graph is found at the driver."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame

from . import ranks


def skeleton(cells: DataFrame, names: list[str], alpha: float = 0.05, deepest: int = 2) -> tuple[set[frozenset[str]], dict[frozenset[str], list[frozenset[str]]]]:
    """(edges, separating sets): edges whose ends stay dependent given every set of up to ``deepest`` neighbours, tested on ranks."""
    row = ranks.gram(cells, names, ranks=True).first()
    if row is None or row["n"] < 4:
        return set(), {}
    corr, n = ranks.correlations(row), row["n"]
    at = {v: k for k, v in enumerate(names)}
    edges = {frozenset(p) for p in combinations(names, 2)}
    parted: dict[frozenset[str], list[frozenset[str]]] = {}
    for depth in range(deepest + 1):
        gone = set()
        for edge in sorted(edges, key=sorted):
            x, y = sorted(edge)
            near = {v for e in edges for v in e if (x in e or y in e)} - {x, y}
            for given in combinations(sorted(near), depth):
                p = ranks.fisher_p(ranks.partial_from(corr, at[x], at[y], tuple(at[g] for g in given)), n, depth)
                if p == p and p >= alpha:  # NaN keeps the edge
                    gone.add(edge)
                    parted.setdefault(edge, []).append(frozenset(given))
        edges -= gone
    return edges, parted


def orient(names: list[str], edges: set[frozenset[str]], parted: dict[frozenset[str], list[frozenset[str]]]) -> set[tuple[str, str]]:
    """Arrows (from, to) of colliders that all separating sets agree on, then by the first two propagation rules."""
    arrows: set[tuple[str, str]] = set()
    linked = lambda a, b: frozenset((a, b)) in edges
    for z in names:
        for x, y in combinations([v for v in names if linked(v, z)], 2):
            sets = parted.get(frozenset((x, y)), [])
            if not linked(x, y) and sets and all(z not in s for s in sets):
                arrows |= {(x, z), (y, z)}
    arrows = {(a, b) for a, b in arrows if (b, a) not in arrows}
    while True:
        new = set()
        for a, b in arrows:
            new |= {(b, c) for c in names if c != a and linked(b, c) and not linked(a, c) and (c, b) not in arrows}  # no new collider
            new |= {(a, c) for c in names if (b, c) in arrows and linked(a, c) and (c, a) not in arrows}  # no cycle
        more = arrows | {(a, b) for a, b in new if (b, a) not in arrows and (b, a) not in new}
        if more == arrows:
            return arrows
        arrows = more


def pc(cells: DataFrame, names: list[str], alpha: float = 0.05, deepest: int = 2) -> dict:
    edges, parted = skeleton(cells, names, alpha, deepest)
    arrows = orient(names, edges, parted)
    return {"directed": sorted(arrows), "undirected": sorted(tuple(sorted(e)) for e in edges if not any((a, b) in arrows or (b, a) in arrows for a, b in [tuple(e)]))}

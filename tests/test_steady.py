"""Ranks over strata of equal rows: they tie, in whatever order the rows come."""

import random

import pytest
from pyspark.sql import functions as F

from probanda.functions.columns import steady_sums
from probanda.operators import ranks, strata

KIND = "env_name string, seed int, arm_key string, x double, y double"


def _copies(spark, copies):
    draw, out = random.Random(7), []
    base = [("e", s, "treatment" if k % 2 else "baseline", round(draw.uniform(800, 400_000), 2), round(draw.uniform(-999, 9999), 2)) for s in range(8) for k in range(60)]
    for c in range(copies):
        rows = [(f"e{c % 2}", s + 100 * c, *r) for _, s, *r in base]
        draw.shuffle(rows)
        out += rows
    return spark.createDataFrame(out, KIND).repartition(7)


def test_slopes_over_copies_of_strata_are_those_over_one(spark):
    one, many = _copies(spark, 1), _copies(spark, 24)
    for confound in (None, "x"):
        a, b = (ranks.cross_stratum_slope(t, "x", "y", ["seed"], confound=confound).first() for t in (one, many))
        assert (a.n, b.n) == (8, 192)
        assert a.rho is None and b.rho is None or b.rho == pytest.approx(a.rho, abs=1e-12)
    a, b = ({r.kind: r.rho for r in ranks.jci_panel(t, "x", "y", "env_name", ["env_name", "seed"]).collect()} for t in (one, many))
    for kind in ("marginal", "stratified", "stratified_partial"):
        assert b[kind] == pytest.approx(a[kind], abs=1e-12)


def test_effects_of_copies_tie_and_are_those_of_the_plain_panel(spark):
    many = _copies(spark, 24)
    panel = strata.steady_panel(many, "x", ["env_name", "seed"])
    assert panel.select("d").distinct().count() == 8
    plain = {r.seed: r for r in strata.stratum_panel(many, "x", ["env_name", "seed"]).collect()}
    for r in panel.collect():
        for c in ("mean_t", "mean_b", "sd_t", "sd_b", "d", "d_se"):
            assert r[c] == pytest.approx(plain[r.seed][c], rel=1e-11)


def test_steady_sums_of_odd_numbers(spark):
    rows = [(None, 1e300, 1.0), (None, -1e300, None), (None, 3.0, None), ("a", 0.1, float("nan")), ("a", 0.2, float("inf")), ("b", 0.0, -5e-324), ("b", -0.0, -2.5), ("c", -(2.0**51) - 0.5, None), ("c", 2.0**51, None)]
    got = {r.k: (r.v, r.v_n, r.w, r.w_n) for r in steady_sums(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], v=F.col("v"), w=F.col("w")).collect()}
    assert got[None][1:] == (3, 1.0, 1) and abs(got[None][0]) <= 3
    assert got["a"] == (pytest.approx(0.3, rel=1e-15), 2, None, 0)
    assert got["b"] == (0.0, 2, -2.5, 2)
    assert got["c"][:2] == (-0.5, 2)

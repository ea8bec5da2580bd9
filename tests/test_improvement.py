"""The probability of improvement and its interval against counting all pairs of resampled cells."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.operators import improvement
from test_mediation import drawn

KINDS = "env string, id string, arm_key string, v double"


def made():
    rng = np.random.default_rng(4)
    rows = [(env, f"{env}{i}", ("treatment", "baseline", "other")[i % 3], float(rng.integers(0, 6)) + shift * (i % 3 == 0)) for env, n, shift in (("a", 30, 1.0), ("b", 24, 0.0), ("c", 12, 2.0), (None, 18, -1.0)) for i in range(n)]
    return [*rows, ("a", "nan", "treatment", math.nan), ("a", "null", "baseline", None), ("b", "noarm", None, 3.0)]


def pairs(rows, env, replicate):
    weigh = lambda r: drawn(r[1], replicate) if replicate else 1
    side = lambda arm: [(r[3], weigh(r)) for r in rows if r[0] == env and r[2] == arm and r[3] is not None and not math.isnan(r[3])]
    t, b = side("treatment"), side("baseline")
    total = sum(w for _, w in t) * sum(w for _, w in b)
    return sum(w * x * ((v > u) + 0.5 * (v == u)) for v, w in t for u, x in b) / total if total else None


def test_replicates_count_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(improvement, "BLOCK", 4)
    rows = made()
    cells = spark.createDataFrame(rows, KINDS).repartition(3)
    got = {(r.env, r.replicate): r.p for r in improvement.replicates(cells, "v", ["env"], "id", count=6).collect()}
    assert {k[0] for k in got} == {"a", "b", None}  # c has four cells of an arm
    assert got == {(env, k): pytest.approx(pairs(rows, env, k)) for env in ("a", "b", None) for k in range(7)}
    row = improvement.mean_improvement(cells, "v", ["env"], "id", count=6).first()
    means = [np.mean([got[env, k] for env in ("a", "b", None)]) for k in range(7)]
    assert row.strata == 3 and row["mean"] == pytest.approx(means[0]) and [row.lower, row.upper] == pytest.approx(np.percentile(means[1:], [2.5, 97.5]).tolist())
    d = [got[env, 0] - 0.5 for env in ("a", "b", None)]
    assert row.exact and row.flips == 8 and row.p == np.mean([np.dot(d, s) >= sum(d) - 1e-12 for s in itertools.product((1, -1), repeat=3)])


def test_drawn_flips_are_near_exact_ones(spark):
    d = np.random.default_rng(3).normal(0.25, 1, 12)
    values = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(d)] + [("null", None)], "k string, d double")
    exact, some = (improvement.sign_flips(values, "d", F.col("k"), most=m, draws=4000).first() for m in (4096, 4095))
    assert exact.exact and exact.flips == 4096 and not some.exact and some.flips == 4000
    assert exact.p == np.mean([np.dot(d, s) >= d.sum() - 1e-12 for s in itertools.product((1, -1), repeat=12)])
    assert some.p == pytest.approx(exact.p, abs=0.03)


def test_no_strata(spark):
    for rows in ([], made()[-3:], [("a", None, "treatment", 1.0)] * 9):
        row = improvement.mean_improvement(spark.createDataFrame(rows, KINDS), "v", ["env"], "id", count=3).first()
        assert (row.strata, row["mean"], row.lower, row.p, row.flips) == (0, None, None, None, 0)
    one = [("a", None, arm, 1.0) for arm in ("treatment", "baseline") for _ in range(6)]
    row = improvement.mean_improvement(spark.createDataFrame(one, KINDS), "v", ["env"], "id", count=3).first()
    assert row.strata == 1 and row["mean"] == 0.5 and row.p == 1.0


def test_distinct_values_leave_few_rows_and_split_ties_meet(spark, monkeypatch):
    monkeypatch.setattr(improvement, "BLOCK", 4)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = []
    tallied = improvement._tallied

    def counted(rows, keys, size):
        kept.append((tallied(rows, keys, size).count(), size))
        return tallied(rows, keys, size)

    monkeypatch.setattr(improvement, "_tallied", counted)
    rng = np.random.default_rng(8)
    values = [*rng.normal(0, 1, 300).tolist(), *[0.25] * 60, *rng.integers(0, 3, 40).astype(float).tolist()]
    rows = [(env, f"{env}{i}", ("treatment", "baseline")[i % 2], v) for env in ("a", None) for i, v in enumerate(values)]
    cells = spark.createDataFrame(rows, KINDS)
    try:
        for most in (7, 200):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = {(r.env, r.replicate): r.p for r in improvement.replicates(cells, "v", ["env"], "id", count=5).collect()}
            assert got == {(env, k): pytest.approx(pairs(rows, env, k), rel=1e-12) for env in ("a", None) for k in range(6)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    # 800 cells in 4 partitions are 8 batches of 200 at most, each leaving its ends and a run or two between, not a row per value
    assert all(n <= 8 * 4 * size for n, size in kept[-2:])

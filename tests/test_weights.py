"""Weights of replicates: made once a cell, equal to those by hashlib, and summed up over equal rows before any rank."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from probanda.operators import mediation


def _by_hand(key, r, seed=42):
    digest = hashlib.md5(f"{seed}:{key}:{(r - 1) // 4}".encode()).hexdigest()
    u = int(digest[(r - 1) % 4 * 8 :][:8], 16)
    return sum(s <= u for s in mediation.poisson_steps())


def test_each_digest_is_made_once_and_the_weights_are_those_by_hand(spark):
    keys = spark.createDataFrame([(None,), ("0",), ("17",), ("é",)], "key string")
    drawn = keys.select("key", mediation.replicate_weights(F.col("key"), 3, 9).alias("w"))
    for row in drawn.collect():
        assert list(row.w) == [_by_hand("null" if row.key is None else row.key, r) for r in range(3, 12)]
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    # the comparisons with the steps stand in no lambda around the digest, where each made it again
    assert "filter(" not in plan and "conv(" not in plan


def test_equal_rows_are_summed_up_before_they_are_ranked(spark, monkeypatch):
    cells = spark.createDataFrame([("e", "ab"[c % 2], str(c), [float(c % 3), 1.0], [float(c % 2), 0.5]) for c in range(60)], "env_name string, arm_key string, cell string, o array<double>, m array<double>")
    seen, ranks = [], mediation.weighted_ranks

    def counted(rows, names, by, weights, size):
        seen.append(rows.count())
        return ranks(rows, names, by, weights, size)

    monkeypatch.setattr(mediation, "weighted_ranks", counted)
    rows = mediation.trajectories(cells, ["m"], "o", ["env_name"], "cell", replicates=3).collect()
    assert seen == [6 + 2]  # of burst 0 the pairs of (arm, outcome), the mediator following from the arm; of burst 1 the arms
    for r in rows:
        assert r.n == (60 if not r.replicate else sum(_by_hand(str(c), r.replicate) for c in range(60)))


def test_distinct_outcomes_leave_few_rows_and_split_ties_meet(spark, monkeypatch):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    outcomes = [(c * 37 % 400) / 7.0 if c % 3 else 20.0 for c in range(400)]
    rows = [("ab"[c % 2] if v != 20.0 else "abab"[c // 3 % 4], str(c), [v], [float(v > 25)]) for c, v in enumerate(outcomes)]
    cells = spark.createDataFrame([("e", *r) for r in rows], "env_name string, arm_key string, cell string, o array<double>, m array<double>")
    kept, summed = [], mediation._summed

    def counted(ranked, *rest):
        kept.append(ranked.count())
        return summed(ranked, *rest)

    monkeypatch.setattr(mediation, "_summed", counted)
    try:
        for most in (7, 200):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            for r in mediation.trajectories(cells, ["m"], "o", ["env_name"], "cell", replicates=3).collect():
                weights = [_by_hand(str(c), r.replicate) if r.replicate else 1 for c in range(400)]
                drawn = pd.DataFrame([(a, o[0], m[0]) for (a, _, o, m), w in zip(rows, weights, strict=True) for _ in range(w)], columns=["a", "o", "m"])
                corr = drawn.assign(a=(drawn.a == "b").astype(float)).rank().corr()
                ao, am, om = corr.loc["a", "o"], corr.loc["a", "m"], corr.loc["o", "m"]
                assert r.n == len(drawn) and r.marginal == pytest.approx(ao, abs=1e-10)
                assert r.conditional == pytest.approx((ao - am * om) / ((1 - am**2) * (1 - om**2)) ** 0.5, abs=1e-10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    # of some 270 distinct rows, each batch (at most two in each of four partitions) leaves its ends and four mixes of arm and mediator
    assert kept[-1] <= 8 * 8 < 200

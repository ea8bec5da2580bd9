"""Mediation along bursts against plain resampling, hand-made branches of every status, and odd tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.functions import special
from probanda.operators import bursts, mediation, strata

KINDS = "env_name string, cell string, arm_key string, m array<double>, k array<double>, o array<double>"


def made(n=24, seed=1, bursts=3, env="e"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        arm = i % 3 > 0
        m = (rng.normal(size=bursts) + arm).round(1)
        o = (m + 0.5 * rng.normal(size=bursts)).round(1)
        k = rng.integers(0, 3, bursts).astype(float)
        cut = bursts - (i % 5 == 0)  # ragged
        rows.append((env, f"c{i}", "b" if arm else "a", m[:cut].tolist(), k.tolist(), o.tolist()))
    rows[1][5][0] = math.nan
    return rows


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def plain(rows, weights, controls, min_n):
    """Per burst (n, marginal, conditional) of the rows, each repeated as often as its weight, ranked anew."""
    out = {}
    for b in range(max(len(r[5]) for r in rows)):
        x = []
        for r, w in zip(rows, weights, strict=True):
            values = [r[5][b] if b < len(r[5]) else math.nan, *[r[c][b] if b < len(r[c]) else math.nan for c in controls]]
            if not any(map(math.isnan, values)):
                x += [[float(r[2] == "b"), *values]] * w
        n = len(x)
        marginal = conditional = None
        if n >= max(min_n, 4):
            r = np.column_stack([ranks(c) for c in np.array(x).T])
            if (r.std(0)[:2] > 0).all():
                marginal = np.corrcoef(r[:, 0], r[:, 1])[0, 1]
            if n >= 5 and n > 3 + len(controls) and (r.std(0) > 0).all():
                z = np.column_stack([np.ones(n), r[:, 2:]])
                left = r[:, :2] - z @ np.linalg.lstsq(z, r[:, :2], rcond=None)[0]
                if (left.var(0) > 1e-9).all():
                    conditional = np.corrcoef(left.T)[0, 1]
        out[b] = (n, marginal, conditional)
    return out


def drawn(key, replicate, seed=42):
    digest = hashlib.md5(f"{seed}:{key}:{(replicate - 1) // 4}".encode()).hexdigest()
    at = (replicate - 1) % 4 * 8
    u, k, total, term = int(digest[at : at + 8], 16) / 2**32, 0, math.exp(-1), math.exp(-1)
    while u >= total:
        k += 1
        term /= k
        total += term
    return k


@pytest.mark.parametrize("controls", [["m"], ["m", "k"]])
def test_replicates_are_resamples(spark, monkeypatch, controls):
    monkeypatch.setattr(mediation, "BLOCK", 4)  # several passes
    rows = made()
    cells = spark.createDataFrame(rows, KINDS).repartition(3)
    got = {(r.burst, r.replicate): r for r in mediation.trajectories(cells, controls, "o", ["env_name"], "cell", min_n=5, replicates=9).collect()}
    columns = [{"m": 3, "k": 4}[c] for c in controls]
    assert {k[1] for k in got} == set(range(10))
    for replicate in range(10):
        want = plain(rows, [drawn(r[1], replicate) if replicate else 1 for r in rows], columns, 5)
        for b, (n, marginal, conditional) in want.items():
            r = got[b, replicate]
            assert r.n == n
            assert r.marginal == (None if marginal is None else pytest.approx(marginal, abs=1e-9))
            assert r.conditional == (None if conditional is None else pytest.approx(conditional, abs=1e-6))


def test_intervals_are_percentiles_of_the_replicates(spark):
    cells = spark.createDataFrame(made(40), KINDS)
    row = mediation.mediation(cells, ["m"], "o", ["env_name"], "cell", replicates=30).first()
    pools = mediation.pooled(mediation.trajectories(cells, ["m"], "o", ["env_name"], "cell", replicates=30), "marginal", 3, ["env_name", "replicate"], "p").collect()
    values = [r.p_dl for r in pools if r.replicate and r.p_dl is not None]
    assert [row.marginal_lower, row.marginal_median, row.marginal_upper] == pytest.approx(np.percentile(values, [2.5, 50, 97.5]).tolist())
    assert row.marginal_lower < row.marginal_dl < row.marginal_upper


def test_every_status(spark):
    rows = [("none", 0, 3, 0.9), ("flip", 0, 9, 0.5), ("flip", 1, 9, -0.4), ("noise", 0, 9, 0.5), ("noise", 1, 9, -0.04), ("weak", 0, 9, 0.1), ("weak", 1, 9, 0.9), ("steady", 0, 9, 0.5), ("steady", 1, 9, 0.9), ("null", 0, 9, None), (None, 0, 9, 0.1)]
    frame = spark.createDataFrame(rows, "env string, burst int, n long, marginal double")
    got = {r.env: r.status for r in mediation.statuses(frame, ["env"]).collect()}
    assert got == {"none": "UNDERPOWERED_BURSTS", "null": "UNDERPOWERED_BURSTS", "flip": "SIGN_FLIP_DETECTED", "noise": "CONSISTENT_DIRECTION", "weak": "WEAK_TIME_VARYING", "steady": "CONSISTENT_DIRECTION", None: "CONSISTENT_DIRECTION"}


def test_sign_flip_blanks_the_fixed_pools_alone(spark):
    rows = [("e", f"c{i}", "ab"[i % 2], [float(i), float(-i)], [0.0, 0.0], [float(i % 2) + i / 100, -float(i % 2) - i / 100]) for i in range(20)]
    row = mediation.mediation(spark.createDataFrame(rows, KINDS), ["m"], "o", ["env_name"], "cell").first()
    assert row.status == "SIGN_FLIP_DETECTED" and row.rho_marginal is None and row.rho_partial is None and row.marginal_dl is not None and row.marginal_i2 > 0.5


def disposed(spark, monkeypatch, separated):
    """The dispositions where (sibling, joint) say at each burst whether the mediators separate; None: no edge."""
    def edges(rows, given, *_):
        at = 0 if given == 1 else 1
        return spark.createDataFrame([("e", b, 30, x is not None, bool(x and x[at])) for b, x in enumerate(separated)], "env_name string, burst int, n long, edge boolean, separated boolean")

    monkeypatch.setattr(mediation, "trajectories", lambda *a, **k: None)
    monkeypatch.setattr(mediation, "with_edges", edges)
    return mediation.leak_adjudication(None, "m", ["k"], "o", ["env_name"], "cell").first()


def test_every_disposition(spark, monkeypatch):
    both, joint, sibling, neither = (True, True), (False, True), (True, False), (False, False)
    assert disposed(spark, monkeypatch, [joint, joint, None, None]).disposition == "UNDERPOWERED"
    assert disposed(spark, monkeypatch, [joint] * 4 + [both] * 3 + [None]).disposition == "UNDERPOWERED_FOR_GENUINE"
    genuine = disposed(spark, monkeypatch, [joint] * 6 + [neither, None])
    assert (genuine.disposition, genuine.b, genuine.c, genuine.marginal_edges) == ("GENUINE", 6, 0, 7)
    assert genuine.p == pytest.approx(1 / 64) and genuine.z == pytest.approx(5 / math.sqrt(6)) and genuine.separated_joint == pytest.approx(600 / 7)
    leak = disposed(spark, monkeypatch, [joint] * 5 + [sibling] * 2 + [both] * 5)
    assert (leak.disposition, leak.b, leak.c) == ("LEAK", 5, 2) and leak.p == pytest.approx(29 / 128)


def test_odd_tables(spark):
    args = (["m"], "o", ["env_name"], "cell")
    empty = spark.createDataFrame([], KINDS)
    assert mediation.mediation(empty, *args, replicates=3).collect() == [] and mediation.edge_counts(empty, *args, replicates=3).collect() == []
    assert mediation.leak_adjudication(empty, "m", ["k"], "o", ["env_name"], "cell").collect() == []
    one_arm = [("e", "c", "a", [1.0], [1.0], [1.0])] * 30
    nulls = [(None, None, None, None, None, None), (None, "c", "a", None, [1.0], []), (None, "d", "b", [None], None, [1.0])]
    assert mediation.mediation(spark.createDataFrame(one_arm + nulls, KINDS), *args, replicates=3).collect() == []
    same = [(None, None, a, [1.0, 2.0], [1.0, 1.0], [3.0, 3.0]) for a in "ab" * 15]
    row = mediation.mediation(spark.createDataFrame(same, KINDS), *args, replicates=3).first()
    assert row.status == "UNDERPOWERED_BURSTS" and row.marginal_dl is None and row.marginal_lower is None and row.marginal_bursts == 0


def test_p_values(spark):
    frame = spark.createDataFrame([(2.228138852, 10.0), (0.0, 3.0), (-12.706204736, 1.0), (None, 5.0), (1.0, 0.0), (math.inf, 4.0)], "t double, df double")
    got = [r.p for r in frame.select(special.t_p_column(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got == [pytest.approx(0.05, abs=1e-8), pytest.approx(1.0), pytest.approx(0.05, abs=1e-8), None, None, 0.0]
    tails = spark.createDataFrame([(k, n) for n in (0, 1, 7, 40, 3000) for k in range(0, n + 2, max(1, n // 9))], "k long, n long")
    for p in (0.5, 0.025):
        for r in tails.select("k", "n", special.binomial_tail_column(F.col("k"), F.col("n"), p).alias("p")).collect():
            assert r.p == pytest.approx(special.binomial_tail(r.k, r.n, p), rel=1e-8, abs=1e-300)


def test_phases_count_significant_bursts_of_the_sign(spark):
    links = spark.createDataFrame([("e", 0, 30, 0.9), ("e", 1, 30, 0.1), ("e", 2, 30, -0.9), ("e", 3, 2, None), ("f", 0, 5, 1.0)], "env string, burst int, n_pairs long, r double")
    got = {r.env: r for r in bursts.phase_consistency(links, 1, by=["env"]).collect()}
    assert (got["e"].bursts, got["e"].significant, got["e"].share) == (4, 1, 0.25)
    assert got["e"].p == pytest.approx(special.binomial_tail(1, 4, 0.025)) and got["f"].significant == 1
    assert bursts.phase_consistency(links.limit(0), 1, by=["env"]).collect() == []


def test_classes_of_envs_and_cells(spark):
    rows = [("a", 6.0, 1.0), ("a", 9.6, 1.0), ("a", 10.0, 5.0), ("b", 3.0, 1.0), ("b", None, None), ("c", 1.0, 9.0), ("d", math.nan, 2.0), (None, 1.0, 1.0)]
    cells = spark.createDataFrame(rows, "env string, best double, final double")
    levels = {"a": 5.0, "c": 5.0, "d": 5.0}
    got = {r.env: (r["class"], r.best_rate, r.final_rate, r.n) for r in strata.classify_envs(cells, "env", "best", "final", levels).collect()}
    assert got == {"a": ("partial", 1.0, pytest.approx(1 / 3), 3), "b": ("absent", None, None, 2), "c": ("solved", 0.0, 1.0, 1), "d": ("unsolved", 0.0, 0.0, 1)}
    kinds = [(r.env, r.cell_class) for r in strata.with_cell_class(cells, "env", "best", levels).orderBy("env", F.desc_nulls_last("best")).collect() if r.env]
    assert kinds == [("a", "saturated"), ("a", "solved"), ("a", "solved"), ("b", "saturated"), ("b", "missing"), ("c", "saturated"), ("d", "missing")]
    assert strata.with_cell_class(spark.createDataFrame([("a", 9.9995, 1.0), ("a", 10.0, 1.0), ("a", 4.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0)], "env string, best double, final double"), "env", "best", levels).groupBy("cell_class").count().orderBy("cell_class").collect() == [("no_threshold", 1), ("saturated", 3), ("unsolved", 1)]


def test_cells_of_wanted_classes(spark):
    cells = spark.createDataFrame([("a", 10.0), ("a", 9.9), ("a", 6.0), ("a", 1.0), ("a", None), ("b", 3.0)], "env string, v double")
    classes = strata.classify_envs(cells, "env", "v", "v", {"a": 5.0}, solved=0.7)
    assert {r["env"]: r["class"] for r in classes.collect()} == {"a": "solved", "b": "absent"}
    assert strata.filter_to_classes(cells, classes, "env", "solved").count() == 5

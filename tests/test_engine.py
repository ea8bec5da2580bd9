"""Null, NaN, ties and degenerate strata, closed forms, and the plans around the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.functions import arrays, columns, effects, special
from probanda.operators import bursts, discovery, frames, paired, ranks, regression, strata
from probanda.plans import bridge, evidence, panel, queries  # noqa: F401  registers the analyses
from probanda.plans.contrast import Contrast
from probanda.sources import runs

NAN = float("nan")


def cells(spark, rows):
    return spark.createDataFrame(rows, "id string, env_name string, arm_key string, seed long, v double")


def test_predicates_drop_nan(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (float("inf"),), (-2.0,)], "v double")
    assert df.where(columns.finite_gt("v", 0)).count() == 1
    assert df.where(columns.finite_between("v", -3, 3)).count() == 2
    assert df.select(columns.partition_aggregate("v", [], "mean").alias("m")).first()["m"] == -0.5


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, "a")], ["optimizer.inner.lr", "k"])
    assert strata.per_stratum_aggregate(df, "optimizer.inner.lr", ["k"], "mean").first()["value"] == 1.0


def test_stratum_needs_both_arms(spark):
    df = cells(spark, [(str(i), e, a, i, float(i)) for e, arms in (("x", ("treatment", "baseline")), ("y", ("treatment",))) for a in arms for i in range(4)])
    p = strata.stratum_panel(df, "v", ["env_name"]).collect()
    assert [r["env_name"] for r in p] == ["x"] and p[0]["d"] == 0.0


def test_paired_g_against_numpy(spark):
    rng = np.random.default_rng(0)
    b, t = rng.normal(0, 1, 30), rng.normal(1, 1, 30)
    df = cells(spark, [(f"{a}{i}", "e", a, i, float(x[i])) for a, x in (("treatment", t), ("baseline", b)) for i in range(30)])
    r = paired.paired_g(paired.pairs(df, "v", ["seed"])).first()
    d = t - b
    g = d.mean() / d.std(ddof=1) * (1 - 3 / (4 * 30 - 5))
    assert r["g"] == pytest.approx(g) and r["g_se"] == pytest.approx(math.sqrt(1 / 30 + g * g / 60))


def test_equal_differences_and_single_pair(spark):
    same = cells(spark, [(f"{a}{i}", "e", a, i, 1.0 if a == "treatment" else 0.0) for a in ("treatment", "baseline") for i in range(5)])
    r = paired.paired_g(paired.pairs(same, "v", ["seed"])).first()
    assert r["g"] == 0.0 and r["g_se"] is None
    one = paired.paired_g(paired.pairs(same.where("seed = 0"), "v", ["seed"])).first()
    assert one["g"] is None


def test_duplicates_raise(spark):
    df = cells(spark, [("a", "e", "treatment", 0, 1.0), ("b", "e", "treatment", 0, 2.0), ("c", "e", "baseline", 0, 0.0)])
    assert paired.pairs(df, "v", ["seed"]).first()["delta"] == 1.5
    with pytest.raises(paired.DuplicatePairs):
        paired.pairs(df, "v", ["seed"], dedupe="raise")


def test_dl_pool_against_numpy(spark):
    y, s = np.array([0.2, 0.5, 0.9, 0.1]), np.array([0.1, 0.2, 0.15, 0.3])
    r = effects.dl_pool(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s)] + [(None, 0.1), (1.0, 0.0)], "y double, s double"), "y", "s").first()
    w = 1 / s**2
    q = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    tau2 = max(0, (q - 3) / (w.sum() - (w**2).sum() / w.sum()))
    v = 1 / (s**2 + tau2)
    assert (r["k"], r["q"], r["tau2"], r["pooled"]) == (4, pytest.approx(q), pytest.approx(tau2), pytest.approx((v * y).sum() / v.sum()))


def test_special_functions():
    assert special.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert special.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert special.nct_cdf(1.0, 10, 0.0) == pytest.approx(special.t_cdf(1.0, 10))
    assert special.mde_paired(30) == pytest.approx(0.5296, abs=2e-3)
    assert special.binomial_p(9, 10) == pytest.approx(22 / 1024)
    assert special.recommended_n_paired(0.5) == 34


def test_spearman_with_ties_and_constants(spark):
    x, y = [1, 1, 2, 3, 3, 3, 8], [2, 1, 2, 5, 5, 9, 7]
    df = spark.createDataFrame([("a", float(i), float(j)) for i, j in zip(x, y)] + [("b", 1.0, float(j)) for j in y] + [("a", NAN, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in ranks.spearman(df, "x", "y", ["k"]).collect()}
    import pandas as pd

    assert got["a"]["rho"] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank())) and got["a"]["n"] == 7
    assert got["b"]["rho"] is None


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],), (None,), ([7.0],)], "x array<double>")
    x = F.col("x")
    rows = df.select(arrays.mean_window(x, 0.4, 0.8).alias("w"), arrays.auc(x).alias("a"), arrays.plateau_slope(x).alias("p"), arrays.autocorrelation(x, 1).alias("c"), arrays.repeat_rate(x, 2).alias("r"), arrays.time_to(x).alias("t"), arrays.by_burst(x, 2).alias("b")).collect()
    assert rows[0]["w"] == 3.5 and rows[0]["a"] == 3.0 and rows[0]["c"] == pytest.approx(1.0) and rows[0]["r"] == 0.0 and rows[0]["t"] == 0.5 and rows[0]["b"] == [1.5, 4.0]
    assert rows[1]["w"] is None and rows[2]["w"] is None and rows[3]["w"] == 7.0 and rows[3]["a"] is None


def test_regression_and_identification(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=400)
    x = z + rng.normal(size=400)
    y = 2 * x - 3 * z + 1 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)], "x double, y double, z double")
    edges = {("z", "x"), ("z", "y"), ("x", "y")}
    found = regression.backdoor_ate(df, edges, "x", "y", ["z"])
    assert found["adjusted_for"] == ["z"] and found["ate"] == pytest.approx(2, abs=0.05)
    assert regression.backdoor_ate(df, edges, "x", "y", []) == {"identified": False}
    with pytest.raises(ValueError):
        regression.ols(df.withColumn("w", F.col("x") * 2), "y", ["x", "w"])


def test_collider_is_oriented(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=800), rng.normal(size=800)
    c = a + b + rng.normal(0, 0.3, 800)
    df = spark.createDataFrame([(float(i), float(j), float(k)) for i, j, k in zip(a, b, c)], "a double, b double, c double")
    assert discovery.pc(df, ["a", "b", "c"])["directed"] == [("a", "c"), ("b", "c")]


def test_union_dedup_and_audits(spark):
    a = spark.createDataFrame([("1", 2, "<f object at 0x7f>"), ("2", 2, "<f object at 0x80>")], "id string, v int, f string")
    b = spark.createDataFrame([("3", 5.5)], "id string, w double")
    assert frames.diagonal_union([a, b]).count() == 3
    assert [r["id"] for r in frames.dedup_by_content(a).collect()] == ["1"]
    assert {r["column"] for r in frames.distinguishing_columns(a, ["v"]).collect()} == {"id", "f"}
    assert frames.contamination(a, b).groupBy("kind").count().count() == 2


def test_bridge_gates_and_verdict(spark):
    rows = [(f"{e}{a}{i}", e, a, i, float(i) / 50 + (a == "treatment")) for e in "abcdef" for a in ("treatment", "baseline") for i in range(12)]
    df = cells(spark, rows)

    @bridge.claim_bridge(source="v", target="t", contrast=Contrast(), pair_by=("env_name", "seed"), stratify_by=("env_name",), predicted="positive", tier="interventional")
    def treated_is_higher(pooled):
        return effects.random_effects_verdict(pooled, "positive")

    result = bridge.evaluate(treated_is_higher, df)
    assert result.verdict == "held" and result.extent
    assert bridge.evaluate(treated_is_higher, df.where("arm_key = 'baseline'")).findings[-1].gate == "contrast_present"
    assert bridge.evaluate(treated_is_higher, df.drop("v")).verdict == "inadmissible"
    manifest = {"treated_is_higher": {"source": bridge.source_hash(treated_is_higher), "verdict": "held"}}
    assert bridge.audit(manifest, [result]) == []
    e = evidence.edges(spark, [result], bridge.CLAIMS)
    assert e.first()["level"] == "causal_one_sided" and evidence.clusters(e).first()["cluster_verdict"] == "supported"
    assert bridge.extent_hash(df).first() == bridge.extent_hash(df.union(df).orderBy(F.rand(1))).first()


def test_value_contrast(spark):
    df = spark.createDataFrame([(1, True), (0, True), (1, False)], "a int, b boolean")
    c = Contrast.from_values({"a": 1.0, "b": True}, {"a": 0, "b": 1})
    assert sorted(r["contrast_arm"] for r in c.applied(df).collect()) == ["baseline", "treatment"]
    with pytest.raises(ValueError):
        Contrast.from_values({"a": NAN}, {"a": 1})


def test_metrics_fill_gaps(spark):
    panel.metric("twice", "v")(lambda: F.col("v") * 2)
    panel.metric("thrice", "twice", "v")(lambda: F.col("twice") + F.col("v"))
    df = spark.createDataFrame([(1.0, None), (2.0, 100.0)], "v double, thrice double")
    assert [r["thrice"] for r in panel.with_metrics(df, ["thrice"]).collect()] == [3.0, 100.0]
    with pytest.raises(KeyError):
        panel.with_metrics(df, ["unknown"])


def test_run_reader(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"run_id": "a", "x": 1}\n{"run_id": "b", "x": 2}\n')
    (tmp_path / "evaluations.jsonl").write_text('{"run_id": "a", "checkpoint": 10, "evaluation_seed": 1, "o": 0.5}\n')
    r = runs.load_runs(spark, str(tmp_path))
    assert r.count() == 2 and runs.load_evaluations(spark, str(tmp_path), r).count() == 1
    (tmp_path / "runs.jsonl").write_text('{"run_id": "a", "x": 1}\n{"run_id": "a", "x": 2}\n')
    with pytest.raises(ValueError):
        runs.load_runs(spark, str(tmp_path))


def test_live_record(spark, tmp_path):
    from probanda.streaming import live

    df = cells(spark, [("a", "e", "treatment", 0, 1.0), ("b", "e", "baseline", 0, 0.0)])
    df.write.parquet(str(tmp_path / "in"))
    live.watch(spark, str(tmp_path / "in"), df.schema, lambda x: x.groupBy("arm_key").count(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sign_permutation():
    assert special.sign_permutation_p([1.0, 2.0, 3.0]) == 0.25
    assert special.sign_permutation_p([]) != special.sign_permutation_p([])
    assert special.sign_permutation_p([0.5] * 20) < 0.01


def test_moderation_and_audit(spark):
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=300), rng.uniform(size=300)
    y = x + 2 * x * (z > 0.5) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c), f"e{i % 3}") for i, (a, b, c) in enumerate(zip(x, y, z))], "x double, y double, z double, env string")
    found = regression.moderation(df, "x", "y", "z", 0.5, "env")
    assert found["interaction"] == pytest.approx(2, abs=0.1) and found["p"] < 1e-6
    audit = regression.tautology_audit(df, {"y": {"x", "z"}, "o": {"x"}}, "y", "o", ["x"])
    assert audit["reads_jaccard"] == 0.5 and audit["r2"]["x"] > 0.5


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_links_whatever_the_scale(spark, scale):
    rng = np.random.default_rng(6)
    rows = [("e", i, arm, [float(scale * (i * k + rng.normal()))], [float(scale * (-i * k + rng.normal()))]) for i in range(40) for arm, k in (("treatment", 2), ("baseline", 1))]
    cells = spark.createDataFrame(rows, "env string, seed long, arm_key string, p array<double>, t array<double>")
    link = bursts.link_per_burst(cells, "p", "t", "env", ["seed"]).first()
    assert link.n_pairs == 40 and link.r == pytest.approx(0.99, abs=0.02) and link.slope == pytest.approx(1, abs=0.1)
    flat = cells.withColumn("p", F.array(F.lit(0.1 * scale)))
    assert bursts.link_per_burst(flat, "p", "t", "env", ["seed"]).first().r is None


def test_pool_flags(spark):
    rows = spark.createDataFrame([(4, 0.0), (4, 0.01), (5, 0.0), (9, 0.019), (9, 0.02), (10, 0.01), (3, None)], "k long, tau2 double")
    got = [r.f for r in rows.select(effects.pool_flags(F.col("k"), F.col("tau2")).alias("f")).collect()]
    assert got == [["small_k"], ["small_k", "clipped_tau2"], [], ["clipped_tau2"], [], [], ["small_k"]]


def test_alignment_either_way(spark):
    x = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 0.0), ("d", 2.0), ("e", None)], "env string, d double")
    y = spark.createDataFrame([("a", -1.0), ("b", 1.0), ("c", -3.0), ("d", -0.1), ("e", 1.0)], "env string, d double")
    both = {a: strata.alignment_test(x, y, ["env"], a).first() for a in ("same", "opposite")}
    assert [(r.aligned, r.strata) for r in both.values()] == [(1, 4), (3, 4)] and both["opposite"].p == pytest.approx(5 / 16) and both["same"].p == pytest.approx(15 / 16)
    assert strata.alignment_test(x, y, ["env"], "opposite", floor_y=0.5).first().strata == 3
    assert tuple(strata.alignment_test(x.limit(0), y, ["env"]).first()) == (0, 0, None)
    with pytest.raises(ValueError):
        strata.alignment_test(x, y, ["env"], "both")

"""Readers of run folders, caches of panels, merges and registries."""

import json

import pytest
from pyspark.sql import functions as F

from probanda.functions import columns, special
from probanda.operators import frames, ranks, strata
from probanda.plans import bridge, panel
from probanda.plans.contrast import Contrast
from probanda.sources import runs


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "a [b]"
    (root / "configs").mkdir(parents=True)
    base = {"r1": -100.0, "r2": -90.0}
    with open(root / "runs.jsonl", "w") as f:
        for i, (r, key) in enumerate((("r1", 7), ("r2", 9))):
            f.write(json.dumps({"run_id": r, "pair_key": key, "arm_key": ("baseline", "treatment")[i]}) + "\n")
            (root / "configs" / f"{r}.json").write_text(json.dumps({"optimizer": {"inner": {"lr": 1e-4 * (i + 1)}}, "layers": [1, 2], "seed": key}))
    with open(root / "evaluations.jsonl", "w") as f:
        for r in base:
            for c in (10, 20):
                for s in (101, 102):
                    f.write(json.dumps({"run_id": r, "checkpoint": c, "evaluation_seed": s, "ret": base[r] + c / 10 + s - 101}) + "\n")
    (root / "provenance.json").write_text(json.dumps({"producer": "lab"}))
    return str(root)


def test_a_run_folder_comes_with_configurations_and_outcomes(spark, folder):
    got = {r["id"]: r.asDict() for r in runs.load_folder(spark, folder).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"]["producer"] == "lab"
    assert got["r2"]["config.optimizer.inner.lr"] == 2e-4 and list(got["r1"]["config.layers"]) == [1, 2]
    assert got["r1"]["ret_mean"] == -97.5 and got["r1"]["ret_mean_at_10"] == -98.5 and got["r1"]["ret_terminal_n"] == 2 and got["r1"]["ret_auc"] == -98.0
    assert runs.config_columns(spark, folder) == {"config.optimizer.inner.lr", "config.layers", "config.seed"}


def test_an_absent_store_is_empty(spark, tmp_path):
    root = str(tmp_path / "c")
    spark.createDataFrame([("a", 1)], "id string, v int").write.parquet(f"{root}/runs.parquet")
    assert runs.measurement_store(spark, root).count() == 0
    assert runs.load_corpus(spark, root, measurements=True).count() == 1


def test_panels_come_back_from_their_cache(spark, tmp_path):
    cells = spark.createDataFrame([("a", "e", 1.0), (None, "e", 2.0)], "id string, env_name string, v double")
    p = panel.Panel(cells, ("env_name",), ("v > 0",), ("here",), frozenset({"env_name"}))
    panel.to_cache(p, str(tmp_path / "p"), {"m": "1"})
    q = panel.from_cache(spark, str(tmp_path / "p"), {"m": "1"})
    assert (q.stratify_by, q.scopes, q.sources, q.leaves) == (p.stratify_by, p.scopes, p.sources, p.leaves) and q.cells.count() == 2
    with pytest.raises(ValueError):
        panel.from_cache(spark, str(tmp_path / "p"), {"m": "2"})


def test_repeats_leave_one_row(spark):
    rows = [("b", 1.0), ("a", 1.0), ("a", 1.0), (None, 1.0), (None, 2.0), ("c", None), ("c", None)]
    got = frames.dedup_by_content(spark.createDataFrame(rows, "id string, v double")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 1.0), (None, 2.0), ("c", None)]))


def test_merges_are_checked(spark):
    a, b = (spark.createDataFrame(x, "id string, v int") for x in ([("a", 1)], [("b", 2)]))
    assert frames.merged_shards([a, b]).count() == 2
    with pytest.raises(ValueError):
        frames.merged_shards([a, a])


def test_columns_are_put_once(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert frames.put_column(df, "v", F.col("v")).columns == ["v"]
    with pytest.raises(ValueError):
        frames.put_column(df, "v", F.lit(2.0))
    names = ["ret_mean", "ret_mean_at_10", "ret_mean_at_200", "len_auc", "id"]
    assert frames.outcome_family(names) == {"len": ["len_auc"], "ret": ["ret_mean", "ret_mean_at_10", "ret_mean_at_200"]}
    assert frames.terminal_checkpoints(names) == {"ret": 200}


def test_ranks_of_ties_nulls_and_strata(spark):
    rows = [(k, v, -v if v is not None else None) for k in ("a", "b", None) for v in (1.0, 1.0, 2.0, 5.0, None, float("nan"), -0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = sorted((str(r.k), r.r0, r.r1) for r in ranks.ranked(df, ["x", "y"], ["k"]).collect())
    assert got == sorted((k, a, 7 - a) for k in ("a", "b", "None") for a in (1.5, 1.5, 3.5, 3.5, 5.0, 6.0))
    assert ranks.ranked(df.limit(0), ["x", "y"], ["k"]).count() == 0


def test_running_sums_cross_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"), F.lit(1).alias("n"))
    got = columns.running(df, ["k"], "v", ["n"]).collect()
    assert all(r.n_before == r.v // 2 for r in got) and len(got) == 1000


def test_p_values_as_columns(spark):
    df = spark.createDataFrame([(5, 5, 1.96), (3, 5, 0.0), (0, 0, -4.0)], "k int, n int, z double")
    got = df.select(special.binomial_p_column(F.col("k"), F.col("n")).alias("b"), special.normal_p_column(F.col("z")).alias("p"), "k", "n", "z").collect()
    for r in got:
        assert r.b == (pytest.approx(special.binomial_p(r.k, r.n)) if r.n else None)
        assert r.p == pytest.approx(special.normal_p(r.z), rel=1e-5)


def test_any_block_ends_a_claim(spark):
    def two(claim, cells):
        yield bridge.Finding("block", "two", "no")
        yield bridge.Finding("warn", "two", "hm")

    claim = bridge.Claim("c", lambda: "held", "v", "t", Contrast(), gates=(two,), predicted="positive")
    cells = spark.createDataFrame([(str(i), a, float(i)) for i in range(20) for a in ("treatment", "baseline")], "id string, arm_key string, v double")
    assert bridge.evaluate(claim, cells).verdict == "inadmissible"


def test_metric_hashes_see_what_is_captured():
    def made(k):
        return lambda: F.col("v") * k

    assert panel.Metric("m", (), made(1)).hash() != panel.Metric("m", (), made(2)).hash()
    assert panel.Metric("m", (), made(1)).hash() == panel.Metric("m", (), made(1)).hash()

"""The store of measurements: what is computed, what is kept, and what a reader sees."""

import math

import pytest
from pyspark.sql import functions as F

from probanda.plans import materialise as store
from probanda.plans import panel

KINDS = "id long, x double, y double"


@pytest.fixture
def registry(monkeypatch):
    held = dict(panel.METRICS)
    monkeypatch.setattr(panel, "METRICS", held)
    monkeypatch.setattr(store, "METRICS", held)
    panel.METRICS["double_x"] = panel.Metric("double_x", ("x",), lambda: F.col("x") * 2)
    panel.METRICS["sum_xy"] = panel.Metric("sum_xy", ("double_x", "y"), lambda: F.col("double_x") + F.col("y"))
    return held


def values(spark, root, *names):
    return {r.id: tuple(r[n] for n in names) for r in store.stored(spark, root).collect()}


def test_only_what_is_missing_is_computed(spark, registry, tmp_path):
    root = str(tmp_path)
    assert store.stored(spark, root) is None and store.manifest(spark, root) == [] and store.drifted(spark, root) == []
    first = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 2.0), (None, 9.0, 9.0)], KINDS)
    assert {tuple(r) for r in store.gaps(spark, root, first, ["sum_xy"]).collect()} == {(i, n) for i in (1, 2) for n in ("double_x", "sum_xy")}
    assert store.materialise(spark, root, first, ["sum_xy"]) == {"double_x": 2, "sum_xy": 2}
    # 1 is done, 2 has a value to read now, 3 is new and carries a value of its own
    second = spark.createDataFrame([(1, 50.0, 1.0, None), (2, 4.0, 2.0, math.nan), (3, 7.0, 3.0, 100.0)], KINDS + ", double_x double")
    assert {tuple(r) for r in store.gaps(spark, root, second, ["sum_xy"]).collect()} == {(2, "double_x"), (2, "sum_xy"), (3, "sum_xy")}
    assert store.materialise(spark, root, second, ["sum_xy"]) == {"double_x": 1, "sum_xy": 2}
    part = spark.read.parquet(store.manifest(spark, root)[-1]["path"])
    assert sorted(r.id for r in part.collect()) == [2, 3]  # the cell that had all of it isn't written again
    assert values(spark, root, "double_x", "sum_xy") == {1: (2.0, 3.0), 2: (8.0, 10.0), 3: (100.0, 103.0)}
    assert store.materialise(spark, root, second, ["sum_xy"]) == {} and len(store.manifest(spark, root)) == 2


def test_forced_and_drifted_metrics_are_computed_again(spark, registry, tmp_path):
    root, cells = str(tmp_path), spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0)], KINDS)
    store.materialise(spark, root, cells, ["sum_xy"])
    moved = spark.createDataFrame([(1, 10.0, 1.0, 5.0)], KINDS + ", double_x double")
    assert store.materialise(spark, root, moved, ["double_x"], force={"double_x"}) == {"double_x": 1}  # its own value doesn't count either
    assert values(spark, root, "double_x") == {1: (20.0,), 2: (4.0,)}
    registry["double_x"] = panel.Metric("double_x", ("x",), lambda: F.col("x") * 3)
    assert store.drifted(spark, root) == ["double_x", "sum_xy"]  # the one reads the other
    assert store.stored(spark, root) is None and store.stored(spark, root, current=False).count() == 2
    assert store.materialise(spark, root, cells, ["sum_xy"]) == {"double_x": 2, "sum_xy": 2}
    assert values(spark, root, "double_x", "sum_xy") == {1: (3.0, 4.0), 2: (6.0, 8.0)} and store.drifted(spark, root) == []
    store.compact(spark, root)
    assert len(store.manifest(spark, root)) == 1 and values(spark, root, "double_x", "sum_xy") == {1: (3.0, 4.0), 2: (6.0, 8.0)}


def test_recoverable_metrics(spark, registry, tmp_path):
    root = str(tmp_path)
    store.materialise(spark, root, spark.createDataFrame([(1, None, 1.0), (2, None, 2.0)], KINDS), ["sum_xy"])
    assert store.recoverable(spark, root, spark.createDataFrame([(1, 1.0)], "id long, y double"), ["sum_xy"]) == []
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, math.nan, 2.0)], KINDS)
    assert store.recoverable(spark, root, cells, ["double_x", "sum_xy"]) == ["double_x", "sum_xy"]
    assert store.materialise(spark, root, cells, ["sum_xy"]) == {"double_x": 2, "sum_xy": 2}
    assert store.recoverable(spark, root, cells, ["double_x", "sum_xy"]) == []
    assert store.materialise(spark, root, cells, ["sum_xy"]) == {"double_x": 1, "sum_xy": 1}  # NaN stays a gap


def test_odd_tables(spark, registry, tmp_path):
    root = str(tmp_path)
    assert store.materialise(spark, root, spark.createDataFrame([], KINDS), ["sum_xy"]) == {}
    assert store.materialise(spark, root, spark.createDataFrame([(1, 1.0, 1.0)], KINDS), ["x"]) == {}
    with pytest.raises(KeyError):
        store.materialise(spark, root, spark.createDataFrame([(1, 1.0)], "id long, x double"), ["sum_xy"])
    store.materialise(spark, root, spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0)], KINDS), ["sum_xy"])
    assert values(spark, root, "sum_xy") == {1: (3.0,)}


def test_a_lost_write_changes_nothing(spark, registry, tmp_path, monkeypatch):
    root, cells = str(tmp_path), spark.createDataFrame([(1, 1.0, 1.0)], KINDS)
    store.materialise(spark, root, cells, ["double_x"])
    (tmp_path / "measurements" / "manifest" / "00000002").mkdir()  # begun, without its mark of success
    assert values(spark, root, "double_x") == {1: (2.0,)}
    assert store.materialise(spark, root, cells, ["sum_xy"]) == {"sum_xy": 1}
    assert values(spark, root, "double_x", "sum_xy") == {1: (2.0, 3.0)}

"""Fits on tables of any size: bounded blocks per task, and the same models."""

import pytest

from staylens import session
from staylens.operators import clustering as CL
from staylens.operators import models as M


def rows(spark, n=400):
    return spark.createDataFrame([(i, float(i % 7), float(i % 11), float(i % 7 * 2 + i % 3), i % 2) for i in range(n)],
                                 "id long, a double, b double, y double, cluster int").coalesce(1)


def test_partitions_follow_the_rows(spark, monkeypatch):
    df = rows(spark)
    assert session.by_size(df, 100).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "TASK_BYTES", 4000)
    dealt = session.by_size(df, 100)
    sizes = dealt.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == 10 and max(sizes) <= 44 and sum(sizes) == 400


def test_tree_and_kmeans_fits_take_sized_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(session, "TASK_BYTES", 4000)
    for kind in (M.RandomForestRegressor, M.GBTRegressor, CL.KMeans):
        monkeypatch.setattr(kind, "fit", lambda self, data, fit=kind.fit: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    df = rows(spark)
    forest = M.fit_forest(df, ["a", "b"], "y", numTrees=5)
    assert forest.getNumTrees == 5
    M.fit_gbt(df, ["a", "b"], "y", maxIter=2)
    CL.kmeans_spark(df, ["a", "b"], k=2)
    assert len(seen) == 3 and min(seen) >= 10


def test_large_segments_are_fitted_one_by_one(spark, monkeypatch):
    running, most = [], []
    fit = M.RandomForestRegressor.fit

    def watched(self, data, *a):
        running.append(1)
        most.append((len(running), data.rdd.getNumPartitions()))
        try:
            return fit(self, data, *a)
        finally:
            running.pop()

    monkeypatch.setattr(M.RandomForestRegressor, "fit", watched)
    spec = M.SegmentSpec(target_col="y", numeric_cols=["a", "b"], model_types=["linear", "rf"], rf_grid={"numTrees": [3, 4]})
    small, _ = M.train_segments(rows(spark), spec, key="id", tune=False)
    most.clear()
    monkeypatch.setattr(session, "TASK_BYTES", 8000)
    large, _ = M.train_segments(rows(spark), spec, key="id", tune=False)
    assert [n for n, _ in most] == [1, 1] and min(p for _, p in most) >= 10
    a, b = ({(r["cluster"], r["model_type"]): r for r in t.collect()} for t in (small, large))
    assert a.keys() == b.keys() and len(a) == 4
    for k in a:
        assert a[k]["status"] == b[k]["status"] == "ok" and a[k]["samples"] == b[k]["samples"]
        if k[1] == "linear":
            assert a[k]["rmse"] == pytest.approx(b[k]["rmse"], rel=1e-6)

"""Cluster assignment and indices against brute force on small fixtures."""

import numpy as np
import pytest

from staylens.operators import clustering as CL


def _frame(spark, pts, labels):
    return spark.createDataFrame([(float(a), float(b), int(l)) for (a, b), l in zip(pts, labels)],
                                 "x double, y double, lab int")


def _np_indices(pts, labels):
    ks = np.unique(labels)
    cent = np.array([pts[labels == k].mean(0) for k in ks])
    w = sum(((pts[labels == k] - cent[i]) ** 2).sum() for i, k in enumerate(ks))
    g = pts.mean(0)
    b = sum((labels == k).sum() * ((cent[i] - g) ** 2).sum() for i, k in enumerate(ks))
    ch = (b / (len(ks) - 1)) / (w / (len(pts) - len(ks)))
    s = np.array([np.sqrt(((pts[labels == k] - cent[i]) ** 2).sum(1)).mean() for i, k in enumerate(ks)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cent[i] - cent[j]) for j in range(len(ks)) if j != i)
                  for i in range(len(ks))])
    return w, ch, db


def test_indices_match_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = np.r_[rng.normal(0, 1, (40, 2)), rng.normal(5, 1, (30, 2)), [[20.0, 20.0]]]
    labels = np.r_[np.zeros(40, int), np.ones(30, int), [2]]           # a singleton cluster
    df = _frame(spark, pts, labels)
    got = CL.cluster_indices(df, ["x", "y"], "lab")
    w, ch, db = _np_indices(pts, labels)
    assert got["inertia"] == pytest.approx(w, rel=1e-10)
    assert got["calinski_harabasz"] == pytest.approx(ch, rel=1e-10)
    assert got["davies_bouldin"] == pytest.approx(db, rel=1e-10)
    assert got["silhouette"] == pytest.approx(CL.silhouette_pairs(pts, labels, squared=True), rel=1e-9)


def test_assign_and_lloyd(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (10.0, 10.0), (5.0, 5.0)], "x double, y double")
    lab = CL.assign_clusters(df, ["x", "y"], [[0.0, 0.0], [10.0, 10.0]], "c").collect()
    assert [r.c for r in lab] == [0, 0, 1, 0]                          # tie (5,5) -> lowest id
    step = {r.c: (r.n, r.x) for r in CL.lloyd_step(df, ["x", "y"], [[0.0, 0.0], [10.0, 10.0]], "c").collect()}
    assert step == {0: (3, 2.0), 1: (1, 10.0)}


def test_restarts_keep_lowest_inertia_and_sweep(spark):
    rng = np.random.default_rng(2)
    pts = np.r_[rng.normal(0, .3, (50, 2)), rng.normal(4, .3, (50, 2)), rng.normal((0, 4), .3, (50, 2))]
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double")
    sweep = CL.k_sweep(df, ["x", "y"], ks=[2, 3, 4], n_init=3, max_iter=50).orderBy("k").collect()
    inertias = [r.inertia for r in sweep]
    assert inertias[0] > inertias[1] > inertias[2]
    assert CL.best_k(spark.createDataFrame(sweep)).first().best_k_silhouette == 3

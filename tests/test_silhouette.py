"""The Euclidean silhouette over distinct vectors against all pairs."""

import numpy as np
import pytest

from staylens.operators import silhouette as SIL
from staylens.operators.clustering import silhouette_pairs

SCHEMA = "x double, y double, lab string, w int, uid string, label int"


def frame(spark, points, labels):
    return spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b), lab, 1, "u", 2)
                                  for (a, b), lab in zip(points, labels)], SCHEMA)


@pytest.mark.parametrize("shard,decimals", [(2048, 0), (5, 1), (1, 0)])
def test_all_pairs(spark, shard, decimals):
    rng = np.random.default_rng(shard)
    points = np.round(np.r_[rng.normal(0, 1, (60, 2)), rng.normal(4, 1, (50, 2)), rng.normal((9, 0), 2, (40, 2)), [[30, 30]]], decimals)
    points[0] = (-0.0, 0.0)
    points[1] = (0.0, -0.0)
    labels = np.array(["a"] * 60 + ["b"] * 50 + ["c"] * 40 + ["alone"])
    got = SIL.silhouette_euclidean(frame(spark, points.tolist(), labels.tolist()), ["x", "y"], "lab", shard).first()
    assert got.silhouette == pytest.approx(silhouette_pairs(points, labels, squared=False), abs=1e-12) and got.method == "euclidean"


def test_bounds_leave_out_far_clusters_only(spark):
    rng = np.random.default_rng(1)
    centers = [(0, 0), (3, 0), (100, 0), (103, 1)]
    points = np.round(np.concatenate([rng.normal(c, 1, (30, 2)) for c in centers]), 2)
    labels = np.repeat(["a", "b", "c", "d"], 30)
    vectors = SIL.distinct_vectors(frame(spark, points.tolist(), labels.tolist()), ["x", "y"], "lab").collect()
    bounds = SIL.cluster_bounds(SIL.distinct_vectors(frame(spark, points.tolist(), labels.tolist()), ["x", "y"], "lab"), 2)
    for v in vectors:
        for label, n, m, mean, radius in bounds:
            true = np.linalg.norm(points[labels == label] - v.x, axis=1).mean()
            low = np.linalg.norm(np.array(v.x) - mean)
            assert low - 1e-9 <= true <= low + radius + 1e-9
    got = SIL.silhouette_euclidean(frame(spark, points.tolist(), labels.tolist()), ["x", "y"], "lab", 16).first()
    assert got.silhouette == pytest.approx(silhouette_pairs(points, labels, squared=False), abs=1e-12)


def test_missing_values_one_cluster_and_equal_points(spark):
    points = [(0, 0), (0, 0), (5, 5), (5, 6), (None, 1), (1, float("nan")), (2, 2)]
    labels = ["a", "a", "b", "b", "a", "b", None]
    want = silhouette_pairs(np.array(points[:4], float), np.array(labels[:4]), squared=False)
    assert SIL.silhouette_euclidean(frame(spark, points, labels), ["x", "y"], "lab").first().silhouette == pytest.approx(want)
    same = frame(spark, [(1, 1)] * 4, ["a", "a", "b", "b"])
    assert SIL.silhouette_euclidean(same, ["x", "y"], "lab").first().silhouette == 0
    assert SIL.silhouette_euclidean(same.where("lab = 'a'"), ["x", "y"], "lab").first().silhouette is None
    assert SIL.silhouette_euclidean(same.where("false"), ["x", "y"], "lab").first().silhouette is None

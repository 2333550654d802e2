"""Many k-means fits at a time against one-fit Lloyd iterations in NumPy and MLlib's fits."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from staylens.operators import clustering as CL
from staylens.operators import lloyd as L


def frame(spark, x, parts=3):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double").repartition(parts)


def one_fit(x, centers, tol=1e-4, max_iter=300):
    for _ in range(max_iter):
        label = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == j].mean(0) if (label == j).any() else centers[j] for j in range(len(centers))])
        far = ((moved - centers) ** 2).sum(1).max()
        centers = moved
        if far <= tol ** 2:
            break
    return centers, ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def blobs():
    rng = np.random.default_rng(5)
    x = np.r_[[rng.normal(m, .5, (60, 2)) for m in ((0, 0), (5, 0), (0, 5), (6, 6))]].reshape(-1, 2).round(1)
    return np.r_[x, np.repeat([[6.0, 6.1]], 120, 0)] + 1e5  # a third of the rows are one point; far from the origin


def test_all_fits_are_lloyds_fits_of_their_seeds(spark, monkeypatch):
    x = blobs()
    seeds, passes = [], []
    chains, one_pass = L.seed_chains, L.lloyd_pass
    monkeypatch.setattr(L, "seed_chains", lambda p, shift, *a: seeds.append((shift, chains(p, shift, *a))) or seeds[0][1])
    monkeypatch.setattr(L, "lloyd_pass", lambda *a: passes.append(len(a[2])) or one_pass(*a))
    fits = L.kmeans_fits(frame(spark, x), ["x", "y"], [2, 3, 4], n_init=3, seed=7)
    shift, drawn = seeds[0]
    for k, found in fits.items():
        for i, f in enumerate(found):
            centers, cost = one_fit(x - shift, drawn[i][:k])
            assert f.centers - shift == pytest.approx(centers, abs=1e-8) and f.cost == pytest.approx(cost, rel=1e-8)
    # Passes are those of the slowest fit and one for the costs; fits that have converged leave them.
    assert len(passes) == max(f.iterations for found in fits.values() for f in found) + 1
    assert passes[0] == passes[-1] == 9 and sorted(passes[:-1], reverse=True) == passes[:-1]
    for c in drawn:
        assert len(np.unique(c, axis=0)) == 4 and all((np.abs(x - shift - p).sum(1) < 1e-9).any() for p in c)


def test_inertia_is_no_higher_than_of_mllib(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 2)).round(2)
    df = frame(spark, x)
    vec = CL.assemble_features(df, ["x", "y"], "f").cache()
    for k in (3, 5):
        theirs = min(KMeans(k=k, seed=42 + i, maxIter=300, tol=1e-4, featuresCol="f").fit(vec).summary.trainingCost for i in range(5))
        assert CL.kmeans_restart(df, ["x", "y"], k, n_init=10).cost <= theirs * 1.01


def test_draws_follow_weight_and_distance():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [-0.0, 0.0]])
    h = L.point_hashes(x)
    assert h[0] == h[3] and len(set(h[:3].tolist())) == 3
    share = np.bincount([int(np.argmax(np.log([1.0, 2.0, 5.0]) + L.gumbel(h[:3], s, 0))) for s in range(8000)], minlength=3) / 8000
    assert share == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.02)


def test_few_points_nulls_and_partitions(spark):
    rows = [(1.0, 1.0)] * 5 + [(2.0, 2.0)] * 3 + [(None, 1.0), (float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    fit = CL.kmeans_restart(df, ["x", "y"], 4, n_init=2)
    assert sorted(map(tuple, fit.centers.round(9).tolist())) == [(1.0, 1.0), (2.0, 2.0)] and fit.cost == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError):
        CL.kmeans_restart(df.where("x > 9 AND NOT isnan(x)"), ["x", "y"], 2)
    x = blobs()
    a, b = (CL.kmeans_restart(frame(spark, x, n), ["x", "y"], 3, n_init=2).centers for n in (1, 6))
    assert a == pytest.approx(b, abs=1e-7)


def test_sweep_reads_rows_once_and_gives_the_indices_of_the_rows(spark, monkeypatch):
    x = blobs()
    df = frame(spark, x)
    monkeypatch.setattr(CL, "cluster_indices", lambda *a: pytest.fail("the sweep labels all rows for each k"))
    table, best = CL.k_sweep_models(df, ["x", "y"], [1, 2, 3, 4], n_init=2)
    monkeypatch.undo()
    got = {r["k"]: r.asDict() for r in table.collect()}
    for k in (1, 2, 3, 4):
        want = CL.cluster_indices(CL.assign_clusters(df, ["x", "y"], CL.model_centroids(best[k]), "c"), ["x", "y"], "c")
        assert {n: got[k][n] for n in want} == {n: v if v is None else pytest.approx(v, rel=1e-7) for n, v in want.items()}


def test_indices_of_empty_and_single_clusters(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 3 + [(0.0, 1.0), (5.0, 5.0)], "x double, y double")
    for centers in ([[0.0, 0.5], [5.0, 5.0], [99.0, 99.0]], [[0.0, 0.0], [0.0, 1.0], [5.0, 5.0]], [[9.0, 9.0]]):
        want = CL.cluster_indices(CL.assign_clusters(df, ["x", "y"], centers, "c"), ["x", "y"], "c")
        points = L.weighted_points(df, ["x", "y"])
        got = L.fit_indices(points, [np.array(centers)])[0]
        points.unpersist()
        assert got == {n: v if v is None else pytest.approx(v, abs=1e-9) for n, v in want.items()}

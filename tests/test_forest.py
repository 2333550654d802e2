"""Forests grown over binned rows: the exhaustive best splits, MLlib's model format, and scores like MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import forest
from staylens.operators import models as M
from staylens.operators.metrics import regression_metrics

COLS = ["a", "b.c", "d", "e"]


def table(spark, n=3000):
    rng = np.random.default_rng(7)
    a, b, d = rng.normal(size=n), rng.integers(0, 3, n).astype(float), rng.uniform(0, 9, n)
    y = 10 + 2 * a + 3 * (b == 1) + np.sin(d) + rng.normal(0, .2, n)
    rows = [(i, float(a[i]), float(b[i]), float(d[i]), 1, None if i % 77 == 0 else float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, e int, y double").repartition(3)


def grown(monkeypatch, df, **kw):
    monkeypatch.setattr(forest, "MANY_ROWS", 1)
    monkeypatch.setattr(M.RandomForestRegressor, "fit", lambda *a: pytest.fail("fitted by MLlib"))
    return M.fit_forest(df, COLS, "y", **kw)


def test_large_tables_grow_their_own_forest(spark, monkeypatch):
    """MLlib kept 2 kB of each row and read them once per level."""
    df = table(spark)
    mllib = M.fit_forest(df, COLS, "y", numTrees=15, maxDepth=6, featureSubsetStrategy="sqrt")
    own = grown(monkeypatch, df, numTrees=15, maxDepth=6, featureSubsetStrategy="sqrt")
    assert own.getNumTrees == 15 and own.numFeatures == 4 and all(t.depth <= 6 for t in own.trees)
    names = {p.name for p in mllib.extractParamMap()}
    assert {p.name for p in own.extractParamMap()} == names
    assert all(own.getOrDefault(p) == mllib.getOrDefault(p) for p in names if p != "seed") and own.getOrDefault("seed") == 42
    rmse = [regression_metrics(M.score(m, df, COLS), "y").first().rmse for m in (mllib, own)]
    assert rmse[1] < 1.15 * rmse[0]
    imp = [m.featureImportances.toArray() for m in (mllib, own)]
    assert np.allclose(imp[0], imp[1], atol=0.12) and imp[1][3] == 0
    again = M.fit_forest(df, COLS, "y", numTrees=15, maxDepth=6, featureSubsetStrategy="sqrt")
    assert abs(regression_metrics(M.score(again, df, COLS), "y").first().rmse - rmse[1]) < 0.2


def test_every_split_is_the_best_of_its_node(spark, monkeypatch):
    """Against an exhaustive search over each node's bootstrap rows, with all features in every node."""
    kept = {}
    monkeypatch.setattr(forest, "model_of", lambda spark, est, trees, splits, make=forest.model_of: kept.update(
        trees=trees, splits=splits) or make(spark, est, trees, splits))
    monkeypatch.setattr(forest, "written", lambda df, name, keep=forest.written, **kw: kept.update(chunks=keep(df, name, **kw)) or kept["chunks"])
    monkeypatch.setattr(forest, "delete_path", lambda *a: None)
    monkeypatch.setattr(forest, "PASS_BYTES", 4000)  # several passes a level
    df = table(spark, 600)
    model = grown(monkeypatch, df, numTrees=3, maxDepth=3, featureSubsetStrategy="all", minInstancesPerNode=5)
    chunks = kept["chunks"][0].collect()
    assert sum(c["rows"] for c in chunks) == df.where("y IS NOT NULL").count()
    poisson = forest.poisson_table()
    assert abs(poisson.mean() - 1) < 1e-4 and abs(poisson.astype(float).var() - 1) < 1e-3
    for t, tree in kept["trees"].items():
        x = np.concatenate([np.frombuffer(c["x"], np.uint8).reshape(-1, 4) for c in chunks])
        y = np.concatenate([np.frombuffer(c["y"]) for c in chunks])
        w = np.concatenate([forest.weights(poisson, 42, t, c["chunk"], c["rows"]) for c in chunks]).astype(float)
        where = np.zeros(len(y), int)
        for i in range(len(tree.feature)):
            at = (where == i) & (w > 0)
            n, s = w[at].sum(), (w * y)[at].sum()
            assert np.allclose(tree.stats[i], [n, s, (w * y * y)[at].sum()])

            def gain(f, b):
                low = at & (x[:, f] <= b)
                nl, sl = w[low].sum(), (w * y)[low].sum()
                return 0 if min(nl, n - nl) < 5 else (sl ** 2 / nl + (s - sl) ** 2 / (n - nl) - s ** 2 / n) / n
            if tree.left[i] != i:
                most = max(gain(f, b) for f in range(4) for b in range(len(kept["splits"][f])))
                assert tree.gain[i] == pytest.approx(most) == pytest.approx(gain(tree.feature[i], tree.bin[i]))
                where[where == i] = tree.left[i] + (x[where == i, tree.feature[i]] > tree.bin[i])
    # The loaded model predicts what the trees say of the rows.
    got = M.score(model, df.where("id = 11"), COLS).first()
    says = []
    for tree in kept["trees"].values():
        i = 0
        while tree.left[i] != i:
            f = int(tree.feature[i])
            i = tree.left[i] + (not got[COLS[f]] <= kept["splits"][f][tree.bin[i]])
        says.append(tree.stats[i][1] / tree.stats[i][0])
    assert got.prediction == pytest.approx(np.mean(says))


def test_passes_take_a_few_chunks_at_a_time(spark, monkeypatch):
    key, seen, level = "spark.sql.execution.arrow.maxRecordsPerBatch", [], forest.grow_level
    before = spark.conf.get(key)
    monkeypatch.setattr(forest, "grow_level", lambda *a: seen.append(spark.conf.get(key)) or level(*a))
    grown(monkeypatch, table(spark, 200), numTrees=2, maxDepth=2)
    assert seen == [str(forest.BATCH_CHUNKS)] * 3 and spark.conf.get(key) == before


def test_other_forests_are_left_to_mllib(spark, monkeypatch):
    for kw in ({"numTrees": 1}, {"maxDepth": 20}, {"subsamplingRate": 0.5}, {"featureSubsetStrategy": "0.4"}):
        assert not forest.grows(M.rf_regressor("y", **kw))
    assert forest.grows(M.rf_regressor("y")) and forest.grows(M.rf_regressor("y", numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt"))
    monkeypatch.setattr(forest, "grow", lambda *a: pytest.fail("too few rows"))
    assert M.fit_forest(table(spark, 200), COLS, "y", numTrees=2, maxDepth=2).getNumTrees == 2


def test_candidate_splits():
    assert forest.candidate_splits(np.array([3.0, 1.0, 1.0]), 32).tolist() == [2.0]
    assert forest.candidate_splits(np.array([5.0, 5.0]), 32).tolist() == []
    many = forest.candidate_splits(np.arange(10000.0), 32)
    assert len(many) == 31 and np.ptp(np.diff(many)) <= 1


@pytest.mark.parametrize("col,bad", [("y", float("nan")), ("a", float("inf")), ("d", None)])
def test_values_must_be_finite(spark, monkeypatch, col, bad):
    df = table(spark, 200).withColumn(col, F.when(F.col("id") == 5, F.lit(bad)).otherwise(F.col(col)))
    with pytest.raises(Exception, match="NaN or infinite"):
        grown(monkeypatch, df, numTrees=2, maxDepth=2)

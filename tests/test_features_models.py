"""Encoders, imputers, scalers, PCA, RFE, models and the model store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import features as FT
from staylens.operators import models as M
from staylens.operators import splits as S


def test_one_hot_drop_first_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "t string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "t string")
    m1 = FT.OneHotColumns(["t"], dropFirst=True).fit(train)
    assert m1.new_columns() == ["t_b", "t_c"]
    m2 = FT.OneHotColumns(["t"], dropFirst=False).fit(train)
    rows = m2.transform(test).collect()
    assert [(r.t_a, r.t_b, r.t_c) for r in rows] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 2), (3.0, None), (4.0, 7)], "x double, y int")
    med = FT.ExactImputer(["x"], "median").fit(df).transform(df).collect()
    assert [r.x for r in med] == [1.0, 3.0, 3.0, 4.0]
    mode = FT.ExactImputer(["y"], "mode").fit(df).transform(df).collect()
    assert [r.y for r in mode] == [2, 2, 2, 7]
    mean = FT.impute_mean(df, ["y"]).collect()
    assert mean[2].y_imputed == pytest.approx(11 / 3)            # no truncation of integer columns


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    pop = FT.scaler_pop(["x", "c"]).fit(df).transform(df).collect()
    assert [r.x for r in pop] == [-1.0, 1.0] and [r.c for r in pop] == [0.0, 0.0]   # zero spread -> /1
    samp = FT.ColumnScaler(["x", "c"], withMean=False, ddof=1).fit(df).transform(df).collect()
    assert samp[1].x == pytest.approx(3 / np.sqrt(2)) and samp[0].c == 0.0           # constant -> 0


def test_pca_orthonormal(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    pts = np.c_[a, a * 0.5 + rng.normal(size=300) * 0.3, rng.normal(size=300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in pts], "a double, b double, c double")
    scaled = FT.scaler_pop(["a", "b", "c"]).fit(df).transform(df)
    load, var = FT.pca_fit(scaled, ["a", "b", "c"], k=2)
    assert np.allclose(load.T @ load, np.eye(2), atol=1e-9)
    assert var[0] >= var[1]
    for j in range(2):
        assert load[np.argmax(np.abs(load[:, j])), j] > 0


def test_rfe_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = x @ np.array([3.0, 0.0, -2.0, 0.1, 0.0, 1.0]) + rng.normal(size=400) * 0.1
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)],
                               ", ".join(f"{c} double" for c in cols) + ", y double")
    ranking = FT.rfe_select(df, cols, "y", n=3, standardize=False)
    kept = sorted(f for f, _, sel in ranking if sel)
    assert kept == ["x0", "x2", "x5"]
    a, b = FT.normal_equations(FT.gramian(df, cols, "y").first(), 6)
    coef = FT.solve_ols(a, b)
    ref = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert np.allclose(coef, ref, atol=1e-8)


def test_hash_split_is_stable(spark):
    df = spark.range(2000)
    a = S.hash_split(df, "id").where("split = 'test'").count()
    b = S.hash_split(df.repartition(5), "id").where("split = 'test'").count()
    assert a == b and 300 < a < 500
    folds = S.kfold(df, "id", 5).groupBy("fold").count().collect()
    assert len(folds) == 5


def _regression_frame(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, size=(n, 3))
    y = np.sin(x[:, 0]) * 3 + x[:, 1] + rng.normal(size=n) * 0.2
    return spark.createDataFrame([(i,) + tuple(map(float, r)) + (float(t),) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, y double")


def test_forest_invariants(spark):
    df = _regression_frame(spark)
    m1 = M.fit_forest(df, ["a", "b", "c"], "y", numTrees=20, maxDepth=5, seed=11)
    m2 = M.fit_forest(df, ["a", "b", "c"], "y", numTrees=20, maxDepth=5, seed=11)
    p1 = M.score(m1, df, ["a", "b", "c"]).select("id", "prediction")
    p2 = M.score(m2, df, ["a", "b", "c"]).select("id", F.col("prediction").alias("p2"))
    assert p1.join(p2, "id").where("prediction != p2").count() == 0        # same seed, same model
    imp = m1.featureImportances.toArray()
    assert (imp >= 0).all() and imp.sum() == pytest.approx(1.0)
    from staylens.operators.metrics import regression_metrics
    rf = regression_metrics(M.score(m1, df, ["a", "b", "c"]), "y").first().rmse
    std = df.agg(F.stddev_pop("y")).first()[0]
    assert rf < std                                                        # better than the mean
    gbt = M.fit_gbt(df, ["a", "b", "c"], "y", maxIter=10)
    assert regression_metrics(M.score(gbt, df, ["a", "b", "c"]), "y").first().rmse < std


def test_instance_grid_is_honoured(spark):
    df = _regression_frame(spark).withColumn("seg", F.lit(0))
    spec = M.SegmentSpec(cluster_col="seg", target_col="y", numeric_cols=["a", "b", "c"], model_types=["linear"],
                         min_cluster_size=20, linear_grid={"regParam": [0.3, 0.7], "elasticNetParam": [0.0]})
    _, models = M.train_segments(df, spec, key="id", tune=True)
    reg = models[(0, "linear")].getRegParam()
    assert reg in (0.3, 0.7)                                               # a value on the grid (Q3)


def test_rf_grid_search_small(spark):
    df = _regression_frame(spark, 300)
    grid = {"n_estimators": [5], "max_depth": [2, None], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    best, scores = M.rf_grid_search(df, ["a", "b", "c"], "y", key="id", grid=grid, k=3)
    rows = scores.collect()
    assert len(rows) == 2 and {r.params["maxDepth"] for r in rows} == {"2", "30"}
    assert best.getNumTrees == 5


def test_grid_search_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    df = _regression_frame(spark, 300)
    grid = {"n_estimators": [3, 5], "max_depth": [2, None], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    args = (df, ["a", "b", "c"], "y")
    put, kept = M.ScoreStore.put, []

    def lost(self, name, *rest):
        if len(kept) == 5:
            raise RuntimeError("driver lost")
        put(self, name, *rest)
        kept.append(name)

    monkeypatch.setattr(M.ScoreStore, "put", lost)
    with pytest.raises(RuntimeError):
        M.rf_grid_search(*args, key="id", grid=grid, k=3, parallelism=1, store=str(tmp_path / "s"))
    first = list(kept)
    kept.clear()
    (tmp_path / "s" / "torn").mkdir()  # a folder without _SUCCESS is no score

    def counted(self, name, *rest):
        put(self, name, *rest)
        kept.append(name)

    monkeypatch.setattr(M.ScoreStore, "put", counted)
    best, scores = M.rf_grid_search(*args, key="id", grid=grid, k=3, parallelism=2, store=str(tmp_path / "s"))
    assert len(first) == 5 and len(kept) == 7 and not set(first) & set(kept)
    kept.clear()
    again, same = M.rf_grid_search(*args, key="id", grid=grid, k=3, store=str(tmp_path / "s"))
    assert not kept and sorted(map(str, same.collect())) == sorted(map(str, scores.collect()))
    whole, alone = M.rf_grid_search(*args, key="id", grid=grid, k=3, store=str(tmp_path / "t"))
    assert sorted(map(str, alone.collect())) == sorted(map(str, scores.collect()))
    win = min(scores.collect(), key=lambda r: r.rmse_mean)
    assert str(best.getNumTrees) == win.params["numTrees"] and str(again.getMaxDepth()) == win.params["maxDepth"]
    other = df.withColumn("y", F.col("y") + 1)
    kept.clear()
    M.rf_grid_search(other, ["a", "b", "c"], "y", key="id", grid={**grid, "n_estimators": [3]}, k=2, store=str(tmp_path / "s"))
    assert len(kept) == 4  # other rows, other scores


def test_model_store_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = _regression_frame(spark, 200)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol="y")])
    store = M.ModelStore(str(tmp_path))
    m1 = store.get_or_fit(spark, "lr", pipe, df, ["a", "b"])
    m2 = store.get_or_fit(spark, "lr", pipe, df, ["a", "b"])
    a = m1.transform(df).select("id", "prediction")
    b = m2.transform(df).select("id", F.col("prediction").alias("p2"))
    assert a.join(b, "id").where("abs(prediction - p2) > 1e-12").count() == 0
    other = Pipeline(stages=[VectorAssembler(inputCols=["a", "c"], outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="y")])
    assert M.content_key(["a", "c"], pipe, df) != M.content_key(["a", "b"], pipe, df)
    m3 = store.get_or_fit(spark, "lr", other, df, ["a", "c"])
    assert list(m3.stages[0].getInputCols()) == ["a", "c"]                 # no stale reuse (Q8)

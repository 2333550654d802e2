"""Remaining invariants of the survey's test plan: bootstrap band, edge inputs, depth-1 tree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staylens.functions.stats import exact_quantiles
from staylens.operators import explore as X
from staylens.operators import features as FT
from staylens.operators import models as M


def test_bootstrap_band_contains_the_line(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 8, 400).astype(float)
    y = 3 * x + rng.normal(0, 2, 400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x double, y double")
    line = X.reg_line(df, "x", "y").first()
    band = X.reg_band(df, "x", "y", key="id", n_boot=200, points=20).collect()
    assert len(band) == 20
    for r in band:
        yhat = line.intercept + line.slope * r.x
        assert r.band_lo <= yhat <= r.band_hi and r.band_hi - r.band_lo < 2.0


def test_all_null_column_and_single_row_group(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("b", 5.0)], "g string, v double")
    q = {r.g: r.m for r in exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()}
    assert q == {"b": 5.0}                                   # all-null group absent, single row = its value
    imp = FT.ExactImputer(["v"], "median").fit(df.where("g = 'a'")).transform(df).collect()
    assert imp[0].v is None                                  # nothing to learn from an all-null column
    box = X.box_stats(df, "g", "v").collect()
    assert [(r.g, r.q1, r.q3, r.outliers) for r in box] == [("b", 5.0, 5.0, 0)]


def test_one_level_categorical(spark):
    df = spark.createDataFrame([("x",), ("x",)], "t string")
    assert FT.OneHotColumns(["t"], dropFirst=True).fit(df).new_columns() == []
    assert FT.OneHotColumns(["t"], dropFirst=False).fit(df).new_columns() == ["t_x"]


def test_depth_one_tree_matches_best_split(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, 500).astype(float)                 # <= 32 distinct values: exact bins
    y = np.where(x > 11, 10.0, 0.0) + rng.normal(0, 1, 500)
    pdf = pd.DataFrame({"x": x, "y": y})
    df = spark.createDataFrame(pdf)
    from pyspark.ml.regression import DecisionTreeRegressor
    data = FT.assemble_features(df, ["x"], "features")
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=1).fit(data)
    best, best_sse = None, np.inf
    for t in np.unique(x)[:-1]:
        l, r = y[x <= t], y[x > t]
        sse = ((l - l.mean()) ** 2).sum() + ((r - r.mean()) ** 2).sum()
        if sse < best_sse:
            best, best_sse = t, sse
    pred = M.score(tree, df, ["x"]).toPandas()
    left = pred[pred.x <= best].prediction.unique()
    right = pred[pred.x > best].prediction.unique()
    assert len(left) == 1 and len(right) == 1
    assert left[0] == pytest.approx(y[x <= best].mean()) and right[0] == pytest.approx(y[x > best].mean())


def test_gramian_matrix_and_standardisation(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(5, 3, size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)],
                               "a double, b double, c double, y double").repartition(3)
    g = FT.gramian_matrix(df, ["a", "b", "c"], "y")
    z = np.column_stack([np.ones(300), x, y])
    assert np.allclose(g, z.T @ z, rtol=1e-10)
    zs = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0), y])
    assert np.allclose(FT.standardized_gramian(g), zs.T @ zs, rtol=1e-8, atol=1e-6)

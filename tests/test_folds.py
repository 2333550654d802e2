"""Fold-complement statistics against one separate fit per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.functions.stats import exact_quantiles
from staylens.operators import features as FT
from staylens.operators import models as M
from staylens.operators.folds import FoldComplements, pipeline_cv
from staylens.operators.metrics import regression_metrics


def one_fit(train, numeric, categorical, label, n):
    """The pipeline stage by stage on the rows themselves."""
    train = train.where(F.col(label).isNotNull())
    pipe = FT.ColumnPipeline(numeric, categorical).fit(train)
    data = pipe.transform(train)
    chosen = [f for f, _, keep in FT.rfe_select(data, pipe.features, label, n, standardize=False) if keep]
    return pipe, chosen, M.ClosedFormOLS(chosen, label).fit(data)


def frame(spark, seed=4, rows=400):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(rows):
        a, b = float(rng.normal(1000, 2)), float(rng.integers(0, 4))
        c, d = "pqrst"[min(4, int(rng.exponential(1.2)))], int(rng.integers(1, 12))
        y = 3 * (a - 1000) + 0.7 * b + {"p": 2, "q": 0, "r": -1}.get(c, 5) + 0.1 * d + float(rng.normal(0, 0.3))
        data.append((i, None if i % 10 == 0 else a, float("nan") if i % 7 == 0 else b, None if i % 13 == 0 else c,
                     None if i % 17 == 0 else d, 5.0, "z" if i == 3 else "w", None if i % 41 == 0 else y, i % 5 if i % 50 else None))
    return spark.createDataFrame(data, "id long, a double, b double, c string, d int, flat double, rare string, y double, fold int")


NUMERIC, CATEGORICAL = ["a", "b", "flat"], ["c", "d", "rare"]


@pytest.mark.parametrize("n", [2, 6])
def test_equal_to_a_fit_per_fold(spark, n):
    df = frame(spark)
    got = {r.fold: r for r in pipeline_cv(df, NUMERIC, CATEGORICAL, "y", n=n).collect()}
    assert sorted(got) == list(range(5))
    for f, r in got.items():
        pipe, chosen, ols = one_fit(df.where(f"fold <> {f}"), NUMERIC, CATEGORICAL, "y", n)
        want = regression_metrics(ols.transform(pipe.transform(df.where(f"fold = {f}"))), "y").first()
        assert r.features == chosen and r.n == want["samples"]
        assert r.r2 == pytest.approx(want["r2"], abs=1e-9)


def test_fit_on_all_rows_is_the_same_model(spark):
    df = frame(spark)
    model = M.LinearPipeline(NUMERIC, CATEGORICAL, "y", 6).fit(df)
    pipe, chosen, ols = one_fit(df, NUMERIC, CATEGORICAL, "y", 6)
    assert model.chosen == chosen
    a = {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}
    b = {r.id: r.prediction for r in ols.transform(pipe.transform(df)).select("id", "prediction").collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-8) for i in b)


def test_level_of_one_fold_only_and_degenerate_folds(spark):
    df = frame(spark, rows=60)
    stats = FoldComplements(df, NUMERIC, CATEGORICAL, "y", "fold")
    without = stats.learn(4, stats.folds.index(3))[0]
    assert without.levels[2] == ["w"] and "rare_z" in stats.learn(4)[0].features  # z is in fold 3 alone
    assert pipeline_cv(df.where("fold = 1"), NUMERIC, CATEGORICAL, "y").count() == 0  # no complement to learn from
    same = df.withColumn("y", F.when(F.col("fold") == 2, 1.0).otherwise(F.col("y")))
    assert {r.fold: r.r2 for r in pipeline_cv(same, NUMERIC, CATEGORICAL, "y").collect()}[2] is None
    assert pipeline_cv(df.where("false"), NUMERIC, CATEGORICAL, "y").count() == 0


def test_numbers_only_and_words_only(spark):
    df = frame(spark)
    assert all(r.r2 > 0.5 for r in pipeline_cv(df, ["a"], [], "y", n=1).collect())
    assert all(r.r2 is not None for r in pipeline_cv(df, [], ["c"], "y", n=2).collect())


def test_weighted_quantiles_repeat_rows(spark):
    rows = [(g, float(v), w) for g in "ab" for v, w in ((1, 3), (2, 0), (7, 2), (9, 5))]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {r.g: (r.m, r.q) for r in exact_quantiles(df, "v", {"m": 0.5, "q": 0.25}, ["g"], weight="w").collect()}
    flat = np.repeat([1.0, 2.0, 7.0, 9.0], [3, 0, 2, 5])
    assert got == {g: (np.quantile(flat, 0.5), np.quantile(flat, 0.25)) for g in "ab"}

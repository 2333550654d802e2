"""Splits and model selection.

The default split is a stable hash of a key column, so a row lands in the same
bucket on any cluster, partitioning and engine (DuckDB computes the same value).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import x_of

HASH_DIGITS = 7  # 7 hex digits fit every engine's integer type


def hash_bucket(key: str | Column, buckets: int, seed: int = 42) -> Column:
    """``conv(substr(md5(key || ':' || seed), 1, 7), 16, 10) % buckets``."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return (F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Add ``split`` = 'test' | 'train'.

    With test_size = 1/m the test rows are hash bucket 0 of m (the same rows as
    fold 0 of an m-fold ``kfold``); otherwise 100 buckets are used.
    """
    inv = 1.0 / test_size
    if abs(inv - round(inv)) < 1e-9:
        is_test = hash_bucket(key, int(round(inv)), seed) == 0
    else:
        is_test = hash_bucket(key, 100, seed) < int(round(test_size * 100))
    return df.withColumn(out, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold id 0..k-1 per row from the same stable hash."""
    return df.withColumn(out, hash_bucket(key, k, seed))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 42):
    """Spark's randomSplit (depends on partitioning; hash_split is the stable default)."""
    return df.randomSplit(list(weights), seed=seed)


def param_grid(estimator, grid: dict) -> list:
    """Grid over the *instance's* params (class-level Params are ignored by fit, see Q3)."""
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def cross_validator(estimator, grid: dict, label: str, k: int = 3, seed: int = 42,
                    metric: str = "rmse", parallelism: int = 4, fold_col: str | None = None) -> CrossValidator:
    """CrossValidator over an instance grid; ``fold_col`` gives stable user folds."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=param_grid(estimator, grid), evaluator=ev,
                        numFolds=k, seed=seed, parallelism=parallelism)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv


def kfold_ols_r2(df: DataFrame, x: str, y: str, fold: str = "fold") -> DataFrame:
    """D3 for one-feature OLS: R^2 of every fold, fitted on the other folds (``pipeline_cv``: any features).

    One grouped pass gives per-fold sums; the complement of fold f is total minus
    fold f, so all k fits come from k small rows (no data is re-read per fold).
    A second pass scores each row with its own fold's coefficients.
    """
    xs, ys = x_of(x), x_of(y)
    data = df.where(xs.isNotNull() & ys.isNotNull()).select(fold, xs.alias("_x"), ys.alias("_y"))
    # Less the grand means, lest the sums of squares cancel far from the origin.
    means = data.agg(F.avg("_x").alias("x"), F.avg("_y").alias("y")).first()
    data = data.select(fold, (F.col("_x") - F.lit(means["x"] or 0.0)).alias("_x"), (F.col("_y") - F.lit(means["y"] or 0.0)).alias("_y"))
    sums = data.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"),
                                  F.sum(F.col("_x") * F.col("_x")).alias("sxx"),
                                  F.sum(F.col("_x") * F.col("_y")).alias("sxy")).collect()  # one row per fold
    tot = {k: sum(r[k] for r in sums) for k in ("n", "sx", "sy", "sxx", "sxy")}
    coef = {}
    for r in sums:
        n, sx, sy, sxx, sxy = (tot[k] - r[k] for k in ("n", "sx", "sy", "sxx", "sxy"))
        mx, my = sx / n, sy / n
        slope = (sxy - n * mx * my) / (sxx - n * mx * mx)
        coef[r[fold]] = (my - slope * mx, slope)
    pred = None
    for f, (b0, b1) in coef.items():
        e = F.lit(b0) + F.lit(b1) * F.col("_x")
        pred = F.when(F.col(fold) == F.lit(f), e) if pred is None else pred.when(F.col(fold) == F.lit(f), e)
    resid = F.col("_y") - pred
    return data.groupBy(fold).agg(
        (F.lit(1.0) - F.sum(resid * resid) / (F.var_pop("_y") * F.count(F.lit(1)))).alias("r2"),
        F.count(F.lit(1)).alias("n"))

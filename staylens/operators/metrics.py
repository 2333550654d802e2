"""Evaluation aggregates (F1-F4, F12-F17): one aggregate per result, grouped when needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.stats import exact_quantiles


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """F1-F3 (+ count) in a single aggregate: rmse, mae, r2 about the mean of y.

    r2 = 1 - SS_res / SS_tot with SS_tot = n * var_pop(y); a constant label gives
    null (undefined), as does an empty group.
    """
    y = F.col(label).cast("double")
    e = y - F.col(prediction).cast("double")
    ok = y.isNotNull() & F.col(prediction).isNotNull()
    sse = F.sum(F.when(ok, e * e))
    n = F.count(F.when(ok, F.lit(1)))
    sst = F.var_pop(F.when(ok, y)) * n
    return df.groupBy(*by).agg(
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.when(ok, F.abs(e))).alias("mae"),
        F.when(sst > 0, F.lit(1.0) - sse / sst).alias("r2"),
        n.alias("samples"),
    )


def rmse(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("rmse")


def mae(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("mae")


def r2(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, prediction).select("r2")


def cv_summary(scores: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """mean and population std of fold scores."""
    return scores.groupBy(*by).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"),
                                   F.count(F.lit(1)).alias("folds"))


def segment_metrics(scored: DataFrame, ids: DataFrame, label: str, segment: str,
                    prediction: str = "prediction") -> DataFrame:
    """one row per segment id (all ids, also empty ones -> null metrics)."""
    m = regression_metrics(scored, label, prediction, by=[segment])
    return ids.select(segment).distinct().join(m, segment, "left") \
        .withColumn("samples", F.coalesce(F.col("samples"), F.lit(0).cast("bigint")))


def global_metrics(scored: Sequence[tuple[str, DataFrame]], label: str, prediction: str = "prediction") -> DataFrame:
    """union of scored frames tagged by model name, one grouped aggregate."""
    tagged = None
    for name, df in scored:
        t = df.select(F.lit(name).alias("model"), F.col(label).alias("_y"), F.col(prediction).alias("_p"))
        tagged = t if tagged is None else tagged.unionByName(t)
    return regression_metrics(tagged, "_y", "_p", by=["model"])


def model_comparison(global_m: DataFrame, segment_m: DataFrame) -> DataFrame:
    """global and per-segment metric rows side by side, incomplete rows dropped."""
    g = global_m.select(F.lit("global").alias("scope"), F.col("model"), F.lit(None).cast("string").alias("cluster"),
                        "rmse", "r2", "mae", "samples")
    s = segment_m.select(F.lit("cluster").alias("scope"), F.col("model"), F.col("cluster").cast("string"),
                         "rmse", "r2", "mae", "samples")
    return g.unionByName(s).dropna(subset=["rmse", "r2", "mae"])


def metrics_table(metrics: DataFrame) -> DataFrame:
    """flat (cluster, model_type, rmse, r2, n_features)."""
    return metrics.select("cluster", "model_type", "rmse", "r2", "n_features")


def pivot_metric(table: DataFrame, row: str = "cluster", col: str = "model_type", metric: str = "r2",
                 levels: Sequence[str] | None = None) -> DataFrame:
    """F16: row x col pivot of one metric (levels given: no extra job to find them)."""
    g = table.groupBy(row)
    p = g.pivot(col, list(levels)) if levels is not None else g.pivot(col)
    return p.agg(F.first(metric))


def metric_boxstats(table: DataFrame, metric: str = "r2", by: str = "model_type") -> DataFrame:
    """box statistics of a metric by model type."""
    from staylens.operators.explore import box_stats
    return box_stats(table, by, metric)

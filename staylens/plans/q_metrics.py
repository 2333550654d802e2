"""Registered queries: evaluation aggregates and cluster indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import clustering as CL
from staylens.operators import silhouette as SIL
from staylens.operators import metrics as MT
from staylens.operators import splits as S
from staylens.plans import frames
from staylens.plans.registry import register
from staylens.plans.q_models import ols_scored

M6 = {"rmse": 6, "mae": 6, "r2": 8}


@register("rmse", "SELECT rmse FROM ols_metrics", {"rmse": 6})
def rmse(spark, sf):
    return MT.rmse(ols_scored(spark, sf), "label")


@register("mae", "SELECT mae FROM ols_metrics", {"mae": 6})
def mae(spark, sf):
    return MT.mae(ols_scored(spark, sf), "label")


@register("r2", "SELECT r2 FROM ols_metrics", {"r2": 8})
def r2(spark, sf):
    return MT.r2(ols_scored(spark, sf), "label")


@register("cv_summary", """
SELECT avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std, count(*) AS folds FROM (
""" + __import__("staylens.plans.q_features", fromlist=["KFOLD_SQL"]).KFOLD_SQL + ")",
          {"cv_mean": 8, "cv_std": 8})
def cv_summary(spark, sf):
    s = frames.split(spark, sf).where("split = 'train'")
    return MT.cv_summary(S.kfold_ols_r2(s, "bedrooms", "number_of_reviews", "fold"), "r2")


# ----------------------------------------------------------------------------- cluster indices

def _index_ctes(label_sql: str, p: str) -> str:
    """DuckDB text of inertia, squared-Euclidean silhouette, Davies-Bouldin and
    Calinski-Harabasz for cluster_points labelled by ``label_sql``."""
    return f"""
{p}_pts AS (SELECT id, f1, f2, {label_sql} AS lab FROM cluster_points),
{p}_st AS (SELECT lab, count(*) AS n, sum(f1) AS s1, sum(f2) AS s2, sum(f1 * f1 + f2 * f2) AS q,
                  avg(f1) AS c1, avg(f2) AS c2 FROM {p}_pts GROUP BY lab),
{p}_inertia AS (SELECT sum((p.f1 - s.c1) * (p.f1 - s.c1) + (p.f2 - s.c2) * (p.f2 - s.c2)) AS inertia
                FROM {p}_pts p JOIN {p}_st s USING (lab)),
{p}_t AS (SELECT p.id, p.lab AS own, s.lab AS other, s.n,
                 s.n * (p.f1 * p.f1 + p.f2 * p.f2) - 2.0 * (p.f1 * s.s1 + p.f2 * s.s2) + s.q AS t
          FROM {p}_pts p, {p}_st s),
{p}_ab AS (SELECT id, max(CASE WHEN own = other THEN greatest(t / greatest(n - 1, 1), 0.0) END) AS a,
                  min(CASE WHEN own <> other THEN greatest(t / n, 0.0) END) AS b,
                  max(CASE WHEN own = other THEN n END) AS own_n FROM {p}_t GROUP BY id),
{p}_sil AS (SELECT avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0
                            ELSE (b - a) / greatest(a, b) END) AS silhouette FROM {p}_ab),
{p}_S AS (SELECT p.lab, avg(sqrt((p.f1 - s.c1) * (p.f1 - s.c1) + (p.f2 - s.c2) * (p.f2 - s.c2))) AS S
          FROM {p}_pts p JOIN {p}_st s USING (lab) GROUP BY p.lab),
{p}_db AS (SELECT avg(r) AS davies_bouldin FROM (
             SELECT a.lab, max((sa.S + sb.S) / sqrt((a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2))) AS r
             FROM {p}_st a JOIN {p}_st b ON a.lab <> b.lab
             JOIN {p}_S sa ON sa.lab = a.lab JOIN {p}_S sb ON sb.lab = b.lab GROUP BY a.lab)),
{p}_ch AS (SELECT (bss / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM (
             SELECT sum(s.n * ((s.c1 - g.g1) * (s.c1 - g.g1) + (s.c2 - g.g2) * (s.c2 - g.g2))) AS bss,
                    count(*) AS k, sum(s.n) AS n, (SELECT inertia FROM {p}_inertia) AS w
             FROM {p}_st s, (SELECT avg(f1) AS g1, avg(f2) AS g2 FROM {p}_pts) g))
"""


# Three labellings of cluster_points by bedrooms band (k = 2, 3, 4).
LABELLINGS = {
    2: ("CASE WHEN f1 <= 3 THEN 0 ELSE 1 END",
        lambda: F.when(F.col("f1") <= 3, F.lit(0)).otherwise(F.lit(1))),
    3: ("seg", lambda: F.col("seg")),
    4: ("CASE WHEN f1 <= 2 THEN 0 WHEN f1 <= 4 THEN 1 WHEN f1 <= 5 THEN 2 ELSE 3 END",
        lambda: F.when(F.col("f1") <= 2, F.lit(0)).when(F.col("f1") <= 4, F.lit(1))
        .when(F.col("f1") <= 5, F.lit(2)).otherwise(F.lit(3))),
}
IDX_CTES = ",\n".join(_index_ctes(sql, f"k{k}").strip() for k, (sql, _) in LABELLINGS.items())


def _points(spark, sf, k=3):
    return frames.cluster_points(spark, sf).withColumn("lab", LABELLINGS[k][1]())


@register("inertia", "SELECT inertia FROM k3_inertia", {"inertia": 6}, IDX_CTES)
def inertia(spark, sf):
    return CL.inertia(_points(spark, sf), frames.CLUSTER_COLS, "lab")


@register("silhouette", "SELECT silhouette, 'squared_euclidean' AS method FROM k3_sil", {"silhouette": 8}, IDX_CTES)
def silhouette(spark, sf):
    return CL.silhouette(_points(spark, sf), frames.CLUSTER_COLS, "lab")


# Over distinct vectors, each with its number of rows.
EUCLIDEAN_SQL = """
sil_points AS (SELECT f1, f2, lab, count(*) AS w FROM (SELECT f1, f2, %s AS lab FROM cluster_points) GROUP BY ALL),
sil_sizes AS (SELECT lab, sum(w) AS n FROM sil_points GROUP BY lab),
sil_means AS (
  SELECT a.f1, a.f2, a.lab, a.w, b.lab AS other, any_value(s.n) AS n,
         sum(b.w * sqrt((a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2))) AS total
  FROM sil_points a, sil_points b, sil_sizes s WHERE s.lab = b.lab GROUP BY a.f1, a.f2, a.lab, a.w, b.lab),
sil_values AS (
  SELECT w, max(CASE WHEN other = lab THEN n END) AS n, max(CASE WHEN other = lab THEN total / greatest(n - 1, 1) END) AS a,
         min(CASE WHEN other <> lab THEN total / n END) AS b
  FROM sil_means GROUP BY f1, f2, lab, w)
""" % LABELLINGS[3][0]


@register("silhouette_euclidean", """
SELECT sum(w * CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(w) AS silhouette,
       'euclidean' AS method FROM sil_values""", {"silhouette": 8}, EUCLIDEAN_SQL.strip())
def silhouette_euclidean(spark, sf):
    return SIL.silhouette_euclidean(_points(spark, sf), frames.CLUSTER_COLS, "lab")


@register("davies_bouldin", "SELECT davies_bouldin FROM k3_db", {"davies_bouldin": 8}, IDX_CTES)
def davies_bouldin(spark, sf):
    return CL.davies_bouldin(_points(spark, sf), frames.CLUSTER_COLS, "lab")


@register("calinski_harabasz", "SELECT calinski_harabasz FROM k3_ch", {"calinski_harabasz": 6}, IDX_CTES)
def calinski_harabasz(spark, sf):
    return CL.calinski_harabasz(_points(spark, sf), frames.CLUSTER_COLS, "lab")


def _sweep_fixed(spark, sf):
    base = frames.cluster_points(spark, sf)
    rows = []
    for k, (_, label) in LABELLINGS.items():
        idx = CL.cluster_indices(base.withColumn("lab", label()), frames.CLUSTER_COLS, "lab")
        rows.append((k, idx["inertia"], idx["silhouette"], idx["davies_bouldin"], idx["calinski_harabasz"]))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, "
                                       "calinski_harabasz double")


SWEEP_SQL = " UNION ALL ".join(
    f"SELECT {k} AS k, (SELECT inertia FROM k{k}_inertia) AS inertia, (SELECT silhouette FROM k{k}_sil) AS silhouette, "
    f"(SELECT davies_bouldin FROM k{k}_db) AS davies_bouldin, (SELECT calinski_harabasz FROM k{k}_ch) AS calinski_harabasz"
    for k in LABELLINGS)


@register("best_k", f"""
SELECT arg_max(k, silhouette) AS best_k_silhouette, arg_min(k, davies_bouldin) AS best_k_davies_bouldin,
       arg_max(k, calinski_harabasz) AS best_k_calinski_harabasz, 'squared_euclidean' AS silhouette_method FROM ({SWEEP_SQL})""", None, IDX_CTES)
def best_k(spark, sf):
    return CL.best_k(_sweep_fixed(spark, sf))


@register("k_sweep")
def k_sweep(spark, sf):
    from staylens.plans.q_models import sweep
    return sweep(spark, sf)[0]


@register("cluster_sizes", "SELECT seg, count(*) AS size FROM cluster_points GROUP BY seg")
def cluster_sizes(spark, sf):
    return CL.cluster_sizes(frames.cluster_points(spark, sf), "seg")


# ----------------------------------------------------------------------------- model metrics

SEGMENT_METRICS_SQL = """
SELECT i.seg, m.rmse, m.mae, m.r2, coalesce(m.samples, 0) AS samples
FROM (SELECT * FROM range(0, 4) t(seg)) i
LEFT JOIN (SELECT seg, sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
                  avg(abs(label - prediction)) AS mae,
                  CASE WHEN var_pop(label) > 0 THEN 1 - sum((label - prediction) * (label - prediction))
                       / (var_pop(label) * count(*)) END AS r2,
                  count(*) AS samples
           FROM ols_scored GROUP BY seg) m ON m.seg = i.seg"""


@register("segment_metrics", SEGMENT_METRICS_SQL, M6)
def segment_metrics(spark, sf):
    ids = spark.range(0, 4).select(F.col("id").cast("bigint").alias("seg"))
    scored = ols_scored(spark, sf).withColumn("seg", F.col("seg").cast("bigint"))
    return MT.segment_metrics(scored, ids, "label", "seg")


TWO_MODELS_CTE = """
two_models AS (
  SELECT 'ols' AS model, seg, label, prediction FROM ols_scored
  UNION ALL
  SELECT 'mean' AS model, o.seg, o.label, m.mu AS prediction
  FROM ols_scored o, (SELECT avg(CAST(number_of_reviews AS DOUBLE)) AS mu FROM listings_split
                      WHERE split = 'train' AND bedrooms IS NOT NULL AND number_of_reviews IS NOT NULL) m),
two_metrics AS (
  SELECT model, seg, sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
         avg(abs(label - prediction)) AS mae,
         CASE WHEN var_pop(label) > 0 THEN 1 - sum((label - prediction) * (label - prediction))
              / (var_pop(label) * count(*)) END AS r2, count(*) AS samples
  FROM two_models GROUP BY GROUPING SETS ((model), (model, seg)))
"""


def _two_models(spark, sf):
    """Scored test rows of two models: OLS and the train-mean predictor."""
    scored = ols_scored(spark, sf)
    s = frames.split(spark, sf).where("split = 'train'") \
        .where(F.col("bedrooms").isNotNull() & F.col("number_of_reviews").isNotNull())
    mu = s.agg(F.avg(F.col("number_of_reviews").cast("double"))).first()[0]
    return [("ols", scored), ("mean", scored.withColumn("prediction", F.lit(mu)))]


@register("global_metrics", "SELECT model, rmse, mae, r2, samples FROM two_metrics WHERE seg IS NULL", M6,
          TWO_MODELS_CTE)
def global_metrics(spark, sf):
    return MT.global_metrics(_two_models(spark, sf), "label")


def _segment_table(spark, sf):
    tagged = None
    for name, df in _two_models(spark, sf):
        t = df.select(F.lit(name).alias("model"), "seg", "label", "prediction")
        tagged = t if tagged is None else tagged.unionByName(t)
    return MT.regression_metrics(tagged, "label", "prediction", by=["model", "seg"])


@register("model_comparison", """
SELECT 'global' AS scope, model, CAST(NULL AS VARCHAR) AS cluster, rmse, r2, mae, samples FROM two_metrics
WHERE seg IS NULL AND rmse IS NOT NULL AND r2 IS NOT NULL AND mae IS NOT NULL
UNION ALL
SELECT 'cluster' AS scope, model, CAST(seg AS VARCHAR) AS cluster, rmse, r2, mae, samples FROM two_metrics
WHERE seg IS NOT NULL AND rmse IS NOT NULL AND r2 IS NOT NULL AND mae IS NOT NULL""", M6, TWO_MODELS_CTE)
def model_comparison(spark, sf):
    g = MT.global_metrics(_two_models(spark, sf), "label")
    seg = _segment_table(spark, sf).withColumnRenamed("seg", "cluster")
    return MT.model_comparison(g, seg)


def _metric_rows(spark, sf):
    t = _segment_table(spark, sf)
    return t.select(F.col("seg").cast("string").alias("cluster"), F.col("model").alias("model_type"),
                    "rmse", "r2", F.lit(1).alias("n_features"))


@register("metrics_table", """
SELECT CAST(seg AS VARCHAR) AS cluster, model AS model_type, rmse, r2, 1 AS n_features
FROM two_metrics WHERE seg IS NOT NULL""", {"rmse": 6, "r2": 8}, TWO_MODELS_CTE)
def metrics_table(spark, sf):
    return MT.metrics_table(_metric_rows(spark, sf))


@register("pivot_metric", """
SELECT CAST(seg AS VARCHAR) AS cluster, max(r2) FILTER (WHERE model = 'mean') AS mean,
       max(r2) FILTER (WHERE model = 'ols') AS ols
FROM two_metrics WHERE seg IS NOT NULL GROUP BY seg""", {"mean": 8, "ols": 8}, TWO_MODELS_CTE)
def pivot_metric(spark, sf):
    return MT.pivot_metric(_metric_rows(spark, sf), "cluster", "model_type", "r2", ["mean", "ols"])


@register("metric_boxstats", """
SELECT model_type, q1, median, q3, n, whisker_low, whisker_high, outliers FROM (
  SELECT model AS model_type, quantile_cont(r2, 0.25) AS q1, quantile_cont(r2, 0.5) AS median,
         quantile_cont(r2, 0.75) AS q3, count(r2) AS n
  FROM two_metrics WHERE seg IS NOT NULL AND r2 IS NOT NULL GROUP BY model) q
JOIN (
  SELECT t.model AS model_type,
         min(CASE WHEN t.r2 >= b.q1 - 1.5 * (b.q3 - b.q1) THEN t.r2 END) AS whisker_low,
         max(CASE WHEN t.r2 <= b.q3 + 1.5 * (b.q3 - b.q1) THEN t.r2 END) AS whisker_high,
         count(CASE WHEN t.r2 < b.q1 - 1.5 * (b.q3 - b.q1) OR t.r2 > b.q3 + 1.5 * (b.q3 - b.q1) THEN 1 END) AS outliers
  FROM two_metrics t JOIN (SELECT model, quantile_cont(r2, 0.25) AS q1, quantile_cont(r2, 0.75) AS q3
                           FROM two_metrics WHERE seg IS NOT NULL AND r2 IS NOT NULL GROUP BY model) b
       ON t.model = b.model
  WHERE t.seg IS NOT NULL AND t.r2 IS NOT NULL GROUP BY t.model) w USING (model_type)""",
          {"q1": 8, "median": 8, "q3": 8, "whisker_low": 8, "whisker_high": 8}, TWO_MODELS_CTE)
def metric_boxstats(spark, sf):
    return MT.metric_boxstats(_metric_rows(spark, sf), "r2", "model_type")

"""Registered queries: models, scoring and model selection."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from staylens.operators import clustering as CL
from staylens.operators import features as FT
from staylens.operators import models as M
from staylens.plans import frames
from staylens.plans.registry import register
from staylens.session import scratch_path
from staylens.sources import sinks

NUMERIC = frames.ALL_NUMERIC


def ols_scored(spark, sf):
    """Test rows scored by OLS of number_of_reviews on bedrooms fitted on the train rows."""
    s = frames.split(spark, sf).where(F.col("bedrooms").isNotNull() & F.col("number_of_reviews").isNotNull()) \
        .withColumn("label", F.col("number_of_reviews").cast("double"))
    model = M.ols_fit(s.where("split = 'train'"), ["bedrooms"], "label")
    test = s.where("split = 'test'").select("id", "label", "bedrooms", frames.band().alias("seg"))
    return M.score(model, test, ["bedrooms"])


def _ols_row(spark, model, n_col="n"):
    return spark.createDataFrame([(float(model.intercept), float(model.coefficients[0]),
                                   int(model.summary.numInstances))], f"intercept double, slope double, {n_col} long")


@register("ols_fit", "SELECT intercept, slope, CAST(n AS BIGINT) AS n FROM ols_fit", {"intercept": 6, "slope": 6})
def ols_fit(spark, sf):
    s = frames.split(spark, sf).where("split = 'train'")
    return _ols_row(spark, M.ols_fit(s, ["bedrooms"], "number_of_reviews"))


@register("score", "SELECT id, prediction FROM ols_scored", {"prediction": 6})
def score(spark, sf):
    return ols_scored(spark, sf).select("id", "prediction")


@register("coefficient_map", """
SELECT 'bedrooms' AS feature, slope AS coefficient FROM ols_fit
UNION ALL SELECT 'intercept' AS feature, intercept AS coefficient FROM ols_fit""", {"coefficient": 6})
def coefficient_map(spark, sf):
    s = frames.split(spark, sf).where("split = 'train'")
    return M.coefficient_map(spark, M.ols_fit(s, ["bedrooms"], "number_of_reviews"), ["bedrooms"])


def _orthogonal_ols_sql(cols) -> str:
    """CTEs of OLS of log_price on mean-imputed columns by successive orthogonalisation: q_j is
    column j less its projections on the q before it (0 if nothing is left of it)."""
    ctes = ["lin_m AS (SELECT avg(log_price) AS my, " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{j}" for j, c in enumerate(cols))
            + " FROM listings_split WHERE split = 'train')",
            "lin_0 AS MATERIALIZED (SELECT id, split, log_price - my AS y, " + ", ".join(
                f"coalesce(CAST({c} AS DOUBLE) - m{j}, 0) AS x{j}" for j, c in enumerate(cols)) + " FROM listings_split, lin_m)"]
    for j in range(len(cols)):
        dots = ", ".join([f"sum(x{j} * q{i}) / nullif(sum(q{i} * q{i}), 0) AS b{i}" for i in range(j)] + [f"sum(x{j} * x{j}) AS xx"])
        rest = f"x{j}" + "".join(f" - coalesce(b{i}, 0) * q{i}" for i in range(j))
        ctes.append(f"lin_r{j} AS MATERIALIZED (SELECT t.*, {rest} AS r{j}, xx AS xx{j} FROM lin_{j} t, "
                    f"(SELECT {dots} FROM lin_{j} WHERE split = 'train'))")
        ctes.append(f"lin_{j + 1} AS MATERIALIZED (SELECT t.*, CASE WHEN rr > 1e-8 * xx{j} THEN r{j} ELSE 0 END AS q{j} FROM lin_r{j} t, "
                    f"(SELECT sum(r{j} * r{j}) AS rr FROM lin_r{j} WHERE split = 'train'))")
    d = len(cols)
    ctes.append("lin_w AS (SELECT " + ", ".join(f"coalesce(sum(y * q{j}) / nullif(sum(q{j} * q{j}), 0), 0) AS w{j}" for j in range(d))
                + f" FROM lin_{d} WHERE split = 'train')")
    return ",\n".join(ctes)


LINEAR_SQL = (f"SELECT id, my + " + " + ".join(f"w{j} * q{j}" for j in range(len(NUMERIC)))
              + f" AS prediction FROM lin_{len(NUMERIC)}, lin_w, lin_m WHERE split = 'test'")


@register("global_linear", LINEAR_SQL, {"prediction": 6}, _orthogonal_ols_sql(NUMERIC))
def global_linear(spark, sf):
    data, feats = _imputed_split(spark, sf)
    model = M.ClosedFormOLS(feats, "log_price").fit(data.where("split = 'train'"))
    return model.transform(data.where("split = 'test'")).select("id", "prediction")


@register("segment_linear", f"""
SELECT {frames.BAND_SQL} AS seg, CAST(regr_count(number_of_reviews, bedrooms) AS BIGINT) AS n,
       regr_intercept(number_of_reviews, bedrooms) AS intercept, regr_slope(number_of_reviews, bedrooms) AS coef_bedrooms
FROM listings_keyed_clean GROUP BY 1""",
          {"intercept": 6, "coef_bedrooms": 6})
def segment_linear(spark, sf):
    k = frames.keyed(spark, sf).withColumn("seg", frames.band())
    return M.segment_ols(k, ["bedrooms"], "number_of_reviews", "seg")


# ----------------------------------------------------------------------------- forests, boosting


def encoded_split(spark, sf):
    """Train/test rows with exact-median-imputed numerics and drop-first dummies (fitted on train)."""
    s = frames.split(spark, sf)
    train = s.where("split = 'train'")
    imp = FT.ExactImputer(NUMERIC, "median").fit(train)
    enc = FT.OneHotColumns([*frames.CATEGORICAL_FEATURES, "property_type"], dropFirst=True).fit(train)
    out = enc.transform(imp.transform(s))
    feats = NUMERIC + enc.new_columns()
    return out, feats


def _rf_model(spark, sf, **kw):
    data, feats = encoded_split(spark, sf)
    model = M.fit_forest(data.where("split = 'train'"), feats, "log_price", **kw)
    return model, data, feats


@register("rf_regress")
def rf_regress(spark, sf):
    model, data, feats = _rf_model(spark, sf, numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt")
    return M.score(model, data.where("split = 'test'"), feats).select("id", "prediction")


@register("importance_topk")
def importance_topk(spark, sf):
    model, _, feats = _rf_model(spark, sf, numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt")
    return M.importance_topk(spark, model, feats, 20)


@register("param_report")
def param_report(spark, sf):
    model, _, _ = _rf_model(spark, sf, numTrees=20, maxDepth=5)
    return M.param_report(spark, model)


def _imputed_split(spark, sf):
    s = frames.split(spark, sf)
    imp = FT.ExactImputer(NUMERIC, "mean", "_imputed").fit(s.where("split = 'train'"))
    return imp.transform(s), [f"{c}_imputed" for c in NUMERIC]


@register("global_rf")
def global_rf(spark, sf):
    data, feats = _imputed_split(spark, sf)
    model = M.fit_forest(data.where("split = 'train'"), feats, "log_price")
    return M.score(model, data.where("split = 'test'"), feats).select("id", "prediction")


@register("global_gbt")
def global_gbt(spark, sf):
    data, feats = _imputed_split(spark, sf)
    model = M.fit_gbt(data.where("split = 'train'"), feats, "log_price")
    return M.score(model, data.where("split = 'test'"), feats).select("id", "prediction")


def _segment_frame(spark, sf):
    """Fixture twin of the clustered listings: cluster features + room-type dummies, bands as clusters."""
    k = frames.keyed(spark, sf)
    enc = FT.OneHotColumns(["room_type"], dropFirst=True).fit(k)
    out = enc.transform(k.select("id", "minimum_nights", "calculated_host_listings_count", "room_type",
                                 "log_price", "bedrooms"))
    return out.withColumn("cluster", frames.band()), enc.new_columns()


@register("segment_rf")
def segment_rf(spark, sf):
    df, dummies = _segment_frame(spark, sf)
    spec = M.SegmentSpec(categorical_cols=dummies, model_types=["rf"])
    metrics, _ = M.train_segments(df, spec, key="id", tune=False)
    return metrics


@register("param_grid_cv")
def param_grid_cv(spark, sf):
    df, dummies = _segment_frame(spark, sf)
    spec = M.SegmentSpec(categorical_cols=dummies, model_types=["linear", "rf"])
    metrics, _ = M.train_segments(df, spec, key="id", tune=True)
    return metrics


def _price_segments(spark, sf, strict: bool = False):
    """Rows of per-cluster forests of log_price (see ``train_segments``)."""
    data, feats = _imputed_split(spark, sf)
    km = CL.kmeans_spark(data, feats, k=3, seed=42)
    labelled = CL.assign_clusters(data, feats, CL.model_centroids(km), "cluster_assignment")
    spec = M.SegmentSpec(cluster_col="cluster_assignment", target_col="log_price", numeric_cols=feats,
                         model_types=["rf"], min_cluster_size=1)
    return M.train_segments(labelled, spec, key="id", tune=False, strict=strict)[0]


@register("segment_price_rf")
def segment_price_rf(spark, sf):
    return _price_segments(spark, sf)


def global_models(spark, sf, in_sample: bool = False):
    """(name, scored rows) of the global linear model, forest and boosted trees of log_price, on the
    test rows, or on the training rows themselves if ``in_sample``."""
    data, feats = _imputed_split(spark, sf)
    train, rows = data.where("split = 'train'"), data.where(f"split = '{'train' if in_sample else 'test'}'")
    linear = M.ClosedFormOLS(feats, "log_price").fit(train)
    return [("linear", linear.transform(rows)), ("rf", M.score(M.fit_forest(train, feats, "log_price"), rows, feats)),
            ("gbt", M.score(M.fit_gbt(train, feats, "log_price"), rows, feats))]


@register("evaluate_all")
def evaluate_all(spark, sf):
    """Global models and per-cluster forests side by side, on held-out rows.

    The comparison has no status and drops rows without metrics, so a fit that fails ends the query."""
    from staylens.operators import metrics as MT
    segments = _price_segments(spark, sf, strict=True).withColumnRenamed("model_type", "model")
    return MT.model_comparison(MT.global_metrics(global_models(spark, sf), "log_price"), segments)


def rf_grid_search(spark, sf):
    """D4 on the fixture (not registered: 180 MLlib forest fits, see README)."""
    data, feats = encoded_split(spark, sf)
    train = data.where("split = 'train'")
    _, scores = M.rf_grid_search(train, feats, "log_price", key="id")
    return scores


# ----------------------------------------------------------------------------- k-means


def _cluster_input(spark, sf):
    """Scaled cluster features of the reference's k-means: nights, host listings, room-type dummies."""
    df, dummies = _segment_frame(spark, sf)
    cols = ["minimum_nights", "calculated_host_listings_count"] + dummies
    from staylens.operators.cleaning import fill_zero
    filled = fill_zero(df, cols)
    return FT.scaler_pop(cols).fit(filled).transform(filled), cols


_SWEEPS: dict = {}


def sweep(spark, sf):
    """The k sweep (k = 2..10, 10 restarts each) and its models, once per application and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SWEEPS:
        data, cols = _cluster_input(spark, sf)
        _SWEEPS[key] = CL.k_sweep_models(data, cols, range(2, 11), n_init=10, seed=42)
    return _SWEEPS[key]


def _segmented(spark, sf):
    """Rows labelled by the best-restart fit of the k that the sweep's silhouette chooses."""
    data, cols = _cluster_input(spark, sf)
    table, models = sweep(spark, sf)
    k = CL.best_k(table).first()["best_k_silhouette"]
    return CL.assign_clusters(data, cols, CL.model_centroids(models[k]), "cluster"), cols


@register("kmeans_restart")
def kmeans_restart(spark, sf):
    return CL.cluster_sizes(_segmented(spark, sf)[0], "cluster")


@register("segmentation")
def segmentation(spark, sf):
    """Sweep, best k, fit, projection and the labelled table, written partitioned by cluster."""
    labelled, cols = _segmented(spark, sf)
    loadings, _ = FT.pca_fit(labelled, cols, 2)
    path = scratch_path(spark, "segmented")
    sinks.write_table(FT.pca_project(labelled, cols, loadings).select("id", "pc1", "pc2", "cluster"), path, partition_by=["cluster"])
    return spark.read.parquet(path)


@register("kmeans_spark")
def kmeans_spark(spark, sf):
    data, feats = _imputed_split(spark, sf)
    model = CL.kmeans_spark(data, feats, k=3, seed=42)
    return CL.cluster_sizes(CL.assign_clusters(data, feats, CL.model_centroids(model), "cluster"), "cluster")


@register("assign_clusters", "SELECT id, cluster FROM (" + __import__(
    "staylens.plans.q_sources", fromlist=["CLUSTERED_SQL"]).CLUSTERED_SQL + ")")
def assign_clusters(spark, sf):
    pts = frames.cluster_points(spark, sf)
    return CL.assign_clusters(pts, frames.CLUSTER_COLS, frames.FIXED_CENTROIDS, "cluster").select("id", "cluster")


@register("lloyd_step", """
SELECT cluster, count(*) AS n, avg(f1) AS f1, avg(f2) AS f2 FROM (""" + __import__(
    "staylens.plans.q_sources", fromlist=["CLUSTERED_SQL"]).CLUSTERED_SQL + ") GROUP BY cluster",
          {"f1": 8, "f2": 8})
def lloyd_step(spark, sf):
    pts = frames.cluster_points(spark, sf)
    return CL.lloyd_step(pts, frames.CLUSTER_COLS, frames.FIXED_CENTROIDS, "cluster")


# ----------------------------------------------------------------------------- model store


def model_store_predictions(spark, sf):
    s = frames.split(spark, sf).where(F.col("bedrooms").isNotNull() & F.col("number_of_reviews").isNotNull()) \
        .withColumn("bedrooms", F.col("bedrooms").cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["bedrooms"], outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol="number_of_reviews")])
    store = M.ModelStore(scratch_path(spark, "models"))
    train = s.where("split = 'train'")
    first = store.get_or_fit(spark, "ols", pipe, train, ["bedrooms"])
    again = store.get_or_fit(spark, "ols", pipe, train, ["bedrooms"])  # loaded, not refitted
    return again.transform(s.where("split = 'test'")).select("id", "prediction")

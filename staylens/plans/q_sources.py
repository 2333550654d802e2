"""Registered queries: scans, sinks and catalog checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.plans import frames
from staylens.plans.registry import register
from staylens.session import scratch_path
from staylens.sources import readers, sinks

RAW_SQL = "SELECT * FROM listings_raw"
LOG10 = {"log_price": 10}


def _written_raw_csv(spark, sf):
    path = scratch_path(spark, "listings-csv")
    sinks.write_csv(frames.raw(spark, sf), path)
    return path


@register("scan_raw_csv", RAW_SQL)
def scan_raw_csv(spark, sf):
    return readers.scan_raw_csv(spark, _written_raw_csv(spark, sf))


@register("scan_first_existing", RAW_SQL)
def scan_first_existing(spark, sf):
    path = _written_raw_csv(spark, sf)
    return readers.scan_first_existing(spark, [path + "-missing", path])


SCAN_INFER_SQL = """
SELECT CAST(id AS INTEGER) AS id, name, CAST(host_id AS INTEGER) AS host_id, host_name, host_response_rate,
  host_acceptance_rate, host_is_superhost, CAST(host_listings_count AS INTEGER) AS host_listings_count,
  CAST(calculated_host_listings_count AS INTEGER) AS calculated_host_listings_count, neighbourhood, room_type,
  property_type, accommodates, bathrooms_text, CAST(bedrooms AS INTEGER) AS bedrooms,
  CAST(beds AS INTEGER) AS beds, CAST(minimum_nights AS INTEGER) AS minimum_nights,
  CAST(number_of_reviews AS INTEGER) AS number_of_reviews, review_scores_rating, price
FROM listings_raw
"""


@register("scan_csv_infer", SCAN_INFER_SQL)
def scan_csv_infer(spark, sf):
    return readers.scan_csv_infer(spark, _written_raw_csv(spark, sf))


@register("scan_driver_table", RAW_SQL)
def scan_driver_table(spark, sf):
    path = scratch_path(spark, "listings-parquet")
    sinks.write_table(frames.raw(spark, sf), path)
    return spark.read.parquet(path)


# The columns the per-segment modeller requires.
REQUIRED = ["cluster", "minimum_nights", "calculated_host_listings_count", "log_price"]


def _counts_sql(names, have) -> str:
    """One (column_name, present, non_null) row per name, counted from the cleaned listings."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {str(c in have).lower()} AS present, "
        + f"count({c if c in have else 'NULL'})" + " AS non_null FROM listings_clean" for c in names)


@register("require_columns", _counts_sql(REQUIRED, set(REQUIRED) - {"cluster"}))
def require_columns(spark, sf):
    return readers.require_columns(frames.clean(spark, sf), REQUIRED, raise_missing=False)


@register("write_clean", "SELECT * FROM listings_clean", LOG10)
def write_clean(spark, sf):
    path = scratch_path(spark, "clean")
    sinks.write_table(frames.clean(spark, sf), path)
    return spark.read.parquet(path)


@register("write_splits", "SELECT * FROM listings_split", LOG10)
def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    sinks.write_table(frames.split(spark, sf), path, partition_by=["split"])
    return spark.read.parquet(path)


CLUSTERED_SQL = """
SELECT id, f1, f2,
  CASE WHEN d0 = least(d0, d1, d2) THEN 0 WHEN d1 = least(d0, d1, d2) THEN 1 ELSE 2 END AS cluster
FROM (SELECT id, f1, f2,
        (f1 - 2.0) * (f1 - 2.0) + (f2 - 0.5) * (f2 - 0.5) AS d0,
        (f1 - 4.0) * (f1 - 4.0) + (f2 - 1.5) * (f2 - 1.5) AS d1,
        (f1 - 6.0) * (f1 - 6.0) + (f2 - 2.5) * (f2 - 2.5) AS d2
      FROM cluster_points)
"""


@register("write_clustered", CLUSTERED_SQL)
def write_clustered(spark, sf):
    from staylens.operators.clustering import assign_clusters
    pts = frames.cluster_points(spark, sf).drop("seg")
    labelled = assign_clusters(pts, frames.CLUSTER_COLS, frames.FIXED_CENTROIDS, "cluster")
    path = scratch_path(spark, "clustered")
    sinks.write_table(labelled, path, partition_by=["cluster"])
    return spark.read.parquet(path)


METRIC_ROUND = {"rmse": 6, "mae": 6, "r2": 8}


@register("write_metrics", "SELECT * FROM ols_metrics", METRIC_ROUND)
def write_metrics(spark, sf):
    from staylens.plans.q_models import ols_scored
    from staylens.operators.metrics import regression_metrics
    m = regression_metrics(ols_scored(spark, sf), "label")
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(m, path)
    return spark.read.json(path).select("rmse", "mae", "r2", "samples")


CATALOG = ["host_listings_count", "calculated_host_listings_count", "accommodates", "bedrooms", "beds",
           "minimum_nights", "number_of_reviews", "review_scores_rating", "host_response_rate",
           "host_acceptance_rate", "host_is_superhost", "bathrooms", "availability_365"]


CATALOG_SQL = "SELECT position, feature, present, non_null FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(CATALOG)) + ") AS t(position, feature) JOIN (" + _counts_sql(
    CATALOG, set(CATALOG) - {"availability_365"}) + ") AS c ON c.column_name = t.feature"


@register("feature_catalog", CATALOG_SQL)
def feature_catalog(spark, sf):
    df = frames.clean(spark, sf)
    path = scratch_path(spark, "feature-catalog")
    readers.save_feature_catalog(spark, CATALOG, path)
    return readers.validate_feature_catalog(readers.load_feature_catalog(spark, path), df)


@register("model_store", "SELECT id, prediction FROM ols_scored", {"prediction": 6})
def model_store(spark, sf):
    from staylens.plans.q_models import model_store_predictions
    return model_store_predictions(spark, sf)

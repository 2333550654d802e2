"""Shared Spark frames of the registered queries and their DuckDB twins (CTE text).

``clean`` / ``keyed``: the cleaned listings (``keyed`` keeps the smallest id of
each duplicate group as row key).  ``split``: keyed rows with the stable hash
split (bucket 0 of 5 = test, seed 42) and CV folds (5 buckets, seed 43).
``cluster_points``: two cluster features (bedrooms, nulls as 0; minimum_nights / 10)
with a fixed labelling by bedrooms band, used wherever labels must not depend
on a fitted model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.cleaning import DEFAULT_DROP_COLS, ListingCleaner, drop_columns
from staylens.operators.splits import hash_split, kfold
from staylens.session import delete_path, written
from staylens.sources.fixtures import listings_raw

SPLIT_SEED = 42
FOLD_SEED = 43
NUMERIC_FEATURES = ["accommodates", "bedrooms", "bathrooms", "review_scores_rating", "minimum_nights"]
# All numeric columns of the cleaned listings besides the target.
ALL_NUMERIC = ["host_listings_count", "calculated_host_listings_count", "accommodates", "bedrooms", "beds", "minimum_nights",
               "number_of_reviews", "review_scores_rating", "host_response_rate", "host_acceptance_rate",
               "host_is_superhost", "bathrooms"]
CATEGORICAL_FEATURES = ["neighbourhood", "room_type"]
CLUSTER_COLS = ["f1", "f2"]
# Literal centroids of the assignment queries (f1, f2).
FIXED_CENTROIDS = [[2.0, 0.5], [4.0, 1.5], [6.0, 2.5]]


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return listings_raw(spark, sf)


_SHARED: dict = {}


def _shared(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A table that every query of this application over ``sf`` reads: made and written once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED:
        _SHARED[key] = written(make(), name)
    return _SHARED[key][0]


def release(spark: SparkSession) -> None:
    """Forget the shared tables of this application and delete their files."""
    for key in [k for k in _SHARED if k[0] == spark.sparkContext.applicationId]:
        delete_path(spark, _SHARED.pop(key)[1])


#: Columns that the cleaner drops unread.
UNREAD = [c for c in DEFAULT_DROP_COLS if c not in ("id", "bathrooms_text")]


def shared_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _shared(spark, sf, "raw", lambda: drop_columns(raw(spark, sf), UNREAD))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned listings, written once to the shared folder: no query re-runs the fixture
    joins, the price cap and the deduplication."""
    r = shared_raw(spark, sf)
    return _shared(spark, sf, "clean", lambda: ListingCleaner().fit(r).transform(r))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    r = shared_raw(spark, sf)
    return _shared(spark, sf, "keyed", lambda: ListingCleaner(keyCol="id").fit(r).transform(r))


def split(spark: SparkSession, sf: str) -> DataFrame:
    return kfold(hash_split(keyed(spark, sf), "id", 0.2, SPLIT_SEED), "id", 5, FOLD_SEED)


def band(col: str = "bedrooms"):
    b = F.coalesce(F.col(col), F.lit(0))
    return F.when(b <= 3, F.lit(0)).when(b <= 5, F.lit(1)).otherwise(F.lit(2))


def cluster_points(spark: SparkSession, sf: str) -> DataFrame:
    k = keyed(spark, sf)
    return k.select("id", F.coalesce(F.col("bedrooms"), F.lit(0)).cast("double").alias("f1"),
                    (F.col("minimum_nights") / F.lit(10.0)).alias("f2"), band().alias("seg"))


BAND_SQL = "CASE WHEN coalesce(bedrooms, 0) <= 3 THEN 0 WHEN coalesce(bedrooms, 0) <= 5 THEN 1 ELSE 2 END"

FRAMES_SQL = f"""
listings_keyed AS (
  SELECT * EXCLUDE (id), min(id) AS id FROM listings_capped GROUP BY ALL),
listings_keyed_clean AS (
  SELECT *, ln(1 + price) AS log_price FROM listings_keyed
  WHERE price IS NOT NULL AND room_type IS NOT NULL AND neighbourhood IS NOT NULL),
listings_split AS (
  SELECT *,
    CASE WHEN CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{SPLIT_SEED}'), 1, 7)) AS BIGINT) % 5 = 0
         THEN 'test' ELSE 'train' END AS split,
    CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{FOLD_SEED}'), 1, 7)) AS BIGINT) % 5 AS INTEGER) AS fold
  FROM listings_keyed_clean),
cluster_points AS (
  SELECT id, CAST(coalesce(bedrooms, 0) AS DOUBLE) AS f1, CAST(minimum_nights AS DOUBLE) / 10.0 AS f2, {BAND_SQL} AS seg
  FROM listings_keyed_clean),
ols_fit AS (
  SELECT regr_slope(number_of_reviews, bedrooms) AS slope, regr_intercept(number_of_reviews, bedrooms) AS intercept,
         regr_count(number_of_reviews, bedrooms) AS n
  FROM listings_split WHERE split = 'train'),
ols_scored AS (
  SELECT s.id, CAST(s.number_of_reviews AS DOUBLE) AS label, f.intercept + f.slope * s.bedrooms AS prediction,
         s.bedrooms, {BAND_SQL} AS seg
  FROM listings_split s, ols_fit f
  WHERE s.split = 'test' AND s.bedrooms IS NOT NULL AND s.number_of_reviews IS NOT NULL),
ols_metrics AS (
  SELECT sqrt(avg((label - prediction) * (label - prediction))) AS rmse, avg(abs(label - prediction)) AS mae,
         1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) AS r2,
         count(*) AS samples
  FROM ols_scored)
"""

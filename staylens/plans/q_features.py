"""Registered queries: encodings and transforms (C1-C11) and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from staylens.operators import features as FT
from staylens.operators import splits as S
from staylens.plans import frames
from staylens.plans.registry import register
from staylens.plans.q_cleaning import ROOM_LEVELS, _dummy_sql

# Levels of the fixture's categorical columns (from the testdata).
PROPERTY_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NATION_LEVELS = sorted(f"NATION_{i}" for i in range(25))


@register("one_hot_drop_first", f"""
SELECT id, {_dummy_sql('neighbourhood', NATION_LEVELS[1:])}, {_dummy_sql('room_type', ROOM_LEVELS[1:])},
       {_dummy_sql('property_type', PROPERTY_LEVELS[1:])}
FROM listings_keyed_clean""")
def one_hot_drop_first(spark, sf):
    k = frames.keyed(spark, sf).select("id", "neighbourhood", "room_type", "property_type")
    return FT.one_hot_drop_first(k, ["neighbourhood", "room_type", "property_type"])


@register("one_hot_ignore_unknown", f"""
SELECT id, {_dummy_sql('neighbourhood', NATION_LEVELS)}, {_dummy_sql('room_type', ROOM_LEVELS)}
FROM listings_split WHERE split = 'test'""")
def one_hot_ignore_unknown(spark, sf):
    s = frames.split(spark, sf).select("id", "neighbourhood", "room_type", "split")
    model = FT.OneHotColumns(["neighbourhood", "room_type"], dropFirst=False).fit(s.where("split = 'train'"))
    return model.transform(s.where("split = 'test'")).drop("split")


NUM5 = frames.NUMERIC_FEATURES


def _fill_sql(stat_fn: str, cols, where_fit: str = "split = 'train'", where_apply: str = "split = 'test'"):
    stats = ", ".join(f"{stat_fn.format(c=c)} AS m_{c}" for c in cols)
    fills = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), t.m_{c}) AS {c}" for c in cols)
    return f"""
SELECT s.id, {fills}
FROM listings_split s, (SELECT {stats} FROM listings_split WHERE {where_fit}) t
WHERE s.{where_apply}"""


@register("impute_median", _fill_sql("quantile_cont({c}, 0.5)", NUM5), {c: 6 for c in NUM5})
def impute_median(spark, sf):
    s = frames.split(spark, sf)
    model = FT.ExactImputer(NUM5, "median").fit(s.where("split = 'train'"))
    return model.transform(s.where("split = 'test'")).select("id", *NUM5)


MODE_COLS = ["review_scores_rating", "bathrooms", "bedrooms"]


def _mode_sql(c):
    return (f"(SELECT {c} FROM listings_split WHERE split = 'train' AND {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


@register("impute_mode", "SELECT id, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in MODE_COLS)
          + " FROM listings_split WHERE split = 'test'")
def impute_mode(spark, sf):
    s = frames.split(spark, sf)
    model = FT.ExactImputer(MODE_COLS, "mode").fit(s.where("split = 'train'"))
    return model.transform(s.where("split = 'test'")).select("id", *MODE_COLS)


@register("impute_mean", "SELECT id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()) AS {c}_imputed" for c in NUM5)
    + " FROM listings_keyed_clean", {f"{c}_imputed": 6 for c in NUM5})
def impute_mean(spark, sf):
    k = frames.keyed(spark, sf)
    return FT.impute_mean(k, NUM5).select("id", *[f"{c}_imputed" for c in NUM5])


def _scale_sql(cols):
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in cols)
    outs = ", ".join(f"(CAST(s.{c} AS DOUBLE) - t.m_{c}) / CASE WHEN t.s_{c} > 0 THEN t.s_{c} ELSE 1 END AS {c}"
                     for c in cols)
    return f"""
SELECT s.id, {outs}
FROM listings_split s, (SELECT {stats} FROM listings_split WHERE split = 'train') t
WHERE s.split = 'test'"""


@register("standard_scale_pop", _scale_sql(NUM5), {c: 8 for c in NUM5})
def standard_scale_pop(spark, sf):
    s = frames.split(spark, sf)
    model = FT.scaler_pop(NUM5).fit(s.where("split = 'train'"))
    return model.transform(s.where("split = 'test'")).select("id", *NUM5)


SPARK_SCALE_COLS = ["calculated_host_listings_count", "minimum_nights"]


@register("standard_scale_spark", "SELECT id, " + ", ".join(
    f"CASE WHEN stddev_samp(CAST({c} AS DOUBLE)) OVER () > 0 "
    f"THEN CAST({c} AS DOUBLE) / stddev_samp(CAST({c} AS DOUBLE)) OVER () ELSE 0.0 END AS {c}"
    for c in SPARK_SCALE_COLS) + " FROM listings_keyed_clean", {c: 8 for c in SPARK_SCALE_COLS})
def standard_scale_spark(spark, sf):
    k = frames.keyed(spark, sf).select("id", *SPARK_SCALE_COLS)
    vec = FT.assemble_features(k, SPARK_SCALE_COLS, "features")
    scaled = FT.spark_standard_scaler("features", "scaled").fit(vec).transform(vec)
    arr = vector_to_array(F.col("scaled"))
    return scaled.select("id", *[arr[i].alias(c) for i, c in enumerate(SPARK_SCALE_COLS)])


ASSEMBLE_COLS = ["calculated_host_listings_count", "minimum_nights", "price"]


@register("assemble_features", " UNION ALL ".join(
    f"SELECT id, {i} AS idx, CAST({c} AS DOUBLE) AS value FROM listings_keyed_clean"
    for i, c in enumerate(ASSEMBLE_COLS)))
def assemble_features(spark, sf):
    k = frames.keyed(spark, sf).select("id", *ASSEMBLE_COLS)
    return FT.explode_vector(FT.assemble_features(k, ASSEMBLE_COLS, "features"), "id", "features")


PCA_SQL = """
SELECT id, (z1 + z2) / sqrt(2.0) AS pc1, (z1 - z2) / sqrt(2.0) AS pc2 FROM (
  SELECT id, (b1 - avg(b1) OVER ()) / stddev_pop(b1) OVER () AS z1,
             (b2 - avg(b2) OVER ()) / stddev_pop(b2) OVER () AS z2
  FROM (SELECT id, CAST(coalesce(bedrooms, 0) AS DOUBLE) AS b1, CAST(coalesce(beds, 0) AS DOUBLE) AS b2
        FROM listings_keyed_clean))"""


@register("pca_2d", PCA_SQL, {"pc1": 6, "pc2": 6})
def pca_2d(spark, sf):
    k = frames.keyed(spark, sf).select("id", F.coalesce("bedrooms", F.lit(0)).cast("double").alias("b1"),
                                       F.coalesce("beds", F.lit(0)).cast("double").alias("b2"))
    return FT.pca_2d(k, ["b1", "b2"]).select("id", "pc1", "pc2")


def _pipeline_sql(numeric, categorical) -> str:
    """(id, idx, value) of the test rows: scaled numerics, then 0/1 of the training levels in name order."""
    parts = [f"""SELECT id, {i} AS idx, (coalesce(CAST({c} AS DOUBLE), med) - mean) / (CASE WHEN sd > 0 THEN sd ELSE 1 END) AS value
  FROM listings_split, (SELECT med, avg(coalesce(CAST({c} AS DOUBLE), med)) AS mean, stddev_pop(coalesce(CAST({c} AS DOUBLE), med)) AS sd
    FROM listings_split, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med FROM listings_split WHERE split = 'train')
    WHERE split = 'train' GROUP BY med) WHERE split = 'test'""" for i, c in enumerate(numeric)]
    before = [str(len(numeric))]
    for c in categorical:
        parts.append(f"""SELECT id, CAST({' + '.join(before)} + pos AS INT) AS idx, CAST(coalesce({c}, mode) = level AS INT) * 1.0::DOUBLE AS value
  FROM listings_split, (SELECT {c} AS level, row_number() OVER (ORDER BY {c}) - 1 AS pos FROM (SELECT DISTINCT {c} FROM listings_split
      WHERE split = 'train' AND {c} IS NOT NULL)),
    (SELECT {c} AS mode FROM listings_split WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)
  WHERE split = 'test'""")
        before.append(f"(SELECT count(DISTINCT {c}) FROM listings_split WHERE split = 'train')")
    return "\nUNION ALL ".join(parts)


PIPELINE_CATEGORICAL = [*frames.CATEGORICAL_FEATURES, "property_type"]


@register("column_pipeline", _pipeline_sql(frames.ALL_NUMERIC, PIPELINE_CATEGORICAL), {"value": 8})
def column_pipeline(spark, sf):
    s = frames.split(spark, sf)
    pipe = FT.ColumnPipeline(frames.ALL_NUMERIC, PIPELINE_CATEGORICAL).fit(s.where("split = 'train'"))
    return FT.explode_vector(pipe.vectors(s.where("split = 'test'")), "id", "features")


@register("pipeline_cv")
def pipeline_cv(spark, sf):
    from staylens.operators.models import pipeline_cv as cv
    train = frames.split(spark, sf).where("split = 'train'")
    return cv(train, frames.ALL_NUMERIC, PIPELINE_CATEGORICAL, "log_price")


RFE_FEATURES = ["accommodates", "bedrooms", "beds", "bathrooms", "review_scores_rating", "minimum_nights",
                "host_listings_count", "host_response_rate", "host_acceptance_rate"]


@register("rfe_select")
def rfe_select(spark, sf):
    s = frames.split(spark, sf).where("split = 'train'")
    imp = FT.ExactImputer(RFE_FEATURES, "median").fit(s).transform(s)
    rows = FT.rfe_select(imp, RFE_FEATURES, "number_of_reviews", n=5)
    return spark.createDataFrame(rows, "feature string, ranking int, selected boolean")


@register("train_test_split", "SELECT id, split FROM listings_split")
def train_test_split(spark, sf):
    return S.hash_split(frames.keyed(spark, sf), "id", 0.2, frames.SPLIT_SEED).select("id", "split")


@register("random_split", "SELECT id FROM listings_keyed_clean")
def random_split(spark, sf):
    train, test = S.random_split(frames.keyed(spark, sf).select("id"), (0.8, 0.2), 42)
    # Which rows go where depends on the partitioning; together they are all rows, each once.
    return train.unionByName(test)


KFOLD_SQL = """
SELECT f.fold, 1 - sum((t.number_of_reviews - (f.intercept + f.slope * t.bedrooms))
                       * (t.number_of_reviews - (f.intercept + f.slope * t.bedrooms)))
                 / (var_pop(t.number_of_reviews) * count(*)) AS r2,
       count(*) AS n
FROM (SELECT g.fold, regr_slope(s.number_of_reviews, s.bedrooms) AS slope,
             regr_intercept(s.number_of_reviews, s.bedrooms) AS intercept
      FROM (SELECT DISTINCT fold FROM listings_split WHERE split = 'train') g
      JOIN listings_split s ON s.split = 'train' AND s.fold <> g.fold GROUP BY g.fold) f
JOIN listings_split t ON t.split = 'train' AND t.fold = f.fold
WHERE t.bedrooms IS NOT NULL AND t.number_of_reviews IS NOT NULL
GROUP BY f.fold"""


@register("kfold_cv", KFOLD_SQL, {"r2": 8})
def kfold_cv(spark, sf):
    s = frames.split(spark, sf).where("split = 'train'")
    return S.kfold_ols_r2(s, "bedrooms", "number_of_reviews", "fold")

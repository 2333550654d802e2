"""Registered queries against their DuckDB oracles on sf0.001 (a representative subset),
and the streaming twin of the cleaner."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FAST = ["top_neighbourhoods", "quantile_cap", "drop_duplicates", "dropna_key_columns", "write_splits",
        "one_hot_drop_first", "impute_median", "impute_mode", "standard_scale_pop", "pca_2d", "kfold_cv",
        "segment_linear", "assign_clusters", "silhouette", "davies_bouldin", "calinski_harabasz",
        "segment_metrics", "box_stats", "corr_matrix", "kde_grid", "histogram", "scatter_matrix", "geo_grid",
        "semi_join_top", "scan_raw_csv", "metric_boxstats"]


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v))
                          else (repr(float(v)) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool)
                                else str(v)))
    return sorted(map(tuple, df.itertuples(index=False, name=None)), key=repr)


def test_every_key_has_callable_and_most_have_sql():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 80 and set(sql) <= set(qs)
    assert len(sql) >= 65


@pytest.mark.parametrize("key", FAST)
def test_oracle(spark, duck, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.execute(E.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["neighbourhood", "median"] and 0 < df.count() <= 10


def test_stream_equals_batch(spark, tmp_path):
    from staylens.operators.cleaning import ListingCleaner
    from staylens.sources.fixtures import listings_raw
    from staylens.streaming import clean_stream
    raw = listings_raw(spark, SF_SMALL)
    model = ListingCleaner().fit(raw)
    src = str(tmp_path / "raw")
    raw.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = clean_stream(stream, model).writeStream.format("memory").queryName("clean_stream_t") \
        .outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM clean_stream_t")
    batch = model.transform(raw)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0

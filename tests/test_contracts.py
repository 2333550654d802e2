"""Missing values, awkward names, many levels and clusters, raw CSV, model keys, segment rows."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.operators import clustering as CL
from staylens.operators import explore as X
from staylens.operators import features as FT
from staylens.operators import models as M
from staylens.session import wide_projection_mode
from staylens.sources.readers import csv_records, load_or_infer_features, save_feature_catalog, scan_raw_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("bedrooms", T.LongType()),
                       T.StructField("name", T.StringType()), T.StructField("rating", T.DoubleType())])
NAN = float("nan")


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_bound_by_header_name(spark, tmp_path):
    a = write(tmp_path / "a.csv", 'bedrooms,id,name,rating,more\n3.0,1,"x, ""y""\nz",4.5,q\n,2,NA,NaN,q\n')
    b = write(tmp_path / "b.csv", "id,name\n3,w\n")
    rows = {r.id: tuple(r) for r in scan_raw_csv(spark, [a, b], SCHEMA).collect()}
    assert rows == {1: (1, 3, 'x, "y"\nz', 4.5), 2: (2, None, None, None), 3: (3, None, "w", None)}


@pytest.mark.parametrize("value", ["12abc", "3.5", "1e30"])
def test_csv_junk_fails_or_is_null(spark, tmp_path, value):
    p = write(tmp_path / "a.csv", f"id,bedrooms\n1,{value}\n")
    with pytest.raises(Exception, match="bedrooms"):
        scan_raw_csv(spark, p, SCHEMA).collect()
    assert scan_raw_csv(spark, p, SCHEMA, strict=False).first().bedrooms is None


def awkward_csv(rnd, n, end):
    def field():
        text = "".join(rnd.choice(["a", "bc ", ",", '"', "\n", "\r\n", "\u00e9", " "]) for _ in range(rnd.randrange(40)))
        return text.replace(",", "").replace('"', "").replace("\n", "").replace("\r", "") if rnd.random() < 0.5 else '"' + text.replace('"', '""') + '"'
    return end.join(["id,name,rating", *[f"{i},{field()},{rnd.randrange(50) / 10}" for i in range(n)]]) + rnd.choice(["", end, end * 2])


@pytest.mark.parametrize("seed,size,end", [(1, "64", "\n"), (2, "300", "\n"), (3, "1000", "\r\n"), (4, "64m", "\n")])
def test_csv_by_ranges_reads_what_one_task_reads(spark, tmp_path, seed, size, end):
    """Byte ranges far smaller than records, records over many ranges, several files of a folder."""
    rnd = random.Random(seed)
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(awkward_csv(rnd, 40, end).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        key = lambda r: [(x is not None, x) for x in r]
        got, want = [sorted(map(tuple, scan_raw_csv(spark, str(tmp_path), SCHEMA, ranges=by).collect()), key=key) for by in (True, False)]
        tasks = csv_records(spark, str(tmp_path)).select("file").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    if end == "\r\n":  # the reader of whole files turns line ends in quotes of such files into \n, ranges keep them
        got = sorted((tuple(x.replace(end, "\n") if isinstance(x, str) else x for x in r) for r in got), key=key)
    assert tasks == 2 and len(got) == 80 and got == want


def test_csv_by_ranges_refuses_stray_quotes_and_other_headers(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,name\n1,5" pipe\n2,7" pipe\n')
    with pytest.raises(Exception, match="quote inside"):
        scan_raw_csv(spark, p, SCHEMA).collect()
    assert scan_raw_csv(spark, p, SCHEMA, ranges=False).count() == 2
    (tmp_path / "two").mkdir()
    write(tmp_path / "two" / "a.csv", "id,name\n1,x\n")
    write(tmp_path / "two" / "b.csv", "id,rating\n1,2\n")
    with pytest.raises(Exception, match="headers differ"):
        scan_raw_csv(spark, str(tmp_path / "two"), SCHEMA).collect()


def test_feature_list_is_loaded_or_inferred(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0)], "a int, b double, c string, price double")
    path = str(tmp_path / "features")
    assert load_or_infer_features(spark, path, df) == ["a", "b"]
    save_feature_catalog(spark, ["b"], path)
    assert load_or_infer_features(spark, path, df) == ["b"]
    save_feature_catalog(spark, ["b", "gone"], path)
    assert load_or_infer_features(spark, path, df) == ["a", "b"]


def test_segment_ols_uses_complete_rows(spark):
    rows = [(i, i % 2, None if i % 4 == 0 else NAN if i % 9 == 0 else float(i), 3.0 * i + 1) for i in range(200)]
    got = M.segment_ols(spark.createDataFrame(rows, "id long, seg int, x double, y double"), ["x"], "y", "seg").collect()
    for r in got:
        assert (r.coef_x, r.intercept) == (pytest.approx(3.0), pytest.approx(1.0))
        assert r.n == sum(x is not None and x == x for _, s, x, _ in rows if s == r.seg)


def test_closed_form_ols_with_collinear_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    rows = [(float(a), float(b), float(a), 2 * a - b + 5) for a, b in x.tolist()] + [(None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    out = M.ClosedFormOLS(["a", "b", "c"], "y").fit(df).transform(df).where("a is not null")
    assert out.where("abs(prediction - y) > 1e-8").count() == 0


POINTS = [(float(i % 7) + 20 * (i % 3), float(i % 5), i % 3) for i in range(90)]


def test_missing_features_and_labels_take_no_part(spark):
    full = spark.createDataFrame(POINTS, "a double, b double, lab int")
    odd = full.unionByName(spark.createDataFrame([(None, 1.0, 0), (NAN, 1.0, 1), (5.0, 5.0, None)], full.schema))
    want, got = CL.cluster_indices(full, ["a", "b"], "lab"), CL.cluster_indices(odd, ["a", "b"], "lab")
    assert got == pytest.approx(want)
    for name in ("inertia", "silhouette", "davies_bouldin", "calinski_harabasz"):
        assert getattr(CL, name)(odd, ["a", "b"], "lab").first()[0] == pytest.approx(want[name])
    labelled = CL.assign_clusters(odd, ["a", "b"], [[0, 0], [20, 0], [40, 0]], "c")
    assert labelled.where("c is null").count() == 2
    assert all(r.c is None for r in labelled.where("a is null or isnan(a)").collect())
    assert CL.cluster_indices(full.where("false"), ["a", "b"], "lab")["inertia"] is None


def test_silhouette_far_from_the_origin(spark):
    near = CL.silhouette(spark.createDataFrame(POINTS, "a double, b double, lab int"), ["a", "b"], "lab").first()
    far = CL.silhouette(spark.createDataFrame([(a + 1e8, b - 1e8, c) for a, b, c in POINTS], "a double, b double, lab int"),
                        ["a", "b"], "lab").first()
    assert far.silhouette == pytest.approx(near.silhouette, abs=1e-6) and near.method == "squared_euclidean"


def test_more_clusters_than_are_written_out(spark):
    k = 1200
    centers = [[float(j), float(j % 2)] for j in range(k)]
    df = spark.createDataFrame([(float(j) + 0.1, float(j % 2)) for j in range(k)] * 2, "a double, b double")
    got = CL.assign_clusters(df, ["a", "b"], centers, "c")
    assert got.where("c != cast(a as int)").count() == 0 and got.select("c").distinct().count() == k
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y), int(i % 150)) for i, (x, y) in enumerate(rng.normal(size=(450, 2)))]
    small = spark.createDataFrame(pts, "a double, b double, lab int")
    got = CL.silhouette(small, ["a", "b"], "lab").first().silhouette
    assert got == pytest.approx(CL.silhouette_pairs(np.array([p[:2] for p in pts]), np.array([p[2] for p in pts])))


def test_nan_is_missing_for_imputers(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (NAN, "x"), (None, None)], "v double, s string")
    assert [r.v for r in FT.ExactImputer(["v"], "mean").fit(df).transform(df).collect()] == [1.0, 3.0, 2.0, 2.0]
    assert [r.v for r in FT.ExactImputer(["v"], "median").fit(df).transform(df).collect()] == [1.0, 3.0, 2.0, 2.0]
    out = FT.ExactImputer(["v", "s"], "mode").fit(df).transform(df).collect()
    assert [(r.v, r.s) for r in out] == [(1.0, "x"), (3.0, "y"), (1.0, "x"), (1.0, "x")]


def test_level_names_with_dots_and_backticks(spark):
    rows = [(lv, float(i % 5), 2.0 * (i % 5) + (lv == "St. Paul")) for i, lv in enumerate(["St. Paul", "a`b", "c"] * 20)]
    df = spark.createDataFrame(rows, "town string, x double, y double")
    enc = FT.OneHotColumns(["town"], dropFirst=True).fit(df)
    out = enc.transform(df)
    model = M.ols_fit(out, ["x", *enc.new_columns()], "y")
    assert M.score(model, out, ["x", *enc.new_columns()]).where("abs(prediction - y) > 1e-6").count() == 0
    assert len(FT.rfe_select(out, ["x", *enc.new_columns()], "y", n=1)) == 3


def test_one_hot_beyond_ten_thousand_levels(spark):
    n = 10_050
    df = spark.range(n).select("id", F.when(F.col("id") < n - 1, F.format_string("L%06d", "id")).alias("level.x"))
    out = FT.one_hot_sparse(df, ["level.x"]).withColumn("v", F.col("`level.x_vec`"))
    one = out.where("id in (0, 1, 7000, 10048, 10049)").orderBy("id").collect()
    assert all(r.v.size == n - 2 for r in one)
    assert [r.v.indices.tolist() for r in one] == [[], [0], [6999], [10047], []]
    few = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("zz",)], "s string")
    train = few.where("s != 'zz'")
    got = FT.one_hot_sparse(few, ["s"], drop_first=False, train=train).select("s", vector_to_array("s_vec").alias("v")).collect()
    assert {r.s: r.v for r in got} == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], None: [0, 0, 0], "zz": [0, 0, 0]}


def test_gramian_is_one_pass_of_any_width(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 13))
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(x.tolist() + [[None] * 13], ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(3)
    z = np.hstack([np.ones((50, 1)), x])
    assert FT.gramian_matrix(df, cols, "y") == pytest.approx(z.T @ z)
    assert not any("Expand" in line or "Join" in line for line in FT.gramian_rows(df, cols, "y")._jdf.queryExecution().toString().split("\n"))


def test_geo_grid_keeps_medians_of_rows_without_a_level(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1.0, "a"), (0.6, 0.2, 3.0, None), (0.7, 0.1, 5.0, None)], "x double, y double, v double, t string")
    got = {r.t: (r["count"], r.median) for r in X.geo_grid(df, "x", "y", 1.0, "v", by="t").collect()}
    assert got == {"a": (1, 1.0), None: (2, 4.0)}


def test_generators_do_not_multiply_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), "id")
    for out in (X.kde_grid(df, "x"), X.corr_matrix(df, ["x", "y"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(sequence" not in plan.replace("#", "")
    c = {(r.col_a, r.col_b): r["corr"] for r in X.corr_matrix(df, ["x", "y"]).collect()}
    assert c["x", "x"] == pytest.approx(1.0) and c["x", "y"] == pytest.approx(df.stat.corr("x", "y"), abs=1e-9)
    assert X.poisson1_cdf()[-1] == pytest.approx(1.0, abs=1e-15) and len(X.poisson1_cdf()) > 15


def test_overlapping_wide_modes_restore_the_setting(spark):
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    a, b = wide_projection_mode(spark), wide_projection_mode(spark)
    a.__enter__()
    b.__enter__()
    a.__exit__(None, None, None)
    assert spark.conf.get(key) == "false"
    b.__exit__(None, None, None)
    assert spark.conf.get(key) == before


def test_model_key_tells_stages_and_data_apart(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)] * 5, "s string, y double")

    def pipe(invalid):
        return Pipeline(stages=[StringIndexer(inputCol="s", outputCol="i", handleInvalid=invalid),
                                VectorAssembler(inputCols=["i"], outputCol="features", handleInvalid="keep"),
                                LinearRegression(labelCol="y")])
    keys = {M.content_key(["i"], pipe("keep"), df), M.content_key(["i"], pipe("skip"), df),
            M.content_key(["i"], pipe("keep"), df.limit(9)), M.content_key(["i"], pipe("keep"), df.withColumn("y", F.col("y") + 1))}
    assert len(keys) == 4 and M.content_key(["i"], pipe("keep"), df.repartition(3)) in keys


def test_skipped_and_failed_segments_have_rows(spark, monkeypatch):
    rows = [(i, float(i % 11), 2.0 * (i % 11), i % 2) for i in range(200)] + [(1000 + i, 1.0, 1.0, 7) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, x double, y double, seg int")
    spec = M.SegmentSpec(cluster_col="seg", target_col="y", numeric_cols=["x"], model_types=["linear", "rf"], min_cluster_size=20)

    def broken(*a, **kw):
        raise ValueError("no forest today")
    monkeypatch.setattr(M, "rf_regressor", broken)
    table, models = M.train_segments(df, spec, key="id", tune=False)
    got = {(r.cluster, r.model_type): r for r in table.collect()}
    assert set(models) == {(0, "linear"), (1, "linear")}
    assert got["7", "linear"].status == "skipped" and got["0", "rf"].status == "failed" and "no forest" in got["0", "rf"].error
    ok = got["1", "linear"]
    assert ok.status == "ok" and set(ok.weights) == {"x", "intercept"} and ok.params["solver"] == "normal" and ok.rmse < 0.5


def test_a_failed_segment_ends_the_comparison(spark, monkeypatch):
    """the comparison drops rows without metrics, so a failed fit left a result with fewer rows."""
    from staylens.plans import q_models

    rows = [(i, float(i % 11), 2.0 * (i % 11), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, log_price double, cluster_assignment int")
    monkeypatch.setattr(q_models, "_imputed_split", lambda *a: (df, ["x"]))
    monkeypatch.setattr(q_models.CL, "kmeans_spark", lambda *a, **kw: None)
    monkeypatch.setattr(q_models.CL, "model_centroids", lambda *a: None)
    monkeypatch.setattr(q_models.CL, "assign_clusters", lambda *a: df)
    monkeypatch.setattr(q_models, "global_models", lambda *a: [("none", df.select("log_price", F.col("x").alias("prediction")))])

    class Lost(M.RandomForestRegressor):
        def fit(self, data, *a):
            raise RuntimeError("executor lost")

    got = {(r.scope, r.cluster) for r in q_models.evaluate_all(spark, "").collect()}
    assert got == {("global", None), ("cluster", "0"), ("cluster", "1")}
    monkeypatch.setattr(M, "rf_regressor", lambda *a, **kw: Lost())
    with pytest.raises(RuntimeError, match="segment"):
        q_models.evaluate_all(spark, "")
    assert {r.status for r in q_models.segment_price_rf(spark, "").collect()} == {"failed"}


def test_segments_without_training_rows_are_no_failures(spark):
    from staylens.operators.splits import hash_split

    held = [r.id for r in hash_split(spark.range(200), "id", 0.2, 42).where("split = 'test'").collect()][:5]
    rows = [(i, float(i % 7), float(i % 7), 0) for i in range(1000, 1100)] + [(i, 1.0, 1.0, 1) for i in held]
    df = spark.createDataFrame(rows, "id long, x double, y double, seg int")
    spec = M.SegmentSpec(cluster_col="seg", target_col="y", numeric_cols=["x"], model_types=["rf"], min_cluster_size=1)
    table, models = M.train_segments(df, spec, key="id", tune=False, strict=True)
    got = {r.cluster: r for r in table.collect()}
    assert set(models) == {(0, "rf")} and got["0"].status == "ok"
    assert got["1"].status == "skipped" and "train" in got["1"].error


def test_segment_fits_read_their_own_files(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("_segment"))
    df.write.partitionBy("_segment").parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where("_segment = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_segment" in plan


def test_pipeline_cv_learns_without_the_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), None if i % 10 == 0 else float(rng.normal()), "pq"[i % 2], i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, fold int").withColumn(
        "y", 3 * F.col("a") + F.coalesce("b", F.lit(0.0)) + F.when(F.col("c") == "p", 2).otherwise(0))
    got = M.pipeline_cv(df, ["a", "b"], ["c"], "y", n=3).collect()
    assert len(got) == 5 and sum(r.n for r in got) == 400 and all(r.r2 > 0.98 and "a" in r.features for r in got)

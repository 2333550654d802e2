"""Models and scoring (E1-E8, E13-E16, D4, D5) on pyspark.ml.

Closed forms (OLS per segment) are grouped Gramian aggregates; trees, forests,
boosting and k-means are MLlib estimators, forests over many rows are grown by ``forest``.  Per-segment fits run from a bounded
thread pool over one persisted input, after small segments are dropped by a
single grouped count.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.scalar import quoted, x_of
from staylens.operators import forest
from staylens.operators.features import (ColumnPipeline, ExactImputerModel, OneHotColumnsModel, assemble_features, gramian,
                                         gramian_matrix, normal_equations, scaler_pop, solve_ols)
from staylens.operators.folds import FoldComplements, pipeline_cv  # noqa: F401
from staylens.session import (FIT_PARTITIONS, by_size, default_parallelism, durable_root, materialize, scratch_path, ship_package,
                              size_parts, wide_projection_mode)
from staylens.sources.readers import path_exists


def ols_fit(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0, elastic: float = 0.0):
    """MLlib LinearRegression (normal-equation solver when unregularised)."""
    data = assemble_features(df.where(F.col(label).isNotNull()), features, "features")
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=elastic,
                          solver="normal" if reg == 0 else "auto", standardization=False)
    with wide_projection_mode(df.sparkSession):
        return lr.fit(data)


class ClosedFormOLS:
    """OLS over the complete rows from one Gramian pass over standardised features.

    Collinear features share their weight (minimum norm of the standardised system), where an
    iterative solver would stop somewhere along the valley."""

    def __init__(self, features: Sequence[str], label: str):
        self.features, self.label = list(features), label

    def fit(self, df: DataFrame) -> "ClosedFormOLS":
        df = df.where(reduce(lambda a, b: a & b, [x_of(c).isNotNull() for c in [*self.features, self.label]]))
        self.scaler = scaler_pop(self.features).fit(df)
        g = gramian_matrix(self.scaler.transform(df), self.features, self.label)
        n = g[0, 0]
        self.intercept, *self.coefficients = (
            float(c) for c in np.linalg.pinv(g[:-1, :-1] / n, rcond=1e-10, hermitian=True) @ (g[:-1, -1] / n))
        return self

    def known(self, intercept: float, coefficients: Sequence[float]) -> "ClosedFormOLS":
        """The model of given coefficients, on the features as they are."""
        self.scaler = scaler_pop(self.features).learned({c: [0.0, 1.0] for c in self.features})
        self.intercept, self.coefficients = float(intercept), [float(w) for w in coefficients]
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        e = F.lit(self.intercept)
        for c, w in zip(self.features, self.coefficients):
            mean, sd = self.scaler.getOrDefault("stats")[c]
            e = e + (x_of(c) - F.lit(mean)) * F.lit(w / (sd if sd and sd > 0 else 1.0))
        return df.withColumn(out, e)


def score(model, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Predictions of a fitted model on (held-out) rows."""
    data = assemble_features(df, features, "features", invalid="keep")
    pred = model.transform(data).drop("features")
    return pred if out == "prediction" else pred.withColumnRenamed("prediction", out)


def coefficient_map(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """(feature, coefficient) rows plus the intercept."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    rows.append(("intercept", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def importance_topk(spark: SparkSession, model, names: Sequence[str], n: int = 20) -> DataFrame:
    """Tree-ensemble importances, top n descending (name breaks ties)."""
    imp = model.featureImportances.toArray()
    rows = [(nm, float(v)) for nm, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature").limit(n)


def param_report(spark: SparkSession, model) -> DataFrame:
    """Fitted params as one name -> string map."""
    params = {p.name: str(v) for p, v in model.extractParamMap().items()}
    return spark.createDataFrame([(params,)], "params map<string,string>")


def tree_row_bytes(features: int, trees: int) -> int:
    """Bytes that MLlib keeps of a training row: a bin per feature, a count and a cached node per tree (old, new and
    read), and the objects around them (features once more as doubles, while rows are read)."""
    return 160 + 12 * features + 16 * trees


def tree_rows(df: DataFrame, features: Sequence[str], label: str, trees: int, n: int | None = None) -> DataFrame:
    """(features, label) of the ``n`` labelled rows, in partitions of bounded size: MLlib keeps one block for each."""
    rows = df.where(F.col(label).isNotNull()).select(label, *[F.col(quoted(c)) for c in features])
    return assemble_features(by_size(rows, tree_row_bytes(len(features), trees), n), features, "features", invalid="keep").select("features", label)


def rf_regressor(label: str, features_col: str = "features", **kw) -> RandomForestRegressor:
    """Random forest; keyword params override MLlib defaults.

    Node-id caching and a larger node-statistics budget let MLlib grow many nodes
    per pass over the data (fewer jobs for deep trees); they do not change the model.
    """
    kw.setdefault("seed", 42)
    kw.setdefault("cacheNodeIds", True)
    kw.setdefault("maxMemoryInMB", 1024)
    return RandomForestRegressor(featuresCol=features_col, labelCol=label, **kw)


def gbt_regressor(label: str, features_col: str = "features", **kw) -> GBTRegressor:
    """Gradient-boosted trees."""
    kw.setdefault("seed", 42)
    kw.setdefault("cacheNodeIds", True)
    kw.setdefault("maxMemoryInMB", 1024)
    return GBTRegressor(featuresCol=features_col, labelCol=label, **kw)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, **kw):
    """MLlib's fit, or ``forest.grow`` over many rows."""
    est = rf_regressor(label, **kw)
    with wide_projection_mode(df.sparkSession):
        labelled = df.where(F.col(label).isNotNull())
        n = labelled.count()
        if n >= forest.MANY_ROWS and forest.grows(est):
            return forest.grow(labelled.select(F.col(label).cast("double").alias("_y"), *[
                F.col(quoted(c)).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]), n, est)
        return est.fit(tree_rows(df, features, label, est.getNumTrees(), n))


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, **kw):
    with wide_projection_mode(df.sparkSession):
        return gbt_regressor(label, **kw).fit(tree_rows(df, features, label, 1))


class LinearPipeline:
    """Preprocessing (``ColumnPipeline``), recursive elimination to ``n`` features, and OLS on them.

    Statistics, elimination and coefficients come from the two passes of ``FoldComplements``; given these
    (``stats``), fitting reads no row."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], label: str, n: int = 5):
        self.pipeline, self.label, self.n = ColumnPipeline(numeric, categorical), label, n

    def fit(self, df: DataFrame, stats: FoldComplements | None = None) -> "LinearPipeline":
        stats = stats or FoldComplements(df, self.pipeline.numeric, self.pipeline.categorical, self.label)
        found, _ = stats.learn(self.n)
        numeric, categorical, kinds = stats.numeric, stats.categorical, dict(df.dtypes)
        scaler = scaler_pop(numeric).learned({c: list(s) for c, s in zip(numeric, found.scales)})
        modes = {c: m if m is None or kinds[c] == "string" else F.lit(m).cast(kinds[c]) for c, m in zip(categorical, found.modes)}
        self.pipeline.use([ExactImputerModel(numeric, "median", "", dict(zip(numeric, found.medians))), scaler] if numeric else [],
                          [ExactImputerModel(categorical, "mode", "", modes),
                           OneHotColumnsModel(categorical, False, dict(zip(categorical, found.levels)))] if categorical else [],
                          found.features)
        self.chosen = found.chosen
        self.ols = ClosedFormOLS(self.chosen, self.label).known(found.intercept, found.coefficients)
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.ols.transform(self.pipeline.transform(df), out)


# ----------------------------------------------------------------------------- segments


def segment_ols(df: DataFrame, features: Sequence[str], label: str, segment: str) -> DataFrame:
    """E3 (lambda = 0): OLS of every segment from one grouped Gramian aggregate.

    The Gramian table has one row per segment, of the rows with a value in every
    column; the d x d solves run over that table where it lies.
    Output: segment, n, intercept, coef_<feature>.
    """
    d = len(features)
    ship_package(df.sparkSession)
    gram = gramian(df, features, label, by=[segment])
    out_schema = f"{quoted(segment)} {df.schema[segment].dataType.simpleString()}, n long, intercept double, " + \
        ", ".join(f"{quoted('coef_' + c)} double" for c in features)

    def solve(parts):
        import pandas as pd
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                coef = solve_ols(*normal_equations(r, d))
                rows.append([r[segment], int(r["n"]), *map(float, coef)])
            yield pd.DataFrame(rows, columns=[segment, "n", "intercept"] + [f"coef_{c}" for c in features])

    return gram.mapInPandas(solve, out_schema)


@dataclass
class SegmentSpec:
    """Per-segment modelling configuration."""
    # Field names and defaults of the configuration users bring along.
    cluster_col: str = "cluster"
    target_col: str = "minimum_nights"
    min_cluster_size: int = 20
    categorical_cols: list = field(default_factory=list)
    numeric_cols: list = field(default_factory=lambda: ["calculated_host_listings_count"])
    model_types: list = field(default_factory=lambda: ["linear", "rf"])
    cv_folds: int = 3
    seed: int = 42
    parallelism: int = 8
    linear_grid: dict = field(default_factory=lambda: {"elasticNetParam": [0.0, 0.5, 1.0],
                                                       "regParam": [0.01, 0.1]})
    rf_grid: dict = field(default_factory=lambda: {"maxDepth": [3, 5], "numTrees": [30, 50]})

    @property
    def features(self) -> list:
        return list(self.numeric_cols) + list(self.categorical_cols)


SEGMENT_SCHEMA = ("cluster string, model_type string, status string, error string, rmse double, r2 double, mae double, "
                  "samples long, n_features int, params map<string,string>, weights map<string,double>")


def _segment_row(seg, mtype, status, error=None, m=None, feats=(), model=None) -> tuple:
    weights = None
    if model is not None:
        values = model.coefficients if mtype == "linear" else model.featureImportances
        weights = {c: float(v) for c, v in zip(feats, values.toArray())}
        if mtype == "linear":
            weights["intercept"] = float(model.intercept)
    params = {p.name: str(v) for p, v in model.extractParamMap().items()} if model is not None else None
    scores = (m["rmse"], m["r2"], m["mae"], int(m["samples"])) if m is not None else (None, None, None, None)
    return (None if seg is None else str(seg), mtype, status, error, *scores, len(feats), params, weights)


def train_segments(df: DataFrame, spec: SegmentSpec, key: str, tune: bool = True, strict: bool = False):
    """E3/E4 with D5: per-segment linear (elastic net) and forest, cross-validated.

    The labelled table is written once, partitioned by segment, and every fit reads its own
    segment's files.  Each segment gets a stable hash split (key) into train/test; the fits of small segments
    run from a bounded thread pool, those of large ones one by one, in partitions of bounded size.  Returns (rows, models): one row per segment and model type with
    metrics on the test rows, fitted parameters and coefficients or importances; a segment below
    ``min_cluster_size`` or without training rows has status 'skipped', one whose fit fails 'failed' with the
    error.  ``strict``: the first fit that fails ends the call, for callers whose results don't show the status.
    """
    from staylens.operators.splits import cross_validator, hash_split, kfold
    from staylens.operators.metrics import regression_metrics

    spark = df.sparkSession
    feats = spec.features
    data = df.where(x_of(spec.target_col).isNotNull() & F.col(quoted(spec.cluster_col)).isNotNull())
    data = hash_split(data, key, 0.2, spec.seed)
    data = kfold(data, key, spec.cv_folds, spec.seed + 1, "_fold")
    data = data.select(F.col(quoted(spec.cluster_col)).alias("_segment"), *[x_of(c).alias(f"_x{i}") for i, c in enumerate(feats)],
                       x_of(spec.target_col).alias("_y"), "split", F.col("_fold").cast("int").alias("_fold"))
    plain = [f"_x{i}" for i in range(len(feats))]
    path = scratch_path(spark, "segments")
    with wide_projection_mode(spark):
        data.write.partitionBy("_segment").parquet(path)
    kind = df.schema[spec.cluster_col].dataType
    table = spark.read.schema(T.StructType([f for f in data.schema.fields if f.name != "_segment"]
                                           + [T.StructField("_segment", kind)])).parquet(path)
    # One row per segment: the models that follow are as many.
    counts = table.groupBy("_segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train")).collect()
    sizes, trained = ({r["_segment"]: r[c] for r in counts} for c in ("n", "train"))

    # Most trees of any fit: the partitions of a segment hold bounded blocks in all of them.
    trees = max([50, *spec.rf_grid.get("numTrees", [])]) if "rf" in spec.model_types else 0
    parts = {seg: size_parts(n, tree_row_bytes(len(feats), trees)) for seg, n in sizes.items()}

    def run(task):
        seg, mtype = task
        if sizes[seg] < spec.min_cluster_size:
            return _segment_row(seg, mtype, "skipped", f"{sizes[seg]} rows, fewer than {spec.min_cluster_size}"), None
        if not trained[seg]:
            return _segment_row(seg, mtype, "skipped", f"none of {sizes[seg]} rows to train on"), None
        part = VectorAssembler(inputCols=plain, outputCol="features", handleInvalid="error").transform(
            table.where(F.col("_segment") == F.lit(seg))).select("features", "_y", "split", "_fold")
        want = int(spark.conf.get(FIT_PARTITIONS, str(default_parallelism(spark))))
        part = (part.repartition(max(parts[seg], want)) if parts[seg] > 1 else part.coalesce(want)).persist()
        try:
            train, test = part.where("split = 'train'"), part.where("split = 'test'")
            if mtype == "linear":
                # The normal-equation solver takes one distributed pass (Gramian) and solves the
                # elastic-net problem on the d x d system locally; same optimum as L-BFGS/OWL-QN.
                est = LinearRegression(featuresCol="features", labelCol="_y", elasticNetParam=0.5, solver="normal")
                grid = spec.linear_grid
            else:
                est = rf_regressor("_y", numTrees=50, maxDepth=5, seed=spec.seed)
                grid = spec.rf_grid
            if tune:
                model = cross_validator(est, grid, "_y", spec.cv_folds, spec.seed,
                                        fold_col="_fold", parallelism=3 if parts[seg] == 1 else 1).fit(train.drop("split")).bestModel
            else:
                model = est.fit(train)
            m = regression_metrics(model.transform(test), "_y").first()
            return _segment_row(seg, mtype, "ok", None, m, feats, model), model
        except Exception as e:  # noqa: BLE001  one segment's failure is its row, not the end of the others
            if strict:
                raise RuntimeError(f"the {mtype} fit of segment {seg!r} failed") from e
            return _segment_row(seg, mtype, "failed", f"{type(e).__name__}: {str(e)[:500]}", feats=feats), None
        finally:
            part.unpersist()

    tasks = [(s, m) for s in sorted(sizes, key=str) for m in spec.model_types]
    # Fits of small segments run side by side.  One that fills many tasks runs alone, lest several push each other's
    # rows out of memory.
    with ThreadPoolExecutor(max_workers=max(1, spec.parallelism)) as pool:
        done = dict(zip(small := [t for t in tasks if parts[t[0]] == 1], pool.map(run, small)))
    results = [done[t] if t in done else run(t) for t in tasks]
    models = {task: model for task, (_, model) in zip(tasks, results) if model is not None}
    return spark.createDataFrame([row for row, _ in results], SEGMENT_SCHEMA), models


# ----------------------------------------------------------------------------- model store


def stage_description(stage) -> list:
    """(class, parameters) of an estimator, nested for pipelines; uids are left out."""
    if isinstance(stage, Pipeline):
        return ["Pipeline", [stage_description(x) for x in stage.getStages()]]
    return [type(stage).__name__, {p.name: str(v) for p, v in stage.extractParamMap().items()
                                   if stage.uid not in str(v)}]


def data_fingerprint(df: DataFrame) -> dict:
    """Schema, row count and an order-free hash of the rows: other training data, another key."""
    exact = F.xxhash64(*[F.col(quoted(f.name)) for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(exact.cast("decimal(38,0)")).alias("h")).first()
    return {"schema": df.schema.simpleString(), "rows": row["n"], "hash": str(row["h"])}


def content_key(features: Sequence[str], estimator, df: DataFrame) -> str:
    """A stable key of features, ordered stages with their parameters, and training data (Q8)."""
    blob = json.dumps([list(features), stage_description(estimator), data_fingerprint(df)], sort_keys=True)
    return hashlib.sha256(blob.encode()).hexdigest()[:16]


class ModelStore:
    """Fit-or-load by content key under a folder of the shared file system."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, name: str, key: str) -> str:
        return f"{self.root}/{name}-{key}"

    def get_or_fit(self, spark: SparkSession, name: str, estimator: Pipeline, df: DataFrame,
                   features: Sequence[str]) -> PipelineModel:
        path = self.path(name, content_key(features, estimator, df))
        # The metadata is written last by a completed save.
        if path_exists(spark, f"{path}/metadata/_SUCCESS"):
            return PipelineModel.load(path)
        model = estimator.fit(df)
        model.write().overwrite().save(path)
        return model


# The forest grid of the reference (scikit-learn names) and the MLlib names they map to.
RF_GRID = {"n_estimators": [100, 200], "max_depth": [10, 15, None], "min_samples_leaf": [1, 3, 5],
           "max_features": ["sqrt", "log2"]}
RF_PARAM_NAMES = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
                  "max_features": "featureSubsetStrategy"}
MLLIB_MAX_DEPTH = 30  # "no depth limit" becomes MLlib's deepest tree


def mllib_grid(grid: Mapping) -> dict:
    out = {}
    for name, values in grid.items():
        target = RF_PARAM_NAMES.get(name, name)
        out[target] = [MLLIB_MAX_DEPTH if (target == "maxDepth" and v is None) else v for v in values]
    return out


class ScoreStore:
    """Scores of model selection as rows in shared storage, one folder per score, named by its content.

    A folder counts once its write is complete (``_SUCCESS``), so a search that lost its driver goes on
    where it was, and searches over the same rows share their scores."""

    SCHEMA = "name string, params map<string,string>, fold int, rmse double, n long, seconds double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def done(self) -> set[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return set()
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))}

    def put(self, name: str, params: Mapping, fold: int, rmse: float | None, n: int, seconds: float) -> None:
        row = (name, {k: str(v) for k, v in params.items()}, fold, rmse, n, seconds)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def rows(self, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/{n}" for n in names])


def grid_points(grid: Mapping) -> list[dict]:
    """The points of an MLlib grid, the last parameter changing fastest."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def grid_scores(data: DataFrame, estimator, grid: Mapping, label: str, fold: str, store: ScoreStore, key: str,
                parallelism: int = 4) -> tuple[list[dict], DataFrame]:
    """(points, scores): RMSE on every fold of an estimator fitted on the others, for each point of ``grid``.

    ``data`` (features, label, fold) is read by every fit: give a materialised frame.  ``key`` names
    its content.  Scores that the store has are not computed again."""
    points = grid_points(grid)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())

    def name(point: Mapping, f: int) -> str:
        blob = json.dumps([key, stage_description(estimator.copy({estimator.getParam(p): v for p, v in point.items()})), f])
        return hashlib.sha256(blob.encode()).hexdigest()[:24]

    tasks = {name(p, f): (p, f) for p in points for f in folds}
    done = store.done()

    def run(task) -> None:
        title, (point, f) = task
        start = time.monotonic()
        model = estimator.fit(data.where(F.col(fold) != f), {estimator.getParam(p): v for p, v in point.items()})
        e = F.col("prediction") - F.col(label)
        got = model.transform(data.where(F.col(fold) == f)).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n")).first()
        store.put(title, point, int(f), got["rmse"], got["n"], time.monotonic() - start)

    # The longest fits first, lest one of them ends the search alone.
    left = [t for t in tasks.items() if t[0] not in done]
    left.sort(key=lambda t: [-v if isinstance(v, (int, float)) else 0 for v in t[1][0].values()])
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(run, left))
    return points, store.rows(list(tasks))


def rf_grid_search(df: DataFrame, features: Sequence[str], label: str, key: str, grid: Mapping = RF_GRID,
                   k: int = 5, seed: int = 42, parallelism: int = 4, store: str | None = None):
    """Forest grid search by k-fold CV RMSE (stable hash folds), refit on all rows.

    Returns (best model, frame of (params, rmse_mean, rmse_std) per grid point); the first of equal
    points wins.  Every (point, fold) score is kept in ``store`` (a folder of the shared file
    system; default: below the configured checkpoint folder), keyed by rows, parameters and fold: a search that
    ended early, and any other search over the same rows, skips what is there.
    """
    spark = df.sparkSession
    data = kfold_rows(df, features, label, key, k, seed)
    est = rf_regressor(label, seed=seed)
    try:
        content = hashlib.sha256(json.dumps([list(features), data_fingerprint(
            data.select(F.col(label), "_cv_fold", vector_to_array("features").alias("x")))], sort_keys=True).encode()).hexdigest()
        scores = ScoreStore(spark, store or f"{durable_root(spark)}/grid-scores")
        points, rows = grid_scores(data, est, mllib_grid(grid), label, "_cv_fold", scores, content, parallelism)
        summary: dict = {}
        # One row per point and fold; by fold, lest sums of equal scores differ in their last bits.
        for r in sorted(rows.select("params", "fold", "rmse").collect(), key=lambda r: r["fold"]):
            summary.setdefault(tuple(sorted(r["params"].items())), []).append(r["rmse"])
        table = []
        for p in points:
            found = summary[tuple(sorted((n, str(v)) for n, v in p.items()))]
            table.append(({n: str(v) for n, v in p.items()}, float(np.mean(found)), float(np.std(found))))
        best = min(range(len(points)), key=lambda i: table[i][1])
        model = est.fit(data, {est.getParam(n): v for n, v in points[best].items()})
    finally:
        data.unpersist()
    return model, spark.createDataFrame(table, "params map<string,string>, rmse_mean double, rmse_std double")


def kfold_rows(df: DataFrame, features: Sequence[str], label: str, key: str, k: int, seed: int) -> DataFrame:
    """(features, label, _cv_fold), materialised."""
    from staylens.operators.splits import kfold
    rows = assemble_features(df.where(F.col(label).isNotNull()), features, "features", invalid="keep")
    return materialize(kfold(rows, key, k, seed + 1, "_cv_fold").select("features", label, "_cv_fold"))

"""Feature encoding and transforms.

Learned statistics (levels, medians, modes, means, spreads) come from one
aggregate over the training rows; applying them is a projection.  Level lists
are model state: they are collected like the labels of a StringIndexerModel
where each level becomes a column, and stay a table in ``one_hot_sparse``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import quoted, x_of
from staylens.functions.stats import exact_quantiles
from staylens.operators.params import Persistable
from staylens.session import ship_package


def _levels(df: DataFrame, col: str) -> list:
    """Sorted non-null levels of a categorical column, one output column each (see ``one_hot_sparse`` for many)."""
    c = F.col(quoted(col))
    return [r[0] for r in df.where(c.isNotNull()).select(c.alias("v")).distinct().orderBy("v").collect()]


def _stack(df: DataFrame, cols: Sequence[str], key: str = "_col", value: str = "_val") -> DataFrame:
    """Long format (column name, value as double) of several numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), x_of(c).alias("v")) for c in cols])
    return df.select(F.explode(pairs).alias("_p")).select(F.col("_p.k").alias(key), F.col("_p.v").alias(value))


# ----------------------------------------------------------------------------- C1 / C2


class _OneHotParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "categorical columns")
    dropFirst = Param(Params._dummy(), "dropFirst", "drop the alphabetically first level")
    levels = Param(Params._dummy(), "levels", "learned levels per column")


class OneHotColumns(Estimator, _OneHotParams, Persistable):
    """One 0/1 int column ``<col>_<level>`` per level.

    ``dropFirst=True`` is C1 (pandas ``get_dummies(drop_first=True)``); ``False``
    is C2 (fit on train, unseen and null levels become all zeros).
    """

    def __init__(self, inputCols: Sequence[str] = ("neighbourhood", "room_type", "property_type"),
                 dropFirst: bool = True):
        super().__init__()
        self._set(inputCols=list(inputCols), dropFirst=bool(dropFirst))

    def _fit(self, df: DataFrame) -> "OneHotColumnsModel":
        cols = [c for c in self.getOrDefault("inputCols") if c in df.columns]
        levels = {c: [str(v) for v in _levels(df, c)] for c in cols}
        return OneHotColumnsModel(cols, self.getOrDefault("dropFirst"), levels)


class OneHotColumnsModel(Model, _OneHotParams, Persistable):
    def __init__(self, inputCols=(), dropFirst: bool = True, levels: Mapping[str, list] | None = None):
        super().__init__()
        self._set(inputCols=list(inputCols), dropFirst=bool(dropFirst), levels=dict(levels or {}))

    def new_columns(self) -> list[str]:
        out = []
        drop = self.getOrDefault("dropFirst")
        for c in self.getOrDefault("inputCols"):
            lv = self.getOrDefault("levels")[c]
            out += [f"{c}_{v}" for v in (lv[1:] if drop else lv)]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        drop = self.getOrDefault("dropFirst")
        new = {}
        for c in self.getOrDefault("inputCols"):
            lv = self.getOrDefault("levels")[c]
            for v in (lv[1:] if drop else lv):
                new[f"{c}_{v}"] = F.when(F.col(quoted(c)).cast("string") == F.lit(v), F.lit(1)).otherwise(F.lit(0))
        return df.withColumns(new).drop(*self.getOrDefault("inputCols"))


def one_hot_drop_first(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C1 in one call."""
    return OneHotColumns(cols, dropFirst=True).fit(df).transform(df)


def one_hot_vector(cols: Sequence[str], drop_first: bool = True, keep_unknown: bool = False) -> list:
    """C1/C2 as MLlib stages: ``<col>_idx`` and ``<col>_vec``.

    alphabetDesc order puts the alphabetically first level last, so dropLast
    drops it (C1).  With keep_unknown an extra index absorbs unseen levels and
    dropLast removes exactly that slot (C2).
    """
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols],
                        stringOrderType="alphabetDesc" if drop_first else "alphabetAsc",
                        handleInvalid="keep" if keep_unknown else "error")
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                        dropLast=True, handleInvalid="keep" if keep_unknown else "error")
    return [idx, enc]


def level_index(df: DataFrame, col: str) -> DataFrame:
    """(level, idx): the sorted non-null levels numbered from 0, as a distributed table."""
    c = F.col(quoted(col)).cast("string")
    levels = df.where(c.isNotNull()).select(c.alias("level")).distinct().orderBy("level")
    numbered = levels.rdd.zipWithIndex().map(lambda p: (p[0][0], p[1]))
    return df.sparkSession.createDataFrame(numbered, "level string, idx long")


def one_hot_sparse(df: DataFrame, cols: Sequence[str], drop_first: bool = True, train: DataFrame | None = None) -> DataFrame:
    """C1/C2 for any number of levels: ``<col>_vec`` as a sparse vector with one slot per level of
    ``train`` (default: ``df``).  Unseen and null levels, and the first one if dropped, are all zeros.

    The levels stay a table that is joined, so neither the driver nor the plan grows with them;
    only their number is collected."""
    for c in cols:
        index = level_index(df if train is None else train, c).persist()
        size = index.count()
        at = F.col("idx") - 1 if drop_first else F.col("idx")
        slots = max(size - 1 if drop_first else size, 1)
        # The encoder's dropped last slot takes the rows that are to be all zeros.
        joined = (df.join(index.select("level", at.alias("_at")), F.col(quoted(c)).cast("string") == F.col("level"), "left")
                  .withColumn("_at", F.when(F.col("_at") >= 0, F.col("_at")).otherwise(slots).cast("double")).drop("level"))
        sizes = df.sparkSession.createDataFrame([(float(slots),)], "_at double")
        encoder = OneHotEncoder(inputCols=["_at"], outputCols=[f"{c}_vec"], dropLast=True).fit(sizes)
        df = encoder.transform(joined).drop("_at")
        index.unpersist()
    return df


# ----------------------------------------------------------------------------- C3-C5


def _value(col: str, kind: str) -> Column:
    """A column with NaN as NULL."""
    c = F.col(quoted(col))
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


class _ImputeParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to impute")
    strategy = Param(Params._dummy(), "strategy", "median | mode | mean")
    suffix = Param(Params._dummy(), "suffix", "output column suffix ('' = in place)")
    values = Param(Params._dummy(), "values", "learned fill values")


class ExactImputer(Estimator, _ImputeParams, Persistable):
    """C3 (exact median), C4 (mode, ties to smallest), C5 (mean) in one fit.

    Medians: one distributed exact-quantile plan over the stacked columns.
    Modes: one grouped count over (column, value).  Means: one agg.  NaN counts as
    missing, in the statistics and in the rows to fill.
    """

    def __init__(self, inputCols: Sequence[str] = (), strategy: str = "median", suffix: str = ""):
        super().__init__()
        self._set(inputCols=list(inputCols), strategy=strategy, suffix=suffix)

    def _fit(self, df: DataFrame) -> "ExactImputerModel":
        cols = list(self.getOrDefault("inputCols"))
        strategy = self.getOrDefault("strategy")
        if strategy == "mean":
            row = df.agg(*[F.avg(x_of(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
            values = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        elif strategy == "median":
            st = _stack(df, cols)
            rows = exact_quantiles(st, "_val", {"m": 0.5}, by=["_col"]).collect()
            values = {r["_col"]: r["m"] for r in rows}
        elif strategy == "mode":
            # One plan for all columns: each value goes along as text (to count and order by) in a struct
            # with a slot per column, so that it keeps its type.
            kinds = dict(df.dtypes)
            slots = [F.struct(F.lit(i).alias("i"), *[(_value(c, kinds[c]) if i == j else F.lit(None).cast(kinds[c])).alias(f"v{j}")
                                                    for j, c in enumerate(cols)]) for i in range(len(cols))]
            names = [f"v{j}" for j in range(len(cols))]
            counts = (df.select(F.inline(F.array(*slots))).where(F.coalesce(*[F.col(v).cast("string") for v in names]).isNotNull())
                      .groupBy("i", *names).agg(F.count(F.lit(1)).alias("n")))
            best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), *names)).alias("m")).collect()
            values = {cols[r["i"]]: r["m"][f"v{r['i']}"] for r in best}
        else:
            raise ValueError(strategy)
        return ExactImputerModel(cols, strategy, self.getOrDefault("suffix"), values)


class ExactImputerModel(Model, _ImputeParams, Persistable):
    def __init__(self, inputCols=(), strategy: str = "median", suffix: str = "", values=None):
        super().__init__()
        self._set(inputCols=list(inputCols), strategy=strategy, suffix=suffix, values=dict(values or {}))

    def _transform(self, df: DataFrame) -> DataFrame:
        vals = self.getOrDefault("values")
        sfx = self.getOrDefault("suffix")
        out, kinds = {}, dict(df.dtypes)
        for c in self.getOrDefault("inputCols"):
            v = vals.get(c)
            src = x_of(c) if self.getOrDefault("strategy") in ("median", "mean") else _value(c, kinds[c])
            out[c + sfx] = src if v is None else F.coalesce(src, F.lit(v))
        return df.withColumns(out)


def impute_mean(df: DataFrame, cols: Sequence[str], suffix: str = "_imputed") -> DataFrame:
    """``<c>_imputed`` = column with nulls replaced by its (double) mean."""
    return ExactImputer(cols, "mean", suffix).fit(df).transform(df)


# ----------------------------------------------------------------------------- C6 / C7


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale")
    withMean = Param(Params._dummy(), "withMean", "centre")
    ddof = Param(Params._dummy(), "ddof", "0 = population spread, 1 = sample spread")
    suffix = Param(Params._dummy(), "suffix", "output suffix ('' = in place)")
    stats = Param(Params._dummy(), "stats", "learned (mean, std) per column")


class ColumnScaler(Estimator, _ScalerParams, Persistable):
    """``(x - mean) / stddev_pop`` (zero spread divides by 1); C7 with
    ``withMean=False, ddof=1``: ``x / stddev_samp`` (zero spread gives 0)."""

    def __init__(self, inputCols: Sequence[str] = (), withMean: bool = True, ddof: int = 0, suffix: str = ""):
        super().__init__()
        self._set(inputCols=list(inputCols), withMean=bool(withMean), ddof=int(ddof), suffix=suffix)

    def learned(self, stats: Mapping[str, list]) -> "ColumnScalerModel":
        """The model of given (mean, std) per column."""
        return ColumnScalerModel(self.getOrDefault("inputCols"), self.getOrDefault("withMean"), self.getOrDefault("ddof"),
                                 self.getOrDefault("suffix"), stats)

    def _fit(self, df: DataFrame) -> "ColumnScalerModel":
        cols = self.getOrDefault("inputCols")
        sd = F.stddev_pop if self.getOrDefault("ddof") == 0 else F.stddev_samp
        aggs = []
        for i, c in enumerate(cols):
            x = x_of(c)
            aggs += [F.avg(x).alias(f"m{i}"), sd(x).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        stats = {c: [row[f"m{i}"], row[f"s{i}"]] for i, c in enumerate(cols)}
        return ColumnScalerModel(cols, self.getOrDefault("withMean"), self.getOrDefault("ddof"),
                                 self.getOrDefault("suffix"), stats)


class ColumnScalerModel(Model, _ScalerParams, Persistable):
    def __init__(self, inputCols=(), withMean: bool = True, ddof: int = 0, suffix: str = "", stats=None):
        super().__init__()
        self._set(inputCols=list(inputCols), withMean=bool(withMean), ddof=int(ddof), suffix=suffix,
                  stats=dict(stats or {}))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.getOrDefault("inputCols"):
            mean, sd = self.getOrDefault("stats")[c]
            x = x_of(c)
            if self.getOrDefault("withMean"):
                div = sd if (sd is not None and sd > 0 and not math.isnan(sd)) else 1.0
                out[c + self.getOrDefault("suffix")] = (x - F.lit(mean)) / F.lit(div)
            else:
                ok = sd is not None and sd > 0 and not math.isnan(sd)
                out[c + self.getOrDefault("suffix")] = x / F.lit(sd) if ok else F.lit(0.0) * x
        return df.withColumns(out)


def scaler_pop(cols: Sequence[str], suffix: str = "") -> ColumnScaler:
    return ColumnScaler(cols, withMean=True, ddof=0, suffix=suffix)


def spark_standard_scaler(input_col: str = "features", output_col: str = "scaled_features") -> StandardScaler:
    """C7 as the MLlib stage: divide by sample stddev, no centring."""
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=False, withStd=True)


# ----------------------------------------------------------------------------- C8 / C9


def assemble_features(df: DataFrame, cols: Sequence[str], out: str = "features",
                      invalid: str = "error") -> DataFrame:
    """numeric/boolean columns into one vector (``invalid='keep'`` lets NaN/null through)."""
    cast = df.withColumns({c: F.col(quoted(c)).cast("double") for c in cols})
    # The assembler can't take names with dots or backticks.
    plain = [f"_f{i}" for i in range(len(cols))]
    cast = cast.withColumns({p: F.col(quoted(c)) for p, c in zip(plain, cols)})
    return VectorAssembler(inputCols=plain, outputCol=out, handleInvalid=invalid).transform(cast).drop(*plain)


def explode_vector(df: DataFrame, key: str, vec: str, idx: str = "idx", value: str = "value") -> DataFrame:
    """(key, index, value) rows of a vector column: the comparable form of a vector."""
    return df.select(key, F.posexplode(vector_to_array(F.col(vec))).alias(idx, value))


def _fix_signs(pc: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude loading of every component positive (first one on ties)."""
    pc = pc.copy()
    for j in range(pc.shape[1]):
        col = pc[:, j]
        mx = np.max(np.abs(col))
        i = int(np.argmax(np.abs(col) >= mx * (1 - 1e-9)))
        if col[i] < 0:
            pc[:, j] = -col
    return pc


def pca_fit(df: DataFrame, cols: Sequence[str], k: int = 2):
    """MLlib PCA on the assembled columns; returns (loadings d x k, explained variance)."""
    vec = assemble_features(df, cols, "_pca_in")
    model = PCA(k=k, inputCol="_pca_in", outputCol="_pca_out").fit(vec)
    return _fix_signs(model.pc.toArray()), model.explainedVariance.toArray()


def pca_project(df: DataFrame, cols: Sequence[str], loadings: np.ndarray, names=("pc1", "pc2")) -> DataFrame:
    """Projection as plain column arithmetic (codegen'd, no vector round trip)."""
    out = {}
    for j, name in enumerate(names):
        e = None
        for i, c in enumerate(cols):
            t = F.col(quoted(c)).cast("double") * F.lit(float(loadings[i, j]))
            e = t if e is None else e + t
        out[name] = e
    return df.withColumns(out)


def pca_2d(df: DataFrame, cols: Sequence[str], names=("pc1", "pc2")) -> DataFrame:
    """Standardise (population), then project on the first two principal components."""
    scaled = scaler_pop(cols).fit(df).transform(df)
    loadings, _ = pca_fit(scaled, cols, k=len(names))
    return pca_project(scaled, cols, loadings, names)


# ----------------------------------------------------------------------------- C10 / C11


class ColumnPipeline:
    """Numeric columns -> exact median -> (x - mean) / population spread; categorical columns ->
    mode -> one 0/1 column per level of the training rows (unseen levels: all zeros); all other
    columns are dropped by the assembled vector."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str]):
        self.numeric, self.categorical = list(numeric), list(categorical)

    def fit(self, df: DataFrame) -> "ColumnPipeline":
        self.stages, self.features = [], list(self.numeric)
        if self.numeric:
            self._add(ExactImputer(self.numeric, "median"), df)
            self._add(scaler_pop(self.numeric), df)
        if self.categorical:
            self._add(ExactImputer(self.categorical, "mode"), df)
            encoder = self._add(OneHotColumns(self.categorical, dropFirst=False), df)
            self.features += encoder.new_columns()
        return self

    def use(self, numeric: Sequence[Model], categorical: Sequence[Model], features: Sequence[str]) -> "ColumnPipeline":
        """The pipeline of stages that were learned elsewhere."""
        self.stages, self.features = [*numeric, *categorical], list(features)
        return self

    def _add(self, estimator, df: DataFrame):
        for stage in self.stages:
            df = stage.transform(df)
        self.stages.append(estimator.fit(df))
        return self.stages[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the feature columns in place of the ones they come from."""
        for stage in self.stages:
            df = stage.transform(df)
        return df

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        return assemble_features(self.transform(df), self.features, out)


def gramian(df: DataFrame, cols: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics of least squares in one aggregate: n, sums, cross products.

    Output columns: n, s_<i>, s_y, p_<i>_<j> (i <= j), py_<i>, yy, over the rows that have a
    value in every column.  Partial aggregation makes this one small row per task before the shuffle.
    """
    xs = [x_of(c) for c in cols]
    y = x_of(label)
    for x in [*xs, y]:
        df = df.where(x.isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("s_y"), F.sum(y * y).alias("yy")]
    for i, x in enumerate(xs):
        aggs += [F.sum(x).alias(f"s_{i}"), F.sum(x * y).alias(f"py_{i}")]
        for j in range(i, len(xs)):
            aggs.append(F.sum(x * xs[j]).alias(f"p_{i}_{j}"))
    return df.groupBy(*[quoted(c) for c in by]).agg(*aggs)


def normal_equations(row, d: int):
    """(X'X, X'y) with an intercept column first, from one gramian row."""
    a = np.zeros((d + 1, d + 1))
    b = np.zeros(d + 1)
    a[0, 0] = row["n"]
    b[0] = row["s_y"]
    for i in range(d):
        a[0, i + 1] = a[i + 1, 0] = row[f"s_{i}"]
        b[i + 1] = row[f"py_{i}"]
        for j in range(i, d):
            a[i + 1, j + 1] = a[j + 1, i + 1] = row[f"p_{i}_{j}"]
    return a, b


def solve_ols(a: np.ndarray, b: np.ndarray, active: Sequence[int] | None = None) -> np.ndarray:
    """Minimum-norm least squares on the normal equations (pseudo-inverse), intercept kept."""
    idx = [0] + [i + 1 for i in (active if active is not None else range(a.shape[0] - 1))]
    sub = a[np.ix_(idx, idx)]
    coef = np.linalg.pinv(sub) @ b[idx]
    full = np.zeros(a.shape[0])
    full[idx] = coef
    return full


def gramian_rows(df: DataFrame, cols: Sequence[str], label: str, by: str | None = None) -> DataFrame:
    """(by, i, cells) of Z'Z for Z = [1, x_1..x_d, y] over the complete rows: row i of the matrix.

    One pass: every task multiplies its batches and sends one row of cells per matrix row (and value
    of ``by``); these are summed cell by cell."""
    xs = [x_of(c) for c in [*cols, label]]
    data = df.select((F.col(quoted(by)) if by else F.lit(0)).alias("key"), F.array(*xs).alias("x"))
    return gramian_of(data.where(F.forall("x", lambda v: v.isNotNull())), len(cols) + 2)


def gramian_of(data: DataFrame, d: int) -> DataFrame:
    """(key, i, cells) of Z'Z for Z = [1, x], from rows (key, x array<double> of d - 1 cells, none missing)."""
    ship_package(data.sparkSession)

    def run(batches):
        total: dict = {}
        for b in batches:
            z = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d - 1)
            z = np.hstack([np.ones((b.num_rows, 1)), z])
            coded = b.column(0).dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k in np.unique(codes).tolist():
                part = z[codes == k]
                key = None if k < 0 else coded.dictionary[k].as_py()
                total[key] = total.get(key, 0.0) + part.T @ part
        for k, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * d, b.schema.field(0).type), pa.array(range(d), pa.int32()),
                                              pa.array(g.tolist(), pa.list_(pa.float64()))], ["key", "i", "cells"])

    rows = data.mapInArrow(run, f"key {dict(data.dtypes)['key']}, i int, cells array<double>")
    cells = rows.select("key", "i", F.posexplode("cells").alias("j", "v")).groupBy("key", "i", "j").agg(F.sum("v").alias("v"))
    return cells.groupBy("key", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("cells"))


def gramian_matrix(df: DataFrame, cols: Sequence[str], label: str) -> np.ndarray:
    """Z'Z for Z = [1, x_1..x_d, y] over the complete rows, from one pass."""
    g = np.zeros((len(cols) + 2, len(cols) + 2))
    for r in gramian_rows(df, cols, label).collect():
        g[r["i"]] = r["cells"]
    return g


def standardized_gramian(g: np.ndarray) -> np.ndarray:
    """The Gramian of [1, (x - mean) / std_pop, y] from the Gramian of [1, x, y] (zero spread -> /1)."""
    n = g[0, 0]
    d = g.shape[0] - 2
    mean = g[0, 1:d + 1] / n
    var = np.diag(g)[1:d + 1] / n - mean ** 2
    sd = np.where(var > 1e-12 * np.maximum(1.0, mean ** 2), np.sqrt(np.maximum(var, 0)), 1.0)
    a = np.eye(d + 2)
    a[0, 1:d + 1] = -mean / sd
    a[1:d + 1, 1:d + 1] = np.diag(1.0 / sd)
    return a.T @ g @ a


def rfe_select(df: DataFrame, features: Sequence[str], label: str, n: int = 5, standardize: bool = True):
    """C11: recursive feature elimination, one feature at a time by squared OLS coefficient.

    One distributed Gramian pass (``standardize``: features on one scale; standardisation is applied to the Gramian
    algebraically, so no extra pass scales the rows); every elimination step
    solves only the d x d system.  Returns a
    list of (feature, ranking, selected) tuples, ranking 1 = kept.
    """
    g = gramian_matrix(df, features, label)
    return eliminate(standardized_gramian(g) if standardize else g, features, n)


def eliminate(g: np.ndarray, features: Sequence[str], n: int) -> list[tuple[str, int, bool]]:
    """(feature, ranking, selected) of recursive elimination down to ``n`` on the Gramian of [1, features, y]."""
    d = len(features)
    a, b = g[:d + 1, :d + 1], g[:d + 1, d + 1]
    active = list(range(d))
    ranking = {}
    step_rank = d - n + 1
    while len(active) > n:
        coef = solve_ols(a, b, active)
        weights = [coef[i + 1] ** 2 for i in active]
        worst = active[int(np.argmin(weights))]
        ranking[worst] = step_rank
        step_rank -= 1
        active.remove(worst)
    for i in active:
        ranking[i] = 1
    return [(features[i], ranking[i], ranking[i] == 1) for i in range(d)]

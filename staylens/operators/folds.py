"""Fold-complement statistics (D3): a linear pipeline cross-validated for any number of folds in two passes.

Training without fold f needs the medians, modes, levels, means and spreads of the other folds' rows, and their
Gramian.  All of these follow from sums over folds:

1. One grouped count over (column, value, fold).  The weight of a value outside fold f is its total less its
   count in f; one exact-quantile plan over these weights gives the medians of all complements at once, and the counts of
   the categorical values give modes and levels.
2. One Gramian per fold of a raw layout that no fold's statistics enter: numbers less a common centre (missing ones as 0),
   missing-value marks, one indicator per level, the label.  Imputing, scaling and encoding are linear
   in that layout, so the Gramian of the features that complement f learns is ``A.T @ (total - own) @ A`` with a matrix A
   of f's statistics.  Elimination and least squares solve on it, and the squared error on fold f itself
   is a quadratic form of f's own Gramian: no row is read again to be scored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import quoted, x_of
from staylens.functions.stats import exact_quantiles
from staylens.operators.features import eliminate, gramian_of
from staylens.session import materialize

ALL = -1


class Learned:
    """What one training set (all rows, or all but one fold) gives: preprocessing statistics, features, coefficients."""

    medians: list[float | None]
    scales: list[tuple[float, float]]
    modes: list[str | None]
    levels: list[list[str]]
    features: list[str]
    chosen: list[str]
    intercept: float
    coefficients: list[float]


def least_squares(g: np.ndarray, at: Sequence[int]) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the features ``at`` from the Gramian of [1, features, y]; collinear features
    share their weight (minimum norm of the standardised system)."""
    n, idx = g[0, 0], [i + 1 for i in at]
    mean = g[0, idx] / n
    var = np.diag(g)[idx] / n - mean**2
    sd = np.sqrt(np.where(var > 1e-14 * np.maximum(1.0, mean**2), var, 1.0))
    m = np.zeros((g.shape[0], len(idx) + 2))
    m[0, 0] = m[-1, -1] = 1.0
    for j, (i, a, s) in enumerate(zip(idx, mean, sd)):
        m[i, j + 1], m[0, j + 1] = 1 / s, -a / s
    z = m.T @ g @ m / n
    w = np.linalg.pinv(z[:-1, :-1], rcond=1e-10, hermitian=True) @ z[:-1, -1]
    return float(w[0] - (w[1:] * mean / sd).sum()), w[1:] / sd


class FoldComplements:
    """The two passes over ``df``; ``learn`` then answers for any training set without touching a row."""

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str | None = None):
        self.numeric, self.categorical, self.label = list(numeric), list(categorical), label
        key = F.col(quoted(fold)) if fold else F.lit(0)
        kinds = dict(df.dtypes)
        texts = [F.when(~F.isnan(F.col(quoted(c))), F.col(quoted(c))).cast("string") if kinds[c] in ("double", "float")
                 else F.col(quoted(c)).cast("string") for c in self.categorical]
        self.rows = (df.where(x_of(label).isNotNull() & key.isNotNull())
                     .select(key.alias("fold"), x_of(label).alias("y"), *[x_of(c).alias(f"x{i}") for i, c in enumerate(self.numeric)],
                             *[t.alias(f"c{i}") for i, t in enumerate(texts)]))
        #: Categorical columns of numbers: ties of the mode go to the smallest number, not text.
        self.ranked = [float if kinds[c] not in ("string", "boolean", "date", "timestamp") else str for c in self.categorical]
        self._count()
        self._multiply()

    def _count(self) -> None:
        numbers = [F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("num"), F.lit(None).cast("string").alias("text"))
                   for i in range(len(self.numeric))]
        words = [F.struct(F.lit(len(self.numeric) + i).alias("i"), F.lit(None).cast("double").alias("num"), F.col(f"c{i}").alias("text"))
                 for i in range(len(self.categorical))]
        label = F.struct(F.lit(ALL).alias("i"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("text"))
        counted = materialize(self.rows.select("fold", F.inline(F.array(label, *numbers, *words)))
                              .groupBy("i", "num", "text", "fold").agg(F.count(F.lit(1)).alias("n")), cache=False)
        # One row per fold, one per level and fold.
        self.folds = sorted(r[0] for r in counted.where(F.col("i") == ALL).select("fold").collect())
        self.counts: list[dict] = [{} for _ in self.categorical]
        for r in counted.where((F.col("i") >= len(self.numeric)) & F.col("text").isNotNull()).collect():
            self.counts[r["i"] - len(self.numeric)].setdefault(r["text"], {})[r["fold"]] = r["n"]
        # Weights of each number in all rows and outside each fold.
        own = [F.coalesce(F.sum(F.when(F.col("fold") == F.lit(f), F.col("n"))), F.lit(0)) for f in self.folds]
        total = F.sum("n")
        sets = F.array(F.struct(F.lit(ALL).alias("f"), total.alias("w")),
                       *[F.struct(F.lit(k).alias("f"), (total - x).alias("w")) for k, x in enumerate(own)])
        weights = (counted.where((F.col("i") >= 0) & F.col("num").isNotNull()).groupBy("i", "num").agg(sets.alias("sets"))
                   .select("i", "num", F.inline("sets")).where("w > 0"))
        self.medians = {}
        if self.numeric:
            for r in exact_quantiles(weights, "num", {"m": 0.5}, by=["i", "f"], weight="w").collect():
                self.medians[r["i"], r["f"]] = r["m"]

    def _multiply(self) -> None:
        self.all_levels = [sorted(c) for c in self.counts]
        self.centre = [self.medians.get((i, ALL), 0.0) for i in range(len(self.numeric))]
        first = self.rows.agg(F.avg("y").alias("y")).first()
        self.y0 = first["y"] or 0.0
        x = [F.col(f"x{i}") for i in range(len(self.numeric))]
        columns = [F.coalesce(c - F.lit(m), F.lit(0.0)) for c, m in zip(x, self.centre)]
        columns += [c.isNull().cast("double") for c in x]
        for i, levels in enumerate(self.all_levels):
            c = F.col(f"c{i}")
            columns += [F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)) for v in levels] + [c.isNull().cast("double")]
        layout = self.rows.select(F.col("fold").alias("key"), F.array(*columns, F.col("y") - F.lit(self.y0)).alias("x"))
        size = len(columns) + 2
        self.own = {f: np.zeros((size, size)) for f in self.folds}
        for r in gramian_of(layout, size).collect():
            self.own[r["key"]][r["i"]] = r["cells"]
        self.total = sum(self.own.values(), np.zeros((size, size)))

    def _matrix(self, k: int, g: np.ndarray) -> tuple[np.ndarray, Learned]:
        """The linear map from the raw layout to the features that the training set ``k`` with Gramian ``g`` learns."""
        out, d, n = Learned(), len(self.numeric), g[0, 0]
        out.medians = [self.medians.get((i, k)) for i in range(d)]
        out.scales, out.features, columns = [], list(self.numeric), []
        for i in range(d):
            m, c = out.medians[i], self.centre[i]
            shift = 0.0 if m is None else m - c
            x, missing = g[0, 1 + i], g[0, 1 + d + i]
            mean = (x + shift * missing) / n
            var = (g[1 + i, 1 + i] + shift**2 * missing) / n - mean**2
            sd = float(np.sqrt(var)) if var > 1e-15 * max(1.0, mean**2) else 0.0
            div = sd or 1.0
            out.scales.append((mean + c, sd))
            columns.append({0: -mean / div, 1 + i: 1 / div, 1 + d + i: shift / div})
        out.modes, out.levels = [], []
        at = 1 + 2 * d
        for i, levels in enumerate(self.all_levels):
            left = {v: sum(n for f, n in by.items() if k == ALL or f != self.folds[k]) for v, by in self.counts[i].items()}
            left = {v: n for v, n in left.items() if n}
            kind = self.ranked[i]
            mode = min(left, key=lambda v: (-left[v], kind(v)), default=None)
            seen = sorted(left, key=kind)
            out.modes.append(mode)
            out.levels.append(seen)
            for v in seen:
                column = {at + levels.index(v): 1.0}
                if v == mode:
                    column[at + len(levels)] = 1.0
                columns.append(column)
                out.features.append(f"{self.categorical[i]}_{v}")
            at += len(levels) + 1
        a = np.zeros((len(g), len(columns) + 2))
        a[0, 0] = a[-1, -1] = 1.0
        for j, column in enumerate(columns):
            for row, value in column.items():
                a[row, j + 1] = value
        return a, out

    def learn(self, n: int = 5, without: int | None = None) -> tuple[Learned, np.ndarray]:
        """The pipeline (impute, scale, encode, eliminate to ``n`` features, least squares) on all rows or without the
        fold of that place in ``folds``, and its map of the raw layout."""
        k = ALL if without is None else without
        g = self.total if without is None else self.total - self.own[self.folds[without]]
        a, out = self._matrix(k, g)
        # The label as it is, not less its mean: collinear levels share their weight with the intercept.
        whole = a.copy()
        whole[0, -1] = self.y0
        h = whole.T @ g @ whole
        ranked = eliminate(h, out.features, n)
        at = [i for i, (_, _, keep) in enumerate(ranked) if keep]
        out.chosen = [out.features[i] for i in at]
        out.intercept, weights = least_squares(h, at)
        out.coefficients = [float(w) for w in weights]
        self._at = at
        return out, a

    def fold_score(self, place: int, n: int = 5) -> tuple:
        """(fold, r2, rows, chosen features) of the fold's rows under the pipeline learned without them."""
        out, a = self.learn(n, place)
        own = a.T @ self.own[self.folds[place]] @ a
        r = np.zeros(len(own))
        r[0], r[-1] = self.y0 - out.intercept, 1.0
        for i, w in zip(self._at, out.coefficients):
            r[i + 1] = -w
        rows, sse = own[0, 0], float(r @ own @ r)
        sst = own[-1, -1] - own[0, -1] ** 2 / rows
        return self.folds[place], float(1 - sse / sst) if sst > 1e-12 * own[-1, -1] else None, int(round(rows)), out.chosen


def pipeline_cv(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str = "fold",
                n: int = 5) -> DataFrame:
    """D3: (fold, r2, n, features) of the linear pipeline, every statistic of it learned without the fold.

    Rows without label or fold take no part; a fold whose label is constant has no r2."""
    stats = FoldComplements(df, numeric, categorical, label, fold)
    rows = [stats.fold_score(k, n) for k in range(len(stats.folds))] if len(stats.folds) > 1 else []
    return df.sparkSession.createDataFrame([(int(f), r2, m, chosen) for f, r2, m, chosen in rows],
                                           "fold int, r2 double, n long, features array<string>")

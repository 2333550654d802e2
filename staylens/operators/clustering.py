"""Clustering operators and cluster-quality indices.

Centroids and per-cluster sums are model statistics of size k x d: they are
inlined into the expressions as literals, so assigning labels and every index
is one map-side pass with a small final aggregate -- no join, no all-pairs.

Silhouette: the exact Euclidean silhouette needs every pair of rows.  We
compute the silhouette with *squared* Euclidean dissimilarity exactly in
O(n * k), from per-cluster counts, sums and sums of squares (the definition
Spark's ClusteringEvaluator uses); ``silhouette_pairs`` is the quadratic
reference used only by tests on small fixtures.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import quoted, x_of
from staylens.operators.features import assemble_features
from staylens.operators.lloyd import KMeansFit, fit_indices, kmeans_fits, weighted_points
from staylens.session import by_size

#: Up to so many centroid cells, distances are written out as arithmetic (whole-stage code);
#: beyond, the same formulas run over array literals, so that plans stay small for any k.
WRITTEN_OUT_CELLS = 256


def _x(c: str) -> Column:
    """A feature of complete rows (``_complete`` checks for NULL and NaN, once per row)."""
    return F.col(quoted(c)).cast("double")


def _complete(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """The rows with a value in every feature and, if given, a label: the ones indices are about."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & x_of(c).isNotNull()
    if label is not None:
        cond = cond & F.col(quoted(label)).isNotNull()
    return df.where(cond)


def _point(cols: Sequence[str]) -> Column:
    return F.array(*[_x(c) for c in cols])


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _array_sqdist(point: Column, center: Column) -> Column:
    squares = F.zip_with(point, center, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda t, v: t + v)


def _sqdist(cols: Sequence[str], center: Sequence[float]) -> Column:
    e = None
    for c, v in zip(cols, center):
        diff = _x(c) - F.lit(float(v))
        e = diff * diff if e is None else e + diff * diff
    return e


def _sq(e: Column) -> Column:
    return e * e


def assign_clusters(df: DataFrame, cols: Sequence[str], centroids: Sequence[Sequence[float]],
                    out: str = "cluster") -> DataFrame:
    """Nearest centroid (squared Euclidean), ties to the lowest id; NULL if a feature is NULL or NaN."""
    known = reduce(lambda a, b: a & b, [x_of(c).isNotNull() for c in cols], F.lit(True))
    if len(centroids) * len(cols) > WRITTEN_OUT_CELLS:
        d = F.transform(F.array(*[_literal(c) for c in centroids]), lambda c: _array_sqdist(_point(cols), c))
        label = F.array_position(d, F.array_min(d)) - 1
        return df.withColumn(out, F.when(known, label.cast("int")))
    d = [_sqdist(cols, c) for c in centroids]
    dcols = [f"_d{j}" for j in range(len(d))]
    tmp = df.withColumns({n: e for n, e in zip(dcols, d)})
    m = F.least(*[F.col(n) for n in dcols]) if len(dcols) > 1 else F.col(dcols[0])
    label = None
    for j in reversed(range(len(dcols))):
        label = F.lit(j) if label is None else F.when(F.col(dcols[j]) == m, F.lit(j)).otherwise(label)
    return tmp.withColumn(out, F.when(known, label.cast("int"))).drop(*dcols)


def cluster_stats(df: DataFrame, cols: Sequence[str], label: str, shift: Sequence[float] | None = None) -> DataFrame:
    """Per-cluster n, sums and sums of squares of the complete rows, less ``shift``: one partially aggregated groupBy."""
    aggs = [F.count(F.lit(1)).alias("n")]
    sq = None
    for i, c in enumerate(cols):
        x = _x(c) - F.lit(float(shift[i])) if shift is not None else _x(c)
        aggs.append(F.sum(x).alias(f"s{i}"))
        sq = x * x if sq is None else sq + x * x
    aggs.append(F.sum(sq).alias("q"))
    return _complete(df, cols, label).groupBy(quoted(label)).agg(*aggs)


def _collect_stats(df: DataFrame, cols: Sequence[str], label: str, shift: Sequence[float] | None = None):
    """The per-cluster statistics: one row for each of the k clusters, a model's size."""
    rows = cluster_stats(df, cols, label, shift).orderBy(quoted(label)).collect()
    labels = [r[label] for r in rows]
    n = np.array([r["n"] for r in rows], dtype=float)
    s = np.array([[r[f"s{i}"] for i in range(len(cols))] for r in rows], dtype=float).reshape(len(rows), len(cols))
    q = np.array([r["q"] for r in rows], dtype=float)
    return labels, n, s, q


def _centered(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(label, features less their grand means) of the complete rows.

    Sums of squares and products then stay as small as the spread of the data, so that the
    closed forms below don't cancel when the points lie far from the origin."""
    rows = _complete(df, cols, label)
    means = rows.agg(*[F.avg(_x(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return rows.select(F.col(quoted(label)), *[(_x(c) - F.lit(means[i] or 0.0)).alias(c) for i, c in enumerate(cols)])


def _by_label(label: str, labels: Sequence, values: Sequence[float]) -> Column:
    if len(labels) > WRITTEN_OUT_CELLS:
        table = F.create_map(*[F.lit(x) for l, v in zip(labels, values) for x in (l, float(v))])
        return F.element_at(table, F.col(quoted(label)))
    e = None
    for l, v in zip(labels, values):
        cond = F.col(quoted(label)) == F.lit(l)
        e = F.when(cond, F.lit(float(v))) if e is None else e.when(cond, F.lit(float(v)))
    return e if e is not None else F.lit(None).cast("double")


def centroids(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Per-cluster mean of every column and size, over the complete rows."""
    return _complete(df, cols, label).groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n"), *[F.avg(_x(c)).alias(c) for c in cols])


def lloyd_step(df: DataFrame, cols: Sequence[str], centers: Sequence[Sequence[float]],
               label: str = "cluster") -> DataFrame:
    """Assign to the given centres, then the new centres (mean per label) and sizes."""
    return centroids(assign_clusters(df, cols, centers, label), cols, label)


def inertia(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """within-cluster sum of squared distances to the cluster mean, over complete labelled rows."""
    df = _complete(df, cols, label)
    labels, n, s, _ = _collect_stats(df, cols, label)
    cent = s / n[:, None]
    dist = None
    for i, c in enumerate(cols):
        t = _sq(_x(c) - _by_label(label, labels, cent[:, i]))
        dist = t if dist is None else dist + t
    return df.agg(F.sum(dist).alias("inertia"))


SILHOUETTE_METHOD = "squared_euclidean"


def silhouette(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """mean silhouette with squared Euclidean dissimilarity, exact, O(n * k).

    For x in cluster A: a = sum_{y in A} |x-y|^2 / (n_A - 1); b = min over B != A of
    sum_{y in B} |x-y|^2 / n_B; s = (b - a) / max(a, b), 0 for singleton clusters.
    sum_{y in C} |x-y|^2 = n_C |x|^2 - 2 x.S_C + Q_C uses per-cluster statistics only, of
    centred points.  ``method`` says which dissimilarity it is.
    """
    df = _centered(df, cols, label)
    labels, n, s, q = _collect_stats(df, cols, label)
    if len(labels) < 2:
        return df.sparkSession.createDataFrame([(None, SILHOUETTE_METHOD)], "silhouette double, method string")
    term = _silhouette_term(cols, label, labels, n, s, q)
    return df.agg(F.avg(term).alias("silhouette")).withColumn("method", F.lit(SILHOUETTE_METHOD))


def silhouette_pairs(points: np.ndarray, labels: np.ndarray, squared: bool = True) -> float:
    """Quadratic reference silhouette for small test fixtures only."""
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    if not squared:
        d = np.sqrt(d)
    out = []
    for i in range(len(points)):
        same = labels == labels[i]
        if same.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == l].mean() for l in np.unique(labels) if l != labels[i])
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def davies_bouldin(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """mean over clusters of max_j (S_i + S_j) / |c_i - c_j|, S = mean distance to centroid."""
    df = _complete(df, cols, label)
    labels, n, s, _ = _collect_stats(df, cols, label)
    cent = s / n[:, None]
    dist = None
    for i, c in enumerate(cols):
        t = _sq(_x(c) - _by_label(label, labels, cent[:, i]))
        dist = t if dist is None else dist + t
    spread = df.groupBy(quoted(label)).agg(F.avg(F.sqrt(dist)).alias("S")).orderBy(label).collect()
    sv = {r[label]: r["S"] for r in spread}
    k = len(labels)
    worst = []
    for a in range(k):
        best = 0.0
        for b in range(k):
            if a == b:
                continue
            m = float(np.sqrt(((cent[a] - cent[b]) ** 2).sum()))
            r = np.inf if m == 0 else (sv[labels[a]] + sv[labels[b]]) / m
            best = max(best, r)
        worst.append(best)
    val = float(np.mean(worst)) if k > 1 else None
    return df.sparkSession.createDataFrame([(val,)], "davies_bouldin double")


def calinski_harabasz(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """F8: (B / (k - 1)) / (W / (n - k)) over the complete labelled rows."""
    df = _complete(df, cols, label)
    labels, n, s, _ = _collect_stats(df, cols, label)
    cent = s / n[:, None]
    grand = s.sum(0) / n.sum()
    between = float((n * ((cent - grand) ** 2).sum(1)).sum())
    w = inertia(df, cols, label).first()["inertia"]
    k, total = len(labels), n.sum()
    val = None if k < 2 or w == 0 else float((between / (k - 1)) / (w / (total - k)))
    return df.sparkSession.createDataFrame([(val,)], "calinski_harabasz double")


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """rows per cluster."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def cluster_indices(df: DataFrame, cols: Sequence[str], label: str) -> dict:
    """F5-F8 together in two passes: per-cluster statistics, then one grouped aggregate of
    the squared distance to the own centroid, its square root and the silhouette term.
    Rows without a label or with a missing feature take no part."""
    df = _centered(df, cols, label)
    labels, n, s, q = _collect_stats(df, cols, label)
    k = len(labels)
    cent = s / n[:, None]
    d2 = None
    for i, c in enumerate(cols):
        t = _sq(_x(c) - _by_label(label, labels, cent[:, i]))
        d2 = t if d2 is None else d2 + t
    aggs = [F.sum("_d2").alias("w"), F.avg(F.sqrt("_d2")).alias("S")]
    if not labels:
        return {"inertia": None, "silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
    frame = df.select(F.col(quoted(label)), d2.alias("_d2"), *[_x(c).alias(c) for c in cols])
    if k >= 2:
        frame = frame.withColumn("_sil", _silhouette_term(cols, label, labels, n, s, q))
        aggs.append(F.sum("_sil").alias("sil"))
    rows = {r[label]: r for r in frame.groupBy(quoted(label)).agg(*aggs).collect()}
    w = float(sum(rows[l]["w"] for l in labels))
    out = {"inertia": w, "silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
    if k < 2:
        return out
    out["silhouette"] = float(sum(rows[l]["sil"] for l in labels) / n.sum())
    sv = np.array([rows[l]["S"] for l in labels])
    worst = []
    for a in range(k):
        m = np.sqrt(((cent[a] - np.delete(cent, a, 0)) ** 2).sum(1))
        sa = sv[a] + np.delete(sv, a)
        worst.append(float(np.max(np.where(m == 0, np.inf, sa / np.where(m == 0, 1, m)))))
    out["davies_bouldin"] = float(np.mean(worst))
    grand = s.sum(0) / n.sum()
    between = float((n * ((cent - grand) ** 2).sum(1)).sum())
    out["calinski_harabasz"] = None if w == 0 else float((between / (k - 1)) / (w / (n.sum() - k)))
    return out


def _silhouette_term(cols, label, labels, n, s, q) -> Column:
    """Per-row squared-Euclidean silhouette from per-cluster statistics (see ``silhouette``)."""
    xx = None
    for c in cols:
        t = _x(c) * _x(c)
        xx = t if xx is None else xx + t
    if len(labels) * len(cols) > WRITTEN_OUT_CELLS:
        table = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(float(n[j])).alias("n"), _literal(s[j]).alias("s"),
                                   F.lit(float(q[j])).alias("q")) for j, l in enumerate(labels)])
        point, mine = _point(cols), F.col(quoted(label))

        def total(c):
            dot = F.aggregate(F.zip_with(point, c["s"], lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
            return c["n"] * xx - F.lit(2.0) * dot + c["q"]

        own = F.transform(F.filter(table, lambda c: c["l"] == mine),
                          lambda c: total(c) / F.greatest(c["n"] - 1, F.lit(1.0)))[0]
        b = F.array_min(F.transform(F.filter(table, lambda c: c["l"] != mine), lambda c: total(c) / c["n"]))
    else:
        tot = []
        for j in range(len(labels)):
            dot = None
            for i, c in enumerate(cols):
                t = _x(c) * F.lit(float(s[j, i]))
                dot = t if dot is None else dot + t
            tot.append(F.lit(float(n[j])) * xx - F.lit(2.0) * dot + F.lit(float(q[j])))
        own = None
        for j, l in enumerate(labels):
            cond = F.col(quoted(label)) == F.lit(l)
            a = tot[j] / F.lit(max(n[j] - 1.0, 1.0))
            own = F.when(cond, a) if own is None else own.when(cond, a)
        # least() passes over NULL; a single branch needs no least().
        others = [F.when(F.col(quoted(label)) != F.lit(l), tot[j] / F.lit(float(n[j]))) for j, l in enumerate(labels)]
        b = F.least(*others)
    size = _by_label(label, labels, n)
    a_col, b_col = F.greatest(own, F.lit(0.0)), F.greatest(b, F.lit(0.0))
    return F.when(size <= 1, F.lit(0.0)).otherwise(
        F.when(F.greatest(a_col, b_col) == 0, F.lit(0.0)).otherwise((b_col - a_col) / F.greatest(a_col, b_col)))


# ----------------------------------------------------------------------------- fits


def kmeans_restart(df: DataFrame, cols: Sequence[str], k: int, n_init: int = 10, seed: int = 42,
                   max_iter: int = 300, tol: float = 1e-4) -> KMeansFit:
    """n_init k-means fits with seeds seed..seed+n_init-1; the lowest inertia wins, ties to the smaller seed.

    All fits advance together, one pass over the distinct points per iteration (see ``lloyd``).
    """
    return min(kmeans_fits(df, cols, [k], n_init, seed, max_iter, tol)[k], key=lambda f: f.cost)


def kmeans_spark(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42) -> KMeansModel:
    """MLlib k-means|| with defaults on the given (imputed, unscaled) columns."""
    # MLlib keeps a block of vectors and norms per partition.
    rows = by_size(_complete(df, cols).select(*[F.col(quoted(c)) for c in cols]), 120 + 8 * len(cols))
    vec = assemble_features(rows, cols, "_km_features")
    return KMeans(k=k, seed=seed, featuresCol="_km_features").fit(vec)


def model_centroids(model: KMeansModel | KMeansFit) -> list[list[float]]:
    return [list(map(float, c)) for c in model.clusterCenters()]


def k_sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 11), n_init: int = 10,
            seed: int = 42, max_iter: int = 300, tol: float = 1e-4, parallelism: int | None = None) -> DataFrame:
    """best-restart fit per k and its four indices, one row per k."""
    return k_sweep_models(df, cols, ks, n_init, seed, max_iter, tol, parallelism)[0]


def k_sweep_models(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 11), n_init: int = 10,
                   seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
                   parallelism: int | None = None) -> tuple[DataFrame, dict[int, KMeansFit]]:
    """The frame of ``k_sweep`` and the best fit of each k.

    All len(ks) x n_init fits advance together (see ``lloyd``), and the indices of all ks come from two passes; both
    read the distinct weighted points, to which the rows are collapsed once.  ``parallelism`` is without effect:
    no pass is for one k alone.
    """
    spark = df.sparkSession
    points = weighted_points(df, cols)
    try:
        fits = kmeans_fits(df, cols, list(ks), n_init, seed, max_iter, tol, points)
        best = {k: min(found, key=lambda f: f.cost) for k, found in fits.items()}
        results = dict(zip(ks, fit_indices(points, [best[k].centers for k in ks])))
    finally:
        points.unpersist()
    rows = [(int(k), results[k]["inertia"], results[k]["silhouette"], results[k]["davies_bouldin"],
             results[k]["calinski_harabasz"]) for k in ks]
    frame = spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, "
                                        "calinski_harabasz double")
    return frame, best


def best_k(sweep: DataFrame) -> DataFrame:
    """k by max silhouette (used), min Davies-Bouldin and max Calinski-Harabasz (reported)."""
    return sweep.agg(
        F.max_by("k", F.struct("silhouette", (-F.col("k")).alias("t"))).alias("best_k_silhouette"),
        F.min_by("k", F.struct("davies_bouldin", "k")).alias("best_k_davies_bouldin"),
        F.max_by("k", F.struct("calinski_harabasz", (-F.col("k")).alias("t"))).alias("best_k_calinski_harabasz"),
    ).withColumn("silhouette_method", F.lit(SILHOUETTE_METHOD))

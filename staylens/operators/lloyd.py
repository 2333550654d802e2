"""K-means for many fits at a time: seeding and Lloyd's iterations over distinct weighted points.

Rows are first collapsed to distinct points with their numbers of rows (one partially aggregated
groupBy, checkpointed to the shared folder), so a point that holds a third of the table is one row.  Every
pass then serves all fits of all k and restarts: tasks multiply their points with the centroids of
every fit that still moves and give back sums per centroid, which Spark adds up.  The number of
passes is that of the slowest fit, whatever the number of fits; what reaches the driver is of model size.

Seeding is k-means++ by Gumbel keys: the point with the largest ln(weight x squared distance) plus a
Gumbel number from a hash of the point is a draw in proportion to weight x squared distance, and a
maximum needs no second pass.  A chain of draws serves every k: its first k points seed k clusters.

The hash and the points alone decide the draws, so results don't depend on the partitioning, up to
the order in which sums are rounded.  Fewer distinct points than k give as many clusters as points;
a cluster that loses its points stays where it is; a frame without complete rows raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import x_of
from staylens.session import materialize, ship_package

#: Points whose distances to all centroids are held at a time.
BLOCK = 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class KMeansFit:
    """The centroids of one fit, the sum of squared distances to them, and the passes it took."""
    centers: np.ndarray
    cost: float
    iterations: int

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)


def weighted_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(point, w): the distinct complete points with their numbers of rows, stored and cached; partitions by size."""
    values = [x_of(c) for c in cols]
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    points = df.where(known).select(F.array(*values).alias("point")).groupBy("point").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return materialize(points, narrow=False)


def blocks(batches: Iterable[pa.RecordBatch], shift: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, points less ``shift``, weights) of at most ``BLOCK`` rows each."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            b = batch.slice(low, BLOCK)
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(shift))
            yield x, x - shift, b.column(1).to_numpy(zero_copy_only=False)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def point_hashes(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)  # adding zero makes both zeros one
    h = np.zeros(len(x), np.uint64)
    for j in range(bits.shape[1]):
        h = _mixed((h ^ bits[:, j]) * MULTIPLIER + np.uint64(j + 1))
    return h


def gumbel(hashes: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A Gumbel number for every hash, other ones for every seed and step."""
    salt = np.uint64(((seed * 1_000_003 + step + 1) * int(MULTIPLIER)) % (1 << 64))
    u = ((_mixed(_mixed(hashes ^ salt)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    return -np.log(-np.log(u))


def seed_chains(points: DataFrame, shift: np.ndarray, seeds: Sequence[int], k: int) -> list[np.ndarray]:
    """For each seed up to ``k`` points drawn by k-means++ (less ``shift``), from k passes for all seeds."""
    chains = [np.zeros((0, len(shift))) for _ in seeds]
    for step in range(k):
        growing = [i for i, c in enumerate(chains) if len(c) == step]

        def run(batches):
            best: dict[int, tuple[float, list[float]]] = {}
            for plain, x, w in blocks(batches, shift):
                h = point_hashes(plain)  # the shift is a rounded sum, so its last digits are not the same on any partitioning
                for i in growing:
                    near = np.ones(len(x))
                    for n, c in enumerate(chains[i]):
                        apart = ((x - c) ** 2).sum(axis=1)
                        near = apart if n == 0 else np.minimum(near, apart)
                    with np.errstate(divide="ignore"):
                        keys = np.log(w * near) + gumbel(h, seeds[i], step)
                    at = int(np.argmax(keys))
                    if np.isfinite(keys[at]) and (i not in best or keys[at] > best[i][0]):
                        best[i] = (float(keys[at]), x[at].tolist())
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.float64()),
                     pa.array([v[1] for v in best.values()], pa.list_(pa.float64()))], ["chain", "key", "point"])

        drawn = points.mapInArrow(run, "chain int, key double, point array<double>")
        rows = drawn.groupBy("chain").agg(F.max(F.struct("key", "point")).alias("top")).collect()
        if not rows:
            break
        for r in rows:
            chains[r.chain] = np.vstack([chains[r.chain], r.top.point])
    return chains


def lloyd_pass(points: DataFrame, shift: np.ndarray, centers: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows per centroid, their sums, cost) of every fit's centroids, from one pass for all fits."""
    stacked = np.vstack(centers)
    ends = np.cumsum([len(c) for c in centers])
    starts, d = ends - [len(c) for c in centers], len(shift)

    def run(batches):
        total = np.zeros((len(stacked), d + 2))
        half = (stacked ** 2).sum(axis=1) / 2
        for _, x, w in blocks(batches, shift):
            lean = half - x @ stacked.T  # half the squared distance, less half the point's own square
            own, wx = (x ** 2).sum(axis=1), x * w[:, None]
            for low, high in zip(starts, ends):
                label = np.argmin(lean[:, low:high], axis=1)
                cost = np.maximum(own + 2 * lean[np.arange(len(x)), low + label], 0.0) * w
                for j, v in enumerate([w, cost, *wx.T]):
                    total[low:high, j] += np.bincount(label, v, high - low)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(stacked)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         ["centroid", "cells"])

    table = summed(points, run, len(stacked), d + 2)
    return [(table[a:b, 0], table[a:b, 2:], float(table[a:b, 1].sum())) for a, b in zip(starts, ends)]


def summed(points: DataFrame, run, rows: int, width: int) -> np.ndarray:
    """The (centroid, cells) rows that ``run`` gives per task, added up by Spark."""
    parts = points.mapInArrow(run, "centroid int, cells array<double>")
    cells = (parts.select("centroid", F.posexplode("cells").alias("j", "v")).groupBy("centroid", "j").agg(F.sum("v").alias("v"))
             .groupBy("centroid").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cells")))
    table = np.zeros((rows, width))
    for r in cells.collect():
        table[r.centroid] = [c.v for c in r.cells]
    return table


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, ties to the first; distances are added up as ``assign_clusters`` does."""
    apart = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        apart += (x[:, j, None] - centers[None, :, j]) ** 2
    return np.argmin(apart, axis=1)


def fit_indices(points: DataFrame, centers: Sequence[np.ndarray]) -> list[dict]:
    """Inertia, silhouette (squared Euclidean), Davies-Bouldin and Calinski-Harabasz of every fit's labelling, from two
    passes over the weighted points for all fits: sums per cluster, then distances to the means and silhouette
    terms (the formulas of ``clustering.cluster_indices``, points counted by weight)."""
    d = centers[0].shape[1]
    ends = np.cumsum([len(c) for c in centers])
    starts, size = ends - [len(c) for c in centers], int(ends[-1])
    means = points.agg(*[(F.sum(F.col("point")[i] * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(d)]).first()
    shift = np.array([means[f"m{i}"] for i in range(d)])

    def rows_of(total):
        return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                          ["centroid", "cells"])

    def sums(batches):
        total = np.zeros((size, d + 2))
        for plain, x, w in blocks(batches, shift):
            cells = [w, (x ** 2).sum(axis=1) * w, *(x * w[:, None]).T]
            for low, high, c in zip(starts, ends, centers):
                label = nearest(plain, c)
                for j, v in enumerate(cells):
                    total[low:high, j] += np.bincount(label, v, high - low)
        yield rows_of(total)

    table = summed(points, sums, size, d + 2)
    n, q, s = table[:, 0], table[:, 1], table[:, 2:]
    mean = s / np.maximum(n, 1)[:, None]

    def spreads(batches):
        total = np.zeros((size, 3))
        for plain, x, w in blocks(batches, shift):
            own, at = (x ** 2).sum(axis=1), np.arange(len(x))
            for low, high, c in zip(starts, ends, centers):
                label = nearest(plain, c)
                apart = ((x - mean[low:high][label]) ** 2).sum(axis=1)
                to = n[low:high] * own[:, None] - 2.0 * (x @ s[low:high].T) + q[low:high]
                mine = n[low:high][label]
                a = np.maximum(to[at, label] / np.maximum(mine - 1, 1), 0.0)
                other = np.where(n[low:high] > 0, to / np.maximum(n[low:high], 1), np.inf)
                other[at, label] = np.inf
                b = np.maximum(other.min(axis=1), 0.0)
                top = np.maximum(a, b)
                sil = np.zeros(len(x))
                np.divide(b - a, top, out=sil, where=(mine > 1) & (top > 0) & np.isfinite(b))
                for j, v in enumerate([apart * w, np.sqrt(apart) * w, sil * w]):
                    total[low:high, j] += np.bincount(label, v, high - low)
        yield rows_of(total)

    spread = summed(points, spreads, size, 3)
    out = []
    for low, high in zip(starts, ends):
        used = np.arange(low, high)[n[low:high] > 0]  # a centroid without points is no cluster
        k, rows, within = len(used), n[used].sum(), float(spread[used, 0].sum())
        found = {"inertia": within, "silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
        if k > 1:
            cent, radius = mean[used], spread[used, 1] / n[used]
            found["silhouette"] = float(spread[used, 2].sum() / rows)
            worst = []
            for a in range(k):
                m = np.sqrt(((cent[a] - np.delete(cent, a, 0)) ** 2).sum(1))
                worst.append(float(np.max(np.where(m == 0, np.inf, (radius[a] + np.delete(radius, a)) / np.where(m == 0, 1, m)))))
            found["davies_bouldin"] = float(np.mean(worst))
            between = float((n[used] * ((cent - s[used].sum(0) / rows) ** 2).sum(1)).sum())
            found["calinski_harabasz"] = None if within == 0 else float((between / (k - 1)) / (within / (rows - k)))
        out.append(found)
    return out


def kmeans_fits(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int = 10, seed: int = 42,
                max_iter: int = 300, tol: float = 1e-4, points: DataFrame | None = None) -> dict[int, list[KMeansFit]]:
    """The ``n_init`` fits of every k, with seeds seed..seed+n_init-1.

    A fit has converged when no centroid moves by more than ``tol``; it then leaves the passes.  ``points``: the
    ``weighted_points`` of ``df``, if the caller has them (and releases them)."""
    ship_package(df.sparkSession)
    given = points is not None
    points = points if given else weighted_points(df, cols)
    try:
        means = points.agg(F.count(F.lit(1)).alias("n"), *[(F.sum(F.col("point")[i] * F.col("w")) / F.sum("w")).alias(f"m{i}")
                                                         for i in range(len(cols))]).first()
        if not means["n"]:
            raise ValueError("no complete rows to cluster")
        # Less their means, points far from the origin lose no digits in the products.
        shift = np.array([means[f"m{i}"] for i in range(len(cols))])
        chains = seed_chains(points, shift, [seed + i for i in range(n_init)], max(ks))
        fits = [(k, i) for k in ks for i in range(n_init)]
        centers = {f: chains[f[1]][:f[0]] for f in fits}
        passes = dict.fromkeys(fits, 0)
        moving, still = fits, set(fits)
        while moving:
            for f, (n, sums, _) in zip(moving, lloyd_pass(points, shift, [centers[f] for f in moving])):
                moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers[f])
                far = ((moved - centers[f]) ** 2).sum(axis=1).max()
                centers[f], passes[f] = moved, passes[f] + 1
                if far <= tol ** 2 or passes[f] >= max_iter:
                    still.discard(f)
            moving = [f for f in moving if f in still]
        costs = lloyd_pass(points, shift, [centers[f] for f in fits])
        out: dict[int, list[KMeansFit]] = {k: [] for k in ks}
        for f, (_, _, cost) in zip(fits, costs):
            out[f[0]].append(KMeansFit(centers[f] + shift, cost, passes[f]))
        return out
    finally:
        if not given:
            points.unpersist()

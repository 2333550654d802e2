"""Exact Euclidean silhouette over distinct weighted vectors.

A silhouette of plain distances needs, for each point, its mean distance to its own cluster and to the
nearest other one.  Rows with equal features and label share these, so only *distinct* vectors with
their multiplicities are compared.  Which clusters can be the nearest one is settled by bounds before any
pair is looked at: with m the cluster's mean and r the mean distance of its points to m,

    |x - m|  <=  mean distance from x to the cluster  <=  |x - m| + r

(convexity on the left, the triangle inequality on the right).  A cluster whose lower bound is above the
least upper bound can't be the nearest.  A vector is sent only to its own cluster and the ones that remain.

The vectors of a cluster are dealt into shards of bounded size and so are the vectors that ask; one task
has one shard of each, multiplies them out as a matrix and gives one sum per asking vector.  So no
task holds more than two shards, however large a cluster is.  The work is the number of distinct
vectors times the distinct vectors of the clusters that the bounds leave; for tables of all
different rows that is quadratic, and ``clustering.silhouette`` (squared distances, linear) is the one to use.

Rows with a missing feature or label are left out; a point alone in its cluster scores 0; fewer than two
clusters have no silhouette.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import quoted, x_of
from staylens.session import materialize, ship_package

METHOD = "euclidean"
SHARD_VECTORS = 2048


def distinct_vectors(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(label, x array<double>, w): the distinct complete feature vectors of each cluster and how many rows have them."""
    xs = [x_of(c) for c in cols]
    # -0.0 and 0.0 are one value.
    rows = df.select(F.col(quoted(label)).alias("label"), F.array(*[x + F.lit(0.0) for x in xs]).alias("x"))
    complete = rows.where(F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    return complete.groupBy("label", "x").agg(F.count(F.lit(1)).alias("w"))


def _distance(x: Column, center: Sequence[float]) -> Column:
    terms = [(x[j] - F.lit(float(v))) * (x[j] - F.lit(float(v))) for j, v in enumerate(center)]
    return F.sqrt(reduce(lambda a, b: a + b, terms))


def cluster_bounds(vectors: DataFrame, d: int) -> list[tuple]:
    """(label, rows, distinct vectors, mean, mean distance to it) of each cluster: k rows."""
    sums = vectors.groupBy("label").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"),
                                        *[F.sum(F.col("x")[j] * F.col("w")).alias(f"s{j}") for j in range(d)]).collect()
    stats = {r["label"]: (r["n"], r["m"], [r[f"s{j}"] / r["n"] for j in range(d)]) for r in sums}
    reach = reduce(lambda e, item: e.when(F.col("label") == F.lit(item[0]), _distance(F.col("x"), item[1][2])),
                   list(stats.items())[1:], F.when(F.col("label") == F.lit(next(iter(stats))),
                                                   _distance(F.col("x"), stats[next(iter(stats))][2])))
    radius = {r["label"]: r["r"] for r in vectors.select("label", "w", reach.alias("d")).groupBy("label").agg(
        (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("r")).collect()}
    return [(label, n, m, mean, radius[label]) for label, (n, m, mean) in sorted(stats.items(), key=lambda t: str(t[0]))]


def silhouette_values(df: DataFrame, cols: Sequence[str], label: str, shard: int = SHARD_VECTORS) -> DataFrame | None:
    """(label, x, w, silhouette) of every distinct vector; None for fewer than two clusters."""
    d = len(cols)
    vectors = materialize(distinct_vectors(df, cols, label).withColumn("uid", F.monotonically_increasing_id()), cache=False, narrow=False)
    if vectors.isEmpty():
        return None
    bounds = cluster_bounds(vectors, d)
    if len(bounds) < 2:
        return None
    ship_package(df.sparkSession)

    # The clusters that each vector asks: its own, and those that may be the nearest other one.
    own = [F.col("label") == F.lit(b[0]) for b in bounds]
    low = [_distance(F.col("x"), b[3]) for b in bounds]
    least = F.least(*[F.when(~mine, dist + F.lit(b[4])).otherwise(F.lit(float("inf"))) for mine, dist, b in zip(own, low, bounds)],
                    F.lit(float("inf")))
    slack = 1e-9 * (1 + max(b[4] for b in bounds))
    asked = F.array_compact(F.array(*[F.when(mine | (dist <= F.col("least") + F.lit(slack)), F.lit(c))
                                      for c, (mine, dist) in enumerate(zip(own, low))]))
    place = reduce(lambda e, c: e.when(own[c], F.lit(c)), range(1, len(bounds)), F.when(own[0], F.lit(0)))
    shards = [-(-b[2] // shard) for b in bounds]
    groups = sum(shards)  # shards of the vectors that ask, dealt over all of them
    deal = F.pmod(F.xxhash64("uid"), F.lit(1 << 30))
    asking = (vectors.withColumn("least", least).withColumn("cluster", F.explode(asked))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(s - 1) for s in shards]), F.col("cluster") + 1))))
              .select("cluster", "shard", F.pmod(deal, F.lit(groups)).cast("int").alias("part"), "uid", "x"))
    held = (vectors.withColumn("cluster", place)
            .withColumn("shard", F.pmod(deal, F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("cluster") + 1)).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            .select("cluster", "shard", "part", "x", "w"))

    def distances(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"uid": [], "cluster": [], "total": []})
        x, y, w = np.stack(a["x"]), np.stack(b["x"]), b["w"].to_numpy(float)
        total = np.empty(len(x))
        step = max(1, 4_000_000 // max(1, y.size))
        for i in range(0, len(x), step):
            diff = x[i:i + step, None, :] - y[None, :, :]
            total[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff)) @ w
        return pd.DataFrame({"uid": a["uid"].to_numpy(), "cluster": a["cluster"].to_numpy(), "total": total})

    key = ["cluster", "shard", "part"]
    sums = (asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(distances, "uid long, cluster int, total double")
            .groupBy("uid", "cluster").agg(F.sum("total").alias("total")))
    n = F.element_at(F.array(*[F.lit(int(b[1])) for b in bounds]), F.col("cluster") + 1)
    mine = F.col("cluster") == F.col("place")
    means = (sums.join(vectors.withColumn("place", place), "uid")
             .groupBy("uid", "label", "x", "w").agg(
                 F.max(F.when(mine, n)).alias("n"), F.max(F.when(mine, F.col("total") / F.greatest(n - 1, F.lit(1)))).alias("a"),
                 F.min(F.when(~mine, F.col("total") / n)).alias("b")))
    top = F.greatest("a", "b")
    value = F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(F.lit(0.0))
    return means.select("label", "x", "w", value.alias("silhouette"))


def silhouette_euclidean(df: DataFrame, cols: Sequence[str], label: str, shard: int = SHARD_VECTORS) -> DataFrame:
    """(silhouette, method): the mean over all rows, exact, with plain Euclidean distances."""
    values = silhouette_values(df, cols, label, shard)
    if values is None:
        return df.sparkSession.createDataFrame([(None, METHOD)], "silhouette double, method string")
    return values.agg((F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("silhouette")).withColumn("method", F.lit(METHOD))

"""Exploratory aggregates (G1-G14): the numbers behind the reference's plots.

Bin edges, bandwidths and fences are scalars learned by one small aggregate
and then inlined as literals, so binning is a projection followed by a
partially aggregated ``groupBy``.  Per-group statistics are joined back as
the planner sees fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalar import quoted, x_of
from staylens.functions.stats import exact_quantiles, weighted_values
from staylens.operators.splits import hash_bucket
from staylens.session import ship_package

def _x(c: str) -> Column:
    return F.col(quoted(c)).cast("double")


def attach_group_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group statistics (one row per group) back to the rows, null groups too.

    How is left to the planner: it knows the size of the statistics at run time, broadcasts them
    if they are small and splits skewed partitions if they aren't.
    """
    by = list(by)
    renamed = stats.select(*[F.col(quoted(c)).alias(f"_by{by.index(c)}" if c in by else c) for c in stats.columns])
    same = reduce(lambda a, b: a & b, [F.col(quoted(c)).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    return df.join(renamed, same).drop(*[f"_by{i}" for i in range(len(by))])


def min_max(df: DataFrame, col: str):
    r = df.agg(F.min(_x(col)).alias("lo"), F.max(_x(col)).alias("hi"), F.count(_x(col)).alias("n")).first()
    return r["lo"], r["hi"], r["n"]


def bin_index(col: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1 over [lo, hi]; hi falls into the last bin."""
    w = (hi - lo) / bins if hi > lo else 1.0
    # least() skips NULL, so a missing value must stay NULL explicitly.
    return F.when(col.isNotNull(), F.least(F.lit(bins - 1), F.floor((col - F.lit(lo)) / F.lit(w)))).cast("bigint")


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """G1: counts of ``bins`` equal-width bins over [min, max] (empty bins included)."""
    lo, hi, _ = min_max(df, col)
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, count bigint")
    w = (hi - lo) / bins if hi > lo else 1.0
    counts = df.where(_x(col).isNotNull()).select(bin_index(_x(col), lo, hi, bins).alias("bin")) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    # 'bins' rows by construction: a broadcast of fixed size.
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count"))


def kde_grid(df: DataFrame, col: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (sd_sample * n^(-1/5)) on ``points`` grid points
    spanning [min - cut*h, max + cut*h].

    The values are first collapsed to distinct values with weights; each task then adds up its
    values' kernels on the whole grid, and sends one row per grid point.
    """
    st = df.agg(F.min(_x(col)).alias("lo"), F.max(_x(col)).alias("hi"), F.count(_x(col)).alias("n"),
                F.stddev_samp(_x(col)).alias("sd")).first()
    spark = df.sparkSession
    if not st["n"] or st["sd"] is None or st["sd"] == 0:
        return spark.createDataFrame([], "point bigint, x double, density double")
    n, sd = st["n"], st["sd"]
    h = sd * n ** (-1.0 / 5.0)
    g0 = st["lo"] - cut * h
    step = (st["hi"] - st["lo"] + 2 * cut * h) / (points - 1)
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    ship_package(spark)

    def run(batches):
        grid, total = g0 + step * np.arange(points), np.zeros(points)
        for b in batches:
            v, w = (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns)
            for low in range(0, len(v), 1024):
                z = (grid[None, :] - v[low:low + 1024, None]) / h
                total += w[low:low + 1024] @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_arrays([pa.array(range(points), pa.int64()), pa.array(total)], ["point", "s"])

    return weighted_values(df, _x(col)).mapInArrow(run, "point long, s double").groupBy("point").agg(F.sum("s").alias("_s")) \
        .select("point", (F.lit(g0) + F.col("point").cast("double") * F.lit(step)).alias("x"),
                (F.col("_s") * F.lit(norm)).alias("density"))


def axis_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Exact quantile used as an axis limit."""
    return exact_quantiles(df, col, {"quantile": q})


def box_stats(df: DataFrame, by: str, col: str, whis: float = 1.5) -> DataFrame:
    """q1, median, q3, whiskers at the extreme inliers, outlier count, per group."""
    q = exact_quantiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[by], count_col="n")
    rows = attach_group_stats(df.select(by, _x(col).alias("_v")).where(F.col("_v").isNotNull()), q, [by])
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - F.lit(whis) * iqr, F.col("q3") + F.lit(whis) * iqr
    agg = rows.groupBy(by).agg(
        F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("whisker_high"),
        F.count(F.when((F.col("_v") < lo_f) | (F.col("_v") > hi_f), F.lit(1))).alias("outliers"))
    return q.join(agg, by)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Level frequencies, descending (nulls left out)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), col)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair.

    Each task multiplies its batches with their masks of present values (counts, sums, squares and
    products of every pair at once, of values less their column means) and sends one row per column.
    The d x d sums are then a statistic of the model's size.
    """
    spark, d = df.sparkSession, len(cols)
    ship_package(spark)
    means = df.agg(*[F.avg(x_of(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    data = df.select(F.array(*[x_of(c) - F.lit(means[i] or 0.0) for i, c in enumerate(cols)]).alias("x"))

    def run(batches):
        total = np.zeros((d, 4, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, d)
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            for k, part in enumerate((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)):
                total[:, k] += part
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.reshape(d, -1).tolist(), pa.list_(pa.float64()))],
                                         ["i", "v"])

    cells = (data.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")))
    sums = np.zeros((d, 4 * d))
    for r in cells.collect():
        sums[r["i"], r["j"]] = r["v"]
    n, s, q, p = sums.reshape(d, 4, d).transpose(1, 0, 2)
    rows = []
    for i in range(d):
        for j in range(d):
            spread = (n[i, j] * q[i, j] - s[i, j] ** 2) * (n[i, j] * q[j, i] - s[j, i] ** 2)
            rows.append((cols[i], cols[j], float((n[i, j] * p[i, j] - s[i, j] * s[j, i]) / math.sqrt(spread)) if spread > 0 else None))
    return spark.createDataFrame(rows, "col_a string, col_b string, corr double")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of every column with the target, descending."""
    feats = [c for c in cols if c != target]
    one = df.agg(*[F.corr(_x(c), _x(target)).alias(f"c{i}") for i, c in enumerate(feats)])
    items = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(feats)]
    return one.select(F.explode(F.array(*items)).alias("p")).select("p.feature", "p.corr") \
        .orderBy(F.desc("corr"), "feature")


def scatter_matrix(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """2-D binned counts for every column pair (i < j), rows with a null coordinate skipped."""
    stats = df.agg(*[F.min(_x(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                   *[F.max(_x(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    idx = {c: bin_index(_x(c), stats[f"lo{i}"], stats[f"hi{i}"], bins) for i, c in enumerate(cols)
           if stats[f"lo{i}"] is not None}
    items = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if a in idx and b in idx:
                items.append(F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"),
                                      idx[a].alias("bin_x"), idx[b].alias("bin_y")))
    exploded = df.select(F.explode(F.array(*items)).alias("p")).select("p.*") \
        .where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
    return exploded.groupBy("col_x", "col_y", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))


def reg_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """G9 line: OLS slope and intercept of y on x."""
    return df.agg(F.regr_slope(_x(y), _x(x)).alias("slope"), F.regr_intercept(_x(y), _x(x)).alias("intercept"),
                  F.regr_count(_x(y), _x(x)).alias("n"))


def poisson1_cdf() -> list[float]:
    """P(X <= k) of the Poisson distribution with mean 1, up to where it is 1 in double precision."""
    out, term, k = [], math.exp(-1.0), 0
    while not out or out[-1] < 1.0 and term > 0:
        out.append((out[-1] if out else 0.0) + term)
        k += 1
        term /= k
        if len(out) > 1 and out[-1] == out[-2]:
            break
    return out


BAND_BUCKETS = 1000


def _draw_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5 (the same in other engines)."""
    digest = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digest, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def reg_band(df: DataFrame, x: str, y: str, key: str, n_boot: int = 1000, points: int = 100,
             level: float = 0.95, seed: int = 42, buckets: int = BAND_BUCKETS) -> DataFrame:
    """G9 band: Poisson bootstrap of the OLS line over hash buckets of rows.

    One pass sums the rows into ``buckets`` buckets by a hash of the key (n, x, y, xx, xy).  Every
    draw gives each bucket a Poisson(1) weight (a block bootstrap: rows of a bucket are drawn
    together; with hashed buckets the blocks are random), so the work of the draws depends on
    ``buckets`` and ``n_boot`` alone.  The band is the (1 - level)/2 and (1 + level)/2 quantiles of
    the fitted values on a grid.
    """
    base = df.select(F.col(key).alias("_k"), _x(x).alias("_x"), _x(y).alias("_y")) \
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    lo, hi, _ = min_max(base, "_x")
    if lo is None:
        return df.sparkSession.createDataFrame([], "point int, x double, band_lo double, band_hi double")
    sums = base.groupBy(hash_bucket("_k", buckets, seed).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("x"), F.sum("_y").alias("y"),
        F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    draws = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("draw"))
    u = _draw_uniform(F.lit(seed), F.col("bucket"), F.col("draw"))
    cdf = poisson1_cdf()
    weight = F.lit(len(cdf))
    for k in reversed(range(len(cdf))):
        weight = F.when(F.col("_u") < F.lit(cdf[k]), F.lit(k)).otherwise(weight)
    fits = draws.withColumn("_u", u).withColumn("_w", weight.cast("double")).groupBy("draw").agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(f"s{c}") for c in ("n", "x", "y", "xx", "xy")])
    slope = (F.col("sn") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sn") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fits = fits.select("draw", slope.alias("b1"), ((F.col("sy") - slope * F.col("sx")) / F.col("sn")).alias("b0"))
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    # n_boot x points rows: bounded by the parameters, so the exact percentile holds n_boot values per point.
    preds = fits.select("b0", "b1", grid).withColumn("gx", F.lit(lo) + F.col("point") * F.lit(step)) \
        .withColumn("yhat", F.col("b0") + F.col("b1") * F.col("gx"))
    a = (1 - level) / 2
    return preds.groupBy("point", "gx").agg(
        F.percentile("yhat", a).alias("band_lo"), F.percentile("yhat", 1 - a).alias("band_hi")) \
        .withColumnRenamed("gx", "x")


def top_by_median(df: DataFrame, by: str, col: str, n: int = 10) -> DataFrame:
    """Groups with the highest median, top n (name breaks ties) -> TakeOrderedAndProject."""
    med = exact_quantiles(df, col, {"median": 0.5}, by=[by])
    return med.orderBy(F.desc("median"), F.asc(by)).limit(n)


def semi_join_top(df: DataFrame, top: DataFrame, by: str) -> DataFrame:
    """Rows whose group is in ``top``; ``top`` is a top-n result, bounded by n rows."""
    return df.join(F.broadcast(top.select(by)), by, "left_semi")


def geo_grid(df: DataFrame, x: str, y: str, cell: float, value: str = "price",
             by: str | None = None) -> DataFrame:
    """Grid cells of (x, y) with count, mean and exact median of ``value`` (per ``by`` level)."""
    keys = ["cell_x", "cell_y"] + ([by] if by else [])
    cells = df.where(_x(x).isNotNull() & _x(y).isNotNull()).select(
        *([by] if by else []), F.floor(_x(x) / F.lit(cell)).alias("cell_x"),
        F.floor(_x(y) / F.lit(cell)).alias("cell_y"), _x(value).alias("_v"))
    agg = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg("_v").alias("mean"))
    med = exact_quantiles(cells, "_v", {"median": 0.5}, by=keys)
    # Left: cells without a value have no median.  Null-safe: rows without a level are a group too.
    renamed = med.select(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)], "median")
    same = reduce(lambda a, b: a & b, [F.col(quoted(k)).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return agg.join(renamed, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def residual_profile(df: DataFrame, label: str, prediction: str = "prediction", bins: int = 50) -> DataFrame:
    """Residual histogram (kind='hist') and residual-vs-prediction 2-D bins (kind='cloud')."""
    res = df.select(_x(prediction).alias("pred"), (_x(label) - _x(prediction)).alias("residual")) \
        .where(F.col("residual").isNotNull())
    h = histogram(res, "residual", bins).select(
        F.lit("hist").alias("kind"), F.col("bin").alias("bin_x"), F.lit(None).cast("bigint").alias("bin_y"), "count")
    cloud = scatter_matrix(res, ["pred", "residual"], bins).select(
        F.lit("cloud").alias("kind"), "bin_x", "bin_y", "count")
    return h.unionByName(cloud)


def cluster_projection(df: DataFrame, cols: Sequence[str], label: str, key: str) -> DataFrame:
    """(key, pc1, pc2, label) per row from the standardised 2-component PCA."""
    from staylens.operators.features import pca_2d
    return pca_2d(df.select(key, label, *cols), cols).select(key, "pc1", "pc2", label)

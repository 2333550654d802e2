"""Exact order statistics that stay distributed when one group holds most rows.

``exact_quantiles`` never gathers a group into one task: values are first
collapsed to distinct (group, value, weight) rows by a partially aggregated
``groupBy``, then range-partitioned on (group, value) so a hot group is split
over many tasks.  Each task computes running weights inside its slice; a small
table of per-slice totals gives every slice its rank offset inside the group.
The rows whose rank interval holds a target rank are the order statistics;
linear interpolation between the two neighbours gives the quantile
(``lo + (hi - lo) * frac`` at position ``(n - 1) * q``, as pandas, Spark
``percentile`` and DuckDB ``quantile_cont`` define it).

The range-partitioned slice table is checkpointed to the shared checkpoint
folder so that every consumer sees the same slice ids, also after executor loss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.session import checkpoint_root

_V, _W, _PID, _G = "_q_v", "_q_w", "_q_pid", "_q_g"


def weighted_values(df: DataFrame, col: str | Column, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct (by..., value, weight) rows; NaN and NULL values are left out.  A row counts once, or as
    often as its ``weight`` column (a whole number) says."""
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    vals = df.select(*by, v.alias(_V), w.alias(_W)).where(F.col(_V).isNotNull() & ~F.isnan(F.col(_V)) & (F.col(_W) > 0))
    return vals.groupBy(*by, _V).agg(F.sum(_W).alias(_W))


def exact_quantiles(df: DataFrame, col: str | Column, probs: Mapping[str, float],
                    by: Sequence[str] = (), count_col: str | None = None, weight: str | None = None) -> DataFrame:
    """One row per group: ``by`` columns plus one double column per entry of ``probs``.

    Groups without a non-null value do not appear.  ``count_col`` adds the number
    of non-null values of the group.  ``weight`` names a column of repetition counts.
    """
    by = list(by)
    spark = df.sparkSession
    checkpoint_root(spark)
    dist = weighted_values(df, col, by, weight)
    # One non-null key per group (NULL group values included), so that the joins below
    # are plain equi-joins on the same keys the windows partition by: no re-shuffle.
    gkey = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    dist = dist.withColumn(_G, gkey)
    # Slices: contiguous (group, value) ranges; a hot group spans many slices.
    sliced = dist.repartitionByRange(*by, _V).withColumn(_PID, F.spark_partition_id())
    sliced = sliced.checkpoint(eager=True)

    totals = sliced.groupBy(_PID, _G).agg(F.sum(_W).alias("_q_tw"))
    gw = Window.partitionBy(_G)
    totals = totals.select(
        _PID, _G, "_q_tw",
        F.coalesce(F.sum("_q_tw").over(gw.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_q_off"),
        F.sum("_q_tw").over(gw).alias("_q_n"),
    )
    # Target ranks of every quantile: floor and ceil of (n - 1) * q.
    targets = []
    for name, q in probs.items():
        pos = (F.col("_q_n") - 1).cast("double") * F.lit(float(q))
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("_q_n") - 1)
        frac = pos - lo
        targets.append(F.struct(F.lit(name).alias("qn"), F.lit(0).alias("side"), lo.alias("rank"), frac.alias("frac")))
        targets.append(F.struct(F.lit(name).alias("qn"), F.lit(1).alias("side"), hi.alias("rank"), frac.alias("frac")))
    tt = totals.select(_PID, _G, "_q_off", "_q_tw", "_q_n", F.explode(F.array(*targets)).alias("t")) \
        .where((F.col("t.rank") >= F.col("_q_off")) & (F.col("t.rank") < F.col("_q_off") + F.col("_q_tw"))) \
        .select(_PID, _G, "_q_off", "_q_n", F.col("t.qn").alias("qn"), F.col("t.side").alias("side"),
                F.col("t.rank").alias("rank"), F.col("t.frac").alias("frac"))

    sw = Window.partitionBy(_PID, _G).orderBy(_V).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.select(_PID, _G, *by, _V, _W, F.coalesce(F.sum(_W).over(sw), F.lit(0)).alias("_q_before"))
    start = F.col("_q_off") + F.col("_q_before")
    hit = ranked.join(tt, [_PID, _G]) \
        .where((F.col("rank") >= start) & (F.col("rank") < start + F.col(_W))) \
        .select(*by, "qn", "side", "frac", "_q_n", _V)
    per_q = hit.groupBy(*by, "qn").agg(
        F.max(F.when(F.col("side") == 0, F.col(_V))).alias("lo"),
        F.max(F.when(F.col("side") == 1, F.col(_V))).alias("hi"),
        F.max("frac").alias("frac"), F.max("_q_n").alias("_q_n"))
    value = F.when(F.col("frac") == 0, F.col("lo")) \
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac"))
    per_q = per_q.select(*by, "qn", value.alias("qv"), "_q_n")
    out = per_q.groupBy(*by).agg(
        *[F.max(F.when(F.col("qn") == F.lit(name), F.col("qv"))).alias(name) for name in probs],
        F.max("_q_n").alias("_q_n"))
    if count_col:
        return out.withColumnRenamed("_q_n", count_col)
    return out.drop("_q_n")

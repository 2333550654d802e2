"""Physical-plan checks: top-k, broadcasts, join-free assignment, partition pruning, column pruning."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from staylens.operators.clustering import assign_clusters
from staylens.plans import frames
from staylens.session import scratch_path
from staylens.sources import sinks


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_take_ordered(spark):
    plan = _plan(E.queries()["top_neighbourhoods"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_semi_join_broadcasts_the_top_list(spark):
    df = E.queries()["semi_join_top"](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    assert "LeftSemi" in plan and "Broadcast" in plan


def test_assignment_is_a_projection(spark):
    pts = spark.range(100).select(F.col("id").cast("double").alias("f1"), (F.col("id") / 10).alias("f2"))
    plan = _plan(assign_clusters(pts, ["f1", "f2"], frames.FIXED_CENTROIDS, "cluster"))
    assert "Join" not in plan and "Exchange" not in plan


def test_partitioned_clusters_prune(spark):
    pts = spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("int").alias("cluster"))
    path = scratch_path(spark, "pruning")
    sinks.write_table(pts, path, partition_by=["cluster"])
    one = spark.read.parquet(path).where("cluster = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan and one.count() == 100


def test_scan_reads_only_needed_columns(spark):
    from staylens.sources.tables import read_table
    df = read_table(spark, SF_SMALL, "lineitem").where("l_quantity > 10").select("l_orderkey")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan

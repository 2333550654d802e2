"""The shared tables of the queries and the listings they come from, over hand-made tables."""

import os

from pyspark.sql import functions as F

from staylens.plans import frames
from staylens.sources.fixtures import listings_raw


def tables(spark, folder) -> str:
    spark.createDataFrame([(k, 1 + k % 2, 100.0 + k, "LOW") for k in range(1, 9)] + [(9, None, 1.0, "LOW"), (None, 1, 50.0, "LOW")],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "a", 0, 10.0, "X"), (2, "b", 0, 9000.0, "Y")],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    lines = [(1, 1, 5.0, 7), (1, 2, 6.0, 7), (1, 2, 6.0, 7), (1, 3, None, None), (2, None, 1.0, 8), (2, 4, 1.0, 9), (None, 1, 1.0, 1), (3, 1, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_lines_are_dealt_once_and_counted_per_order(spark, tmp_path):
    out = listings_raw(spark, tables(spark, tmp_path))
    got = {r["id"]: (r["accommodates"], r["bedrooms"], r["beds"], r["number_of_reviews"]) for r in out.collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, None)} == {1: (3, 4, 1, 17), 2: (4, 2, 2, 2), 3: (1, 1, 0, None), 4: (None,) * 4, None: (None,) * 4}
    assert len(got) == 9  # an order without customer is no listing
    plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey") == 1


def test_shared_tables_are_columns_of_what_the_cleaner_reads(spark, tmp_path):
    sf = tables(spark, tmp_path)
    keyed = frames.keyed(spark, sf)
    files = keyed.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
    assert not {"name", "host_name", "host_id"} & set(frames.shared_raw(spark, sf).columns)
    assert frames.keyed(spark, sf) is keyed and keyed.count() == frames.clean(spark, sf).count() > 0
    assert keyed.where(F.col("log_price") != F.log1p("price")).count() == 0
    frames.release(spark)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)

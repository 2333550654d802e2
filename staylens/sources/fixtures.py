"""The ``listings_raw`` fixture: a raw listings table derived from the testdata star schema.

Spark builds it with the DataFrame API; the same derivation is written as DuckDB
SQL (``LISTINGS_RAW_SQL``) for the oracle.  Both read the whole tables.

Derivation (fixed values, shared by both engines):
  id = o_orderkey, host = customer, neighbourhood = nation name,
  room_type = o_orderpriority, property_type = c_mktsegment,
  per-order lineitem aggregates give accommodates / bedrooms / beds / reviews,
  rows with id % 50 = 0 are appended again with id + 1000000 (duplicates once
  the id columns are dropped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.sources.tables import read_table

# Fixed values of the derivation (must equal the oracle text below).
DUPLICATE_EVERY = 50
DUPLICATE_ID_OFFSET = 1000000


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings (strings with units, flags, money) over orders ⋈ customer ⋈ nation."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")

    # Per-order aggregates: lines are dealt by order once, then counted per supplier and per order where they lie.
    # Lines without an order join none.
    dealt = lineitem.where(F.col("l_orderkey").isNotNull()).repartition("l_orderkey")
    per_order = dealt.groupBy("l_orderkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_linenumber").alias("max_line"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
    ).groupBy("l_orderkey").agg(
        F.sum("n_lines").alias("n_lines"),
        F.max("max_line").alias("max_line"),
        F.sum("qty").alias("qty"),
        F.count("l_suppkey").alias("n_supp"),
    )
    per_host = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_host"))

    # nation has 25 rows by definition of the schema: a broadcast of fixed size.
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(per_host, "o_custkey", "left")
    )
    ok = F.col("o_orderkey")
    ck = F.col("c_custkey")
    baths = F.when(F.col("l_orderkey").isNull(), F.lit(None).cast("string")) \
        .when(_mod(ok, 17) == 0, F.lit("Half-bath")) \
        .otherwise(F.concat(F.col("n_lines").cast("string"),
                            F.when(_mod(ok, 2) == 0, F.lit(".5")).otherwise(F.lit("")),
                            F.lit(" baths")))
    listings = base.select(
        ok.alias("id"),
        F.concat(F.lit("Listing "), ok.cast("string")).alias("name"),
        ck.alias("host_id"),
        F.col("c_name").alias("host_name"),
        F.when(_mod(ck, 11) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(_mod(ck, 101).cast("string"), F.lit("%"))).alias("host_response_rate"),
        F.when(_mod(ck, 7) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(_mod(ck * 3, 101).cast("string"), F.lit("%"))).alias("host_acceptance_rate"),
        F.when(_mod(ck, 13) == 0, F.lit(None).cast("string"))
        .when(F.col("c_acctbal") > 5000, F.lit("t")).otherwise(F.lit("f")).alias("host_is_superhost"),
        F.col("n_host").alias("host_listings_count"),
        F.col("n_host").alias("calculated_host_listings_count"),
        F.when(_mod(ok, 83) == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("neighbourhood"),
        F.col("o_orderpriority").alias("room_type"),
        F.col("c_mktsegment").alias("property_type"),
        F.col("max_line").alias("accommodates"),
        baths.alias("bathrooms_text"),
        F.col("n_lines").alias("bedrooms"),
        F.col("n_supp").alias("beds"),
        (F.lit(1) + _mod(ok, 30) + F.when(_mod(ok, 211) == 0, F.lit(365)).otherwise(F.lit(0)))
        .cast("bigint").alias("minimum_nights"),
        F.col("qty").alias("number_of_reviews"),
        F.when(_mod(ok, 5) == 0, F.lit(None).cast("double"))
        .otherwise((F.lit(30) + _mod(ok, 21)).cast("double") / F.lit(10.0)).alias("review_scores_rating"),
        F.when(_mod(ok, 89) == 0, F.lit(None).cast("string"))
        .when(_mod(ok, 97) == 0, F.lit("$0.00"))
        .otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("price"),
    )
    # Every DUPLICATE_EVERY-th listing is emitted twice (second copy with a shifted id) by a
    # generator in the same stage: the joins and aggregates above run once, not once per copy.
    copies = F.when(_mod(F.col("id"), DUPLICATE_EVERY) == 0, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    out = listings.select("*", F.explode(copies).alias("_copy"))
    out = out.withColumn("id", F.col("id") + F.col("_copy") * F.lit(DUPLICATE_ID_OFFSET))
    return out.drop("_copy")


# DuckDB text of the same derivation, used as a CTE prefix by every oracle query.
LISTINGS_RAW_SQL = """
listings_l AS (
  SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS max_line,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         count(DISTINCT l_suppkey) AS n_supp
  FROM lineitem GROUP BY l_orderkey),
listings_h AS (SELECT o_custkey, count(*) AS n_host FROM orders GROUP BY o_custkey),
listings_base AS (
  SELECT o.o_orderkey AS id,
    'Listing ' || CAST(o.o_orderkey AS VARCHAR) AS name,
    c.c_custkey AS host_id,
    c.c_name AS host_name,
    CASE WHEN c.c_custkey % 11 = 0 THEN NULL
         ELSE CAST(c.c_custkey % 101 AS VARCHAR) || '%' END AS host_response_rate,
    CASE WHEN c.c_custkey % 7 = 0 THEN NULL
         ELSE CAST((c.c_custkey * 3) % 101 AS VARCHAR) || '%' END AS host_acceptance_rate,
    CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_acctbal > 5000 THEN 't' ELSE 'f' END
      AS host_is_superhost,
    h.n_host AS host_listings_count,
    h.n_host AS calculated_host_listings_count,
    CASE WHEN o.o_orderkey % 83 = 0 THEN NULL ELSE n.n_name END AS neighbourhood,
    o.o_orderpriority AS room_type,
    c.c_mktsegment AS property_type,
    l.max_line AS accommodates,
    CASE WHEN l.l_orderkey IS NULL THEN NULL
         WHEN o.o_orderkey % 17 = 0 THEN 'Half-bath'
         ELSE CAST(l.n_lines AS VARCHAR) || (CASE WHEN o.o_orderkey % 2 = 0 THEN '.5' ELSE '' END) || ' baths'
    END AS bathrooms_text,
    l.n_lines AS bedrooms,
    l.n_supp AS beds,
    CAST(1 + o.o_orderkey % 30 + CASE WHEN o.o_orderkey % 211 = 0 THEN 365 ELSE 0 END AS BIGINT)
      AS minimum_nights,
    l.qty AS number_of_reviews,
    CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
         ELSE CAST(30 + o.o_orderkey % 21 AS DOUBLE) / 10.0 END AS review_scores_rating,
    CASE WHEN o.o_orderkey % 89 = 0 THEN NULL
         WHEN o.o_orderkey % 97 = 0 THEN '$0.00'
         ELSE '$' || format('{:,.2f}', o.o_totalprice) END AS price
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN listings_l l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN listings_h h ON h.o_custkey = o.o_custkey),
listings_raw AS (
  SELECT * FROM listings_base
  UNION ALL
  SELECT * REPLACE (id + 1000000 AS id) FROM listings_base WHERE id % 50 = 0)
"""

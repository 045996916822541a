"""The driver's tables in the roles of survey data.

A line item is a respondent, its quantity the weight; nation and order year make a market, regions are countries, the supplier
(some of them, as ``party``) is the party and its nation the family. Missing values are put in, so that their rules show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, w, party (some missing), family, market (nation), year, country (region), vote, day, x1 (some missing), x2, size."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    voters = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(voters, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("rid"),
        F.col("l_quantity").alias("w"), F.nullif(F.col("l_suppkey") % 7, F.lit(0)).alias("party"), (F.col("l_suppkey") % 5).alias("family"),
        F.col("n_name").alias("market"), F.year("o_orderdate").cast("bigint").alias("year"), F.col("r_name").alias("country"), F.col("l_returnflag").alias("vote"),
        F.to_date("o_orderdate").alias("day"), F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("x1"), F.col("l_tax").alias("x2"),
        F.col("l_partkey").alias("partkey"), F.col("c_mktsegment").alias("segment"), F.col("l_suppkey").alias("suppkey"), F.col("c_acctbal").alias("balance"),
    )


#: The same rows in DuckDB.
RESPONDENTS = """
respondents AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS rid, l_quantity AS w, nullif(l_suppkey % 7, 0) AS party, l_suppkey % 5 AS family,
    n_name AS market, CAST(year(o_orderdate) AS BIGINT) AS year, r_name AS country, l_returnflag AS vote, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN l_discount <> 0.05 THEN l_discount END AS x1, l_tax AS x2, l_partkey AS partkey, c_mktsegment AS segment, l_suppkey AS suppkey, c_acctbal AS balance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

"""Registered queries: market shares, products, indices, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import windows as W
from psephos.operators.aggregates import total, wmean
from psephos.operators.joins import guarded_join
from psephos.plans.base import RESPONDENTS, respondents, table
from psephos.plans.registry import query

VOTERS = f"WITH {RESPONDENTS}, voters AS (SELECT * FROM respondents WHERE vote IN ('A', 'R'))"
CELLS = "cells AS (SELECT market, year, country, party, sum(w) AS w FROM voters GROUP BY 1, 2, 3, 4)"
SHARES = """
shares AS (
  SELECT market, year, country, party, w, CASE WHEN party IS NOT NULL THEN w / nullif(sum(w) OVER (PARTITION BY market, year), 0) END AS share FROM cells)
"""


def voters(spark: SparkSession, d: str) -> DataFrame:
    return respondents(spark, d).where(F.col("vote").isin("A", "R"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Weights by market and party, before any window: windows then run over few rows."""
    return voters(spark, d).groupBy("market", "year", "country", "party").agg(F.sum("w").alias("w"))


def shares(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("share", W.share("w", ["market", "year"], "party"))


def products(spark: SparkSession, d: str) -> DataFrame:
    rows = voters(spark, d).groupBy("market", "year", "country", "party").agg(
        F.sum("w").alias("w"), wmean("x1", "w").alias("x1"), wmean("x2", "w").alias("x2"), F.max("family").alias("family"), F.count("*").alias("n")
    )
    return rows.withColumn("share", W.share("w", ["market", "year"], "party")).dropna(subset=["party"])


PRODUCTS = """
agg AS (
  SELECT market, year, country, party, sum(w) AS w, sum(CASE WHEN x1 IS NOT NULL THEN x1 * w END) / nullif(sum(CASE WHEN x1 IS NOT NULL THEN w END), 0) AS x1,
    sum(x2 * w) / nullif(sum(w), 0) AS x2, max(family) AS family, count(*) AS n FROM voters GROUP BY 1, 2, 3, 4),
products AS (
  SELECT * FROM (SELECT *, CASE WHEN party IS NOT NULL THEN w / nullif(sum(w) OVER (PARTITION BY market, year), 0) END AS share FROM agg) WHERE party IS NOT NULL)
"""
CHAIN = f"{VOTERS}, {PRODUCTS}"


@query(f"""{VOTERS}, {CELLS}, {SHARES}
SELECT market, year, party, round(w, 4) AS weight, round(share, 10) AS share FROM shares WHERE party IS NOT NULL""")
def market_party_share(spark: SparkSession, d: str) -> DataFrame:
    """Weighted shares of parties in their markets; voters without a party count in the denominator only."""
    rows = shares(spark, d).dropna(subset=["party"])
    return rows.select("market", "year", "party", F.round("w", 4).alias("weight"), F.round("share", 10).alias("share"))


@query(f"""{VOTERS}, {CELLS}, {SHARES}
SELECT market, year, round(sum(share), 10) AS known_share, CAST(count(*) FILTER (party IS NULL) AS BIGINT) AS unknown_rows FROM shares GROUP BY 1, 2""")
def share_null_party_denominator(spark: SparkSession, d: str) -> DataFrame:
    return shares(spark, d).groupBy("market", "year").agg(F.round(F.sum("share"), 10).alias("known_share"), F.count_if(F.col("party").isNull()).alias("unknown_rows"))


@query(f"""{CHAIN} SELECT market, year, party, round(x1, 10) AS x1, round(x2, 10) AS x2, n FROM products""")
def product_weighted_means(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select("market", "year", "party", F.round("x1", 10).alias("x1"), F.round("x2", 10).alias("x2"), "n")


@query(f"""{CHAIN}, known AS (SELECT *, share / sum(share) OVER (PARTITION BY market, year) AS s FROM products),
whole AS (SELECT *, sum(s) OVER (PARTITION BY market, year) AS t FROM known)
SELECT market, year, party, round(CASE WHEN t >= 1 - 1e-12 THEN s * 0.99 / t ELSE s END, 10) AS share FROM whole""")
def share_rescale_outside(spark: SparkSession, d: str) -> DataFrame:
    """Shares among known parties sum to one, so they are scaled to leave an outside share."""
    rows = products(spark, d).withColumn("s", F.col("share") / W.group_total("share", ["market", "year"]))
    return rows.select("market", "year", "party", F.round(W.rescaled("s", ["market", "year"]), 10).alias("share"))


@query(f"""{CHAIN}, e AS (SELECT *, market || CAST(year AS VARCHAR) AS election FROM products),
i AS (SELECT election, row_number() OVER (ORDER BY election) - 1 AS market_id FROM (SELECT DISTINCT election FROM e))
SELECT election, i.market_id, CAST(i.market_id AS VARCHAR) || '_' || CAST(party AS VARCHAR) AS product_id FROM e JOIN i USING (election)""")
def product_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d).withColumn("election", F.concat("market", F.col("year").cast("string")))
    rows = W.with_rank_ids(rows.select("election", "party"), "election", "market_id")
    return rows.select("election", F.col("market_id").cast("bigint").alias("market_id"), F.concat_ws("_", F.col("market_id").cast("string"), F.col("party").cast("string")).alias("product_id"))


@query(f"""{CHAIN}, mw AS (SELECT market, year, sum(w) AS market_weight FROM voters GROUP BY 1, 2)
SELECT market, year, party, round(market_weight, 4) AS market_weight FROM products JOIN mw USING (market, year)""")
def market_weight_join(spark: SparkSession, d: str) -> DataFrame:
    weights = voters(spark, d).groupBy("market", "year").agg(total("w").alias("market_weight"))
    rows = guarded_join(products(spark, d), weights, ["market", "year"])
    return rows.select("market", "year", "party", F.round("market_weight", 4).alias("market_weight"))


@query(f"""{CHAIN}, demo AS (SELECT market, year, avg(x2) AS x2_bar, avg(CASE WHEN segment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS building_bar FROM respondents GROUP BY 1, 2)
SELECT market, year, party, round(x2_bar, 10) AS x2_bar, round(building_bar, 10) AS building_bar FROM products LEFT JOIN demo USING (market, year)""")
def market_demographic_means(spark: SparkSession, d: str) -> DataFrame:
    people = respondents(spark, d).withColumn("building", (F.col("segment") == "BUILDING").cast("double"))
    means = people.groupBy("market", "year").agg(F.avg("x2").alias("x2_bar"), F.avg("building").alias("building_bar"))
    rows = guarded_join(products(spark, d), means, ["market", "year"])
    return rows.select("market", "year", "party", F.round("x2_bar", 10).alias("x2_bar"), F.round("building_bar", 10).alias("building_bar"))


CODES = (("x1", 1), ("x2", -1), ("x3", 1))
INDEXED = f"""{CHAIN}, indexed AS (
  SELECT *, (coalesce(x1, 0) - coalesce(x2, 0) + coalesce(x3, 0)) / nullif((x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT, 0) AS idx
  FROM (SELECT *, CASE WHEN party % 3 <> 0 THEN share END AS x3 FROM products))"""


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """The mean of signed codes over those that are known."""
    rows = products(spark, d).withColumn("x3", F.when(F.col("party") % 3 != 0, F.col("share")))
    known = sum((F.col(c).isNotNull().cast("int") for c, _ in CODES), F.lit(0))
    signed = sum((F.coalesce(F.col(c), F.lit(0.0)) * s for c, s in CODES), F.lit(0.0))
    return rows.withColumn("idx", F.try_divide(signed, F.nullif(known, F.lit(0))))


@query(f"{INDEXED} SELECT market, year, party, round(idx, 10) AS idx FROM indexed")
def signed_index(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).select("market", "year", "party", F.round("idx", 10).alias("idx"))


@query(f"{INDEXED}, p AS (SELECT avg(idx) AS mu, stddev_pop(idx) AS sd FROM indexed) SELECT market, year, party, round((idx - mu) / sd, 5) AS z FROM indexed, p")
def zscore_index(spark: SparkSession, d: str) -> DataFrame:
    return W.standardised(indexed(spark, d), "idx", "z").select("market", "year", "party", F.round("z", 5).alias("z"))


@query(f"""{INDEXED}, p AS (SELECT avg(idx) AS mu, stddev_pop(idx) AS sd FROM indexed)
SELECT market, year, party, round((share - mu) / sd, 5) AS share_z, round(pow((share - mu) / sd, 2) / 100, 10) AS share_z2 FROM indexed, p""")
def zscore_reuse_params(spark: SparkSession, d: str) -> DataFrame:
    """Another column by the index's mean and deviation, and its scaled square."""
    rows = indexed(spark, d)
    out = W.standardised(rows, "share", "z", W.score_params(rows, "idx"))
    return out.select("market", "year", "party", F.round("z", 5).alias("share_z"), F.round(F.pow("z", 2) / 100, 10).alias("share_z2"))


FAMILY = f"""{INDEXED}, fam AS (
  SELECT family, year, country, sum(CASE WHEN idx IS NOT NULL THEN idx * share END) / nullif(sum(CASE WHEN idx IS NOT NULL THEN share END), 0) AS m, sum(share) AS fw, count(*) AS n
  FROM indexed GROUP BY 1, 2, 3),
loo AS (
  SELECT *, CASE WHEN count(m) OVER f > 1 AND m IS NOT NULL THEN (sum(m) OVER f - m) / (count(m) OVER f - 1) END AS lo FROM fam WINDOW f AS (PARTITION BY family, year))"""


def leave_out(spark: SparkSession, d: str) -> DataFrame:
    rows = indexed(spark, d).groupBy("family", "year", "country").agg(wmean("idx", "share").alias("m"), F.sum("share").alias("fw"), F.count("*").alias("n"))
    return rows.withColumn("lo", W.leave_one_out("m", ["family", "year"]))


@query(f"{FAMILY} SELECT family, year, country, round(m, 10) AS m, round(fw, 10) AS fw, n, round(lo, 10) AS lo, round(lo * lo / 100, 12) AS lo2 FROM loo")
def leaveout_family_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = leave_out(spark, d)
    return rows.select("family", "year", "country", F.round("m", 10).alias("m"), F.round("fw", 10).alias("fw"), "n", F.round("lo", 10).alias("lo"), F.round(F.col("lo") * F.col("lo") / 100, 12).alias("lo2"))


@query(f"""{FAMILY} SELECT p.market, p.year, p.party, round(loo.lo, 10) AS lo FROM indexed p LEFT JOIN loo USING (country, family, year)
WHERE (p.country, p.year) IN (SELECT (country, year) FROM indexed WHERE share > 0.2)""")
def leaveout_semi_scope(spark: SparkSession, d: str) -> DataFrame:
    """Instruments joined to products, in the markets of a restricted sample."""
    rows = indexed(spark, d)
    scope = rows.where("share > 0.2").select("country", "year").distinct()
    out = guarded_join(rows, leave_out(spark, d).select("country", "family", "year", "lo"), ["country", "family", "year"])
    return out.join(scope, ["country", "year"], "left_semi").select("market", "year", "party", F.round("lo", 10).alias("lo"))


PANEL = f"""{FAMILY}, panel AS (
  SELECT country || '|' || CAST(party AS VARCHAR) AS party_key, year, sum(CASE WHEN idx IS NOT NULL THEN idx * share END) / nullif(sum(CASE WHEN idx IS NOT NULL THEN share END), 0) AS x,
    max(share) AS share, count(DISTINCT market) AS n_markets FROM indexed GROUP BY 1, 2)"""


def panel(spark: SparkSession, d: str, dim: str = "x") -> DataFrame:
    """A row for each party and year; x is the mean of the index, or of the second characteristic for the dimension "x2"."""
    rows = indexed(spark, d).withColumn("party_key", F.concat_ws("|", "country", F.col("party").cast("string")))
    return rows.groupBy("party_key", "year").agg(wmean("idx" if dim == "x" else dim, "share").alias("x"), F.max("share").alias("share"), F.countDistinct("market").alias("n_markets"))


@query(f"{PANEL} SELECT party_key, year, round(x, 10) AS x, round(share, 10) AS share, n_markets FROM panel")
def panel_rollup(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("party_key", "year", F.round("x", 10).alias("x"), F.round("share", 10).alias("share"), "n_markets")


@query(f"{PANEL} SELECT party_key, year, round(lag(x) OVER (PARTITION BY party_key ORDER BY year), 10) AS lagx FROM panel")
def panel_lag(spark: SparkSession, d: str) -> DataFrame:
    """The previous observed row, not the previous year."""
    rows = panel(spark, d)
    return rows.select("party_key", "year", F.round(W.previous("x", "party_key", ["year"]), 10).alias("lagx"))


@query(f"{PANEL} SELECT party_key, year, round(max(share) OVER (PARTITION BY party_key), 10) AS top, coalesce(max(share) OVER (PARTITION BY party_key) >= 0.2, false) AS keep FROM panel")
def party_ever_threshold(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    top = F.max("share").over(Window.partitionBy("party_key"))
    return panel(spark, d).select("party_key", "year", F.round(top, 10).alias("top"), W.ever_reaches("share", ["party_key"], 0.2).alias("keep"))


@query(f"{PANEL} SELECT party_key, year, round(x - avg(x) OVER (PARTITION BY party_key), 10) + 0.0 AS dx FROM panel")
def within_demean(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("party_key", "year", (F.round(W.demeaned("x", "party_key"), 10) + F.lit(0.0)).alias("dx"))


@query(f"""{CHAIN} SELECT market, year, party, round(x1 * x2, 12) AS x1_x2, round(x1 * share, 12) AS x1_share, round(x2 * share, 12) AS x2_share, 1.0::DOUBLE AS const FROM products""")
def interaction_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d)
    pairs = (("x1", "x2"), ("x1", "share"), ("x2", "share"))
    return rows.select("market", "year", "party", *(F.round(F.col(a) * F.col(b), 12).alias(f"{a}_{b}") for a, b in pairs), F.lit(1.0).alias("const"))


@query("SELECT n_name AS name, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Left joins whose unmatched rows still count as groups."""
    people = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = people.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("n_name").alias("name")).agg(F.count("o_orderkey").alias("orders"))

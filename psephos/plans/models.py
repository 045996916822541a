"""Registered queries: estimates, demand, resampling, source lists and offline enrichment."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import jsonx as X
from psephos.functions.numeric import p_value, stars
from psephos.operators import econ as E
from psephos.operators import source_lists as S
from psephos.operators import windows as W
from psephos.operators.aggregates import wmean
from psephos.operators.resample import PARTS, weighted_resample
from psephos.operators.similarity import once
from psephos.plans import shares as P
from psephos.plans.base import RESPONDENTS, respondents, table
from psephos.plans.registry import query
from psephos.sources.sinks import stage_types
from psephos.streaming.collect import collect, recorded

Z = ["z1", "z2", "z3"]
SUPPLY = f"""{P.PANEL}, zs AS (SELECT country, year, avg(balance) / 1000 AS z1, avg(x2) * 10 AS z2, avg(CASE WHEN segment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS z3 FROM respondents GROUP BY 1, 2),
supply AS (SELECT party_key AS party, panel.year, split_part(party_key, '|', 1) AS country, x, share AS d, lag(x) OVER (PARTITION BY party_key ORDER BY panel.year) AS lagx FROM panel),
full_panel AS (SELECT s.*, z1, z2, z3, CASE WHEN count(x) OVER f > 1 THEN (sum(x) OVER f - x) / (count(x) OVER f - 1) END AS fam FROM supply s JOIN zs USING (country, year) WINDOW f AS (PARTITION BY country, year))"""


def supply(spark: SparkSession, d: str, dim: str = "x") -> DataFrame:
    """party, year, x, d, lagx, fam and three market instruments; x is the position in the dimension ``dim`` ("x" or "x2")."""
    people = respondents(spark, d).withColumn("building", (F.col("segment") == "BUILDING").cast("double"))
    z = people.groupBy("country", "year").agg((F.avg("balance") / 1000).alias("z1"), (F.avg("x2") * 10).alias("z2"), F.avg("building").alias("z3"))
    rows = P.panel(spark, d, dim).select(F.col("party_key").alias("party"), "year", F.split_part("party_key", F.lit("|"), F.lit(1)).alias("country"), "x", F.col("share").alias("d"))
    rows = rows.withColumn("lagx", W.previous("x", "party", ["year"])).join(z, ["country", "year"])
    return rows.withColumn("fam", W.leave_one_out("x", ["country", "year"]))


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([values]))


@query(f"""WITH {SUPPLY[5:]}, r AS (SELECT * FROM full_panel WHERE isfinite(x) AND isfinite(d) AND isfinite(z1) AND isfinite(z2) AND isfinite(z3)),
m AS (SELECT x - avg(x) OVER (PARTITION BY party) AS y, d - avg(d) OVER (PARTITION BY party) AS d FROM r),
b AS (SELECT sum(y * d) / sum(d * d) AS beta, sum(d * d) AS dd, count(*) AS n FROM m)
SELECT any_value(n) AS n, round(any_value(beta), 6) AS beta, round(sqrt(any_value(n) / (any_value(n) - 1.0) * sum(pow((y - beta * d) * d, 2)) / pow(any_value(dd), 2)), 6) AS se FROM m, b""")
def ols_fe_hc1(spark: SparkSession, d: str) -> DataFrame:
    """Least squares with party effects taken out, and its robust error."""
    fit = E.fit_spec(supply(spark, d), "ideal_only", "OLS", Z)
    return _row(spark, n=fit.n, beta=round(fit["d"], 6), se=round(math.sqrt(fit.cov[0, 0]), 6))


@query(f"""WITH {SUPPLY[5:]}, r AS (SELECT * FROM full_panel WHERE isfinite(x) AND isfinite(d) AND isfinite(z2)),
m AS (SELECT x - avg(x) OVER (PARTITION BY party) AS y, d - avg(d) OVER (PARTITION BY party) AS d, z2 - avg(z2) OVER (PARTITION BY party) AS z FROM r),
b AS (SELECT sum(z * y) / sum(z * d) AS beta, sum(z * d) AS zd, count(*) AS n, sum(d * d) - pow(sum(d), 2) / count(*) AS rr, sum(d * d) - pow(sum(z * d), 2) / sum(z * z) AS ur FROM m)
SELECT any_value(n) AS n, round(any_value(beta), 5) AS beta, round(sqrt(sum(pow((y - beta * d) * z, 2)) / pow(any_value(zd), 2)), 5) AS se, round((any_value(rr) - any_value(ur)) / (any_value(ur) / (any_value(n) - 2)), 5) AS first_stage_f FROM m, b""")
def iv_just_identified(spark: SparkSession, d: str) -> DataFrame:
    fit = E.fit_spec(supply(spark, d), "ideal_only", "IV", ["z2"])
    return _row(spark, n=fit.n, beta=round(fit["d"], 5), se=round(math.sqrt(fit.cov[0, 0]), 5), first_stage_f=round(fit.first_stage_f, 5))


def _orthogonal(column: str, to: int | tuple[int, ...], name: str, table: str) -> str:
    """A step of Gram and Schmidt: ``column`` without its projections on q1, q2, ..."""
    places = range(1, to + 1) if isinstance(to, int) else to
    return f"(SELECT *, {column}" + "".join(f" - q{k} * (sum({column} * q{k}) OVER () / sum(q{k} * q{k}) OVER ())" for k in places) + f" AS {name} FROM {table})"


def _along(a: str, b: str, places: tuple[int, ...]) -> str:
    return " + ".join(f"sum(q{k} * {a}) * sum(q{k} * {b}) / sum(q{k} * q{k})" for k in places)


@query(f"""WITH {SUPPLY[5:]}, r AS (SELECT * FROM full_panel WHERE isfinite(x) AND isfinite(d) AND isfinite(lagx) AND isfinite(fam) AND isfinite(z1) AND isfinite(z2) AND isfinite(z3)),
m AS (SELECT {', '.join(f'{c} - avg({c}) OVER p AS {n}' for c, n in (('x', 'y'), ('d', 'd'), ('lagx', 'q1'), ('fam', 'f'), ('z1', 'a'), ('z2', 'b'), ('z3', 'c')))} FROM r WINDOW p AS (PARTITION BY party)),
g2 AS {_orthogonal('f', 1, 'q2', 'm')}, g3 AS {_orthogonal('a', 2, 'q3', 'g2')}, g4 AS {_orthogonal('b', 3, 'q4', 'g3')}, g5 AS {_orthogonal('c', 4, 'q5', 'g4')},
e AS (SELECT count(*) AS n, ({_along('d', 'y', (3, 4, 5))}) / ({_along('d', 'd', (3, 4, 5))}) AS beta,
  (({_along('d', 'd', (3, 4, 5))}) / 3) / ((sum(d * d) - ({_along('d', 'd', (1, 2, 3, 4, 5))})) / (count(*) - 6)) AS f FROM g5),
w AS (SELECT any_value(n) AS n, any_value(beta) AS beta, any_value(e.f) AS first_f, sum(q2 * (y - beta * d)) / sum(q2 * q2) AS fam, sum(q1 * (y - beta * d)) / sum(q1 * q1) AS lag0, sum(g5.f * q1) / sum(q1 * q1) AS slope FROM g5, e)
SELECT n, round(beta, 4) AS beta, round(lag0 - fam * slope, 4) AS lag, round(fam, 4) AS fam, round(first_f, 4) AS first_stage_f FROM w""")
def iv_over_identified(spark: SparkSession, d: str) -> DataFrame:
    fit = E.fit_spec(supply(spark, d), "ideal_lag_family", "IV", Z)
    return _row(spark, n=fit.n, beta=round(fit["d"], 4), lag=round(fit["lag"], 4), fam=round(fit["fam"], 4), first_stage_f=round(fit.first_stage_f, 4))


@query(f"""WITH {P.CHAIN[5:]}, o AS (SELECT *, round(1 - sum(share) OVER (PARTITION BY market, year), 9) AS outside FROM products),
l AS (SELECT ln(share) - ln(outside) AS delta, x1, x1 + x2 AS z FROM o WHERE share > 0 AND outside > 0 AND x1 IS NOT NULL),
m AS (SELECT delta - avg(delta) OVER () AS y, x1 - avg(x1) OVER () AS x, z - avg(z) OVER () AS z FROM l)
SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 5) AS ols, round(sum(z * y) / sum(z * x), 4) AS iv FROM m""")
def logit_delta_iv(spark: SparkSession, d: str) -> DataFrame:
    """The plain logit: log share less log outside share on a characteristic, by least squares and with an instrument."""
    rows = P.products(spark, d).withColumn("outside", F.round(1 - W.group_total("share", ["market", "year"]), 9))
    rows = rows.withColumn("delta", E.logit_delta("share", "outside")).withColumns({"one": F.lit(1.0), "z": F.col("x1") + F.col("x2")}).dropna(subset=["delta", "x1"])
    ols, iv = E.ols(rows, "delta", ["one", "x1"]), E.iv(rows, "delta", "x1", ["one"], ["z"])
    return _row(spark, n=ols.n, ols=round(ols["x1"], 5), iv=round(iv["x1"], 4))


@query(f"""WITH {P.CHAIN[5:]} SELECT market, year, party, round(-2.5 * share * (1 - share), 10) AS own FROM products""")
def own_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return P.products(spark, d).select("market", "year", "party", F.round(E.logit_own_derivative(-2.5, "share"), 10).alias("own"))


@query()
def spec_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Two samples, two dimensions, seven specifications, two methods."""
    from psephos.operators.windows import ever_reaches

    panels = {name: supply(spark, d, dim).cache() for name, dim in (("econ", "x"), ("cult", "x2"))}  # small: a row for each party and election
    large = {k: p.withColumn("_keep", ever_reaches("d", ["party"], 0.12)).where("_keep").drop("_keep") for k, p in panels.items()}
    out = E.sweep({"all": panels, "ever_large": large}, Z)
    for p in panels.values():
        p.unpersist()
    return spark.createDataFrame(out)


@query(f"""WITH {SUPPLY[5:]}, r AS (SELECT * FROM full_panel WHERE isfinite(x) AND isfinite(d) AND isfinite(lagx) AND isfinite(z1) AND isfinite(z2) AND isfinite(z3)),
m AS (SELECT x - avg(x) OVER p AS y, d - avg(d) OVER p AS d, lagx - avg(lagx) OVER p AS l FROM r WINDOW p AS (PARTITION BY party)),
s AS (SELECT count(*) AS n, sum(l * l) AS ll, sum(l * d) AS ld, sum(d * d) AS dd, sum(l * y) AS ly, sum(d * y) AS dy, sum(l * l) * sum(d * d) - pow(sum(l * d), 2) AS det FROM m),
b AS (SELECT *, (dd * ly - ld * dy) / det AS rho, (ll * dy - ld * ly) / det AS beta FROM s),
u AS (SELECT (dd * l - ld * m.d) / det * (y - rho * l - beta * m.d) AS ul, (ll * m.d - ld * l) / det * (y - rho * l - beta * m.d) AS ud FROM m, b),
v AS (SELECT any_value(n) / (any_value(n) - 2.0) * sum(ul * ul) AS vll, any_value(n) / (any_value(n) - 2.0) * sum(ul * ud) AS vld, any_value(n) / (any_value(n) - 2.0) * sum(ud * ud) AS vdd FROM u, b),
g AS (SELECT *, -1 / beta AS i1, -(1 - rho) / (beta * beta) AS i2, 1 / beta AS l1, -rho / (beta * beta) AS l2 FROM b, v)
SELECT n, round(beta, 5) AS beta, round(1 - rho, 5) AS rho_ideal, round(rho, 5) AS rho_lag, round((1 - rho) / beta, 4) AS kappa_ideal, round(rho / beta, 4) AS kappa_lag,
  round(sqrt(i1 * i1 * vll + 2 * i1 * i2 * vld + i2 * i2 * vdd), 4) AS se_kappa_ideal, round(sqrt(l1 * l1 * vll + 2 * l1 * l2 * vld + l2 * l2 * vdd), 4) AS se_kappa_lag FROM g""")
def kappa_delta(spark: SparkSession, d: str) -> DataFrame:
    """Costs and their delta-method errors for one specification."""
    fit = E.fit_spec(supply(spark, d), "ideal_lag", "OLS", Z)
    found = E.kappas("ideal_lag", fit["d"], fit["lag"]) | E.delta_errors("ideal_lag", fit)
    shown = {k: round(found[k], 5 if k.startswith("rho") else 4) for k in ("rho_ideal", "rho_lag", "kappa_ideal", "kappa_lag", "se_kappa_ideal", "se_kappa_lag")}
    return _row(spark, n=fit.n, beta=round(fit["d"], 5), **shown)


@query(f"""WITH {P.CHAIN[5:]}, z AS (SELECT 1.0::DOUBLE AS q1, share, 2 * share AS twice, x1, x2 FROM products WHERE isfinite(share) AND isfinite(x1) AND isfinite(x2)),
g2 AS {_orthogonal('share', 1, 'q2', 'z')}, g3 AS {_orthogonal('twice', 2, 'q3', 'g2')}, g4 AS {_orthogonal('x1', 2, 'q4', 'g3')}, g5 AS {_orthogonal('x2', (1, 2, 4), 'q5', 'g4')},
left_over AS (SELECT 1 AS k, 'one' AS name, 1.0 AS part FROM g5 UNION SELECT 2, 'share', sqrt(sum(q2 * q2) / sum(share * share)) FROM g5 UNION SELECT 3, 'twice', sqrt(sum(q3 * q3) / sum(twice * twice)) FROM g5
  UNION SELECT 4, 'x1', sqrt(sum(q4 * q4) / sum(x1 * x1)) FROM g5 UNION SELECT 5, 'x2', sqrt(sum(q5 * q5) / sum(x2 * x2)) FROM g5)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS place, name FROM left_over WHERE part > 1e-6""")
def collinear_prune(spark: SparkSession, d: str) -> DataFrame:
    """Columns left after dropping combinations of earlier ones."""
    rows = P.products(spark, d).withColumn("twice", 2 * F.col("share")).withColumn("one", F.lit(1.0))
    kept = E.keep_independent(rows, ["one", "share", "twice", "x1", "x2"])
    return spark.createDataFrame([(k, n) for k, n in enumerate(kept)], "place int, name string")


@query(f"""WITH {P.CHAIN[5:]}, z AS (SELECT share * 10 AS age, x2 * 20 AS gender, x1, x2, 3 * x1 AS x3 FROM products WHERE isfinite(x1) AND isfinite(x2) AND isfinite(share))
SELECT CAST(place AS INT) AS place, name, round(total, 8) AS total FROM (
  SELECT 0 AS place, 'const' AS name, sum(1.0) AS total FROM z UNION ALL SELECT 1, 'x1', sum(x1) FROM z UNION ALL SELECT 2, 'x2', sum(x2) FROM z
  UNION ALL SELECT 3, 'ageX_x1', sum(age * x1) FROM z UNION ALL SELECT 4, 'ageX_x2', sum(age * x2) FROM z
  UNION ALL SELECT 5, 'genderX_x1', sum(gender * x1) FROM z UNION ALL SELECT 6, 'genderX_x2', sum(gender * x2) FROM z)""")
def demand_instruments(spark: SparkSession, d: str) -> DataFrame:
    """The instruments of demand that are not combinations of earlier ones, and their sums."""
    rows = P.products(spark, d).select((F.col("share") * 10).alias("age"), (F.col("x2") * 20).alias("gender"), "x1", "x2", (3 * F.col("x1")).alias("x3"))
    made, names = E.demand_instruments(rows, ["x1", "x2", "x3"], "age", "gender")
    sums = made.agg(*(F.sum(f"demand_instruments{k}").alias(str(k)) for k in range(len(names))))
    pairs = ", ".join(f"{k}, '{n}', `{k}`" for k, n in enumerate(names))
    return sums.selectExpr(f"stack({len(names)}, {pairs}) AS (place, name, total)").withColumn("total", F.round("total", 8))


@query()
def demand_random_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Two-step GMM of a random-coefficients logit on all markets: deltas by contraction in each market's own task."""
    rows = P.products(spark, d).where("x1 IS NOT NULL").withColumn("id", F.concat_ws("|", "market", F.col("year").cast("string")))
    shares = W.rescaled("s", ["id"], 0.95)
    rows = rows.withColumn("s", F.col("share")).select(F.col("id").alias("market"), F.col("party").alias("product"), shares.alias("share"), F.lit(1.0).alias("one"), (F.col("x1") * 10).alias("x"), (F.col("x2") * 10).alias("z"))
    rows = rows.withColumns({"zz": F.col("z") ** 2, "xz": F.col("x") * F.col("z")})  # four parameters need as many instruments
    people = respondents(spark, d).withColumn("market", F.concat_ws("|", "market", F.col("year").cast("string")))
    agents = weighted_resample(people.select("market", "rid", "w", (F.col("balance") / 10000).alias("income")), "market", "rid", "w", 200).select("market", F.col("agent_ids").alias("agent"), "income")
    model = E.Demand(linear=["one", "x"], random=["x"], demographics=["income"], instruments=["one", "x", "z", "zz", "xz"], nodes=200, tolerance=1e-9)
    rows, agents = rows.cache(), agents.cache()  # small: some rows and 200 agents a market
    fit = model.fit(rows, agents, np.array([0.5, 0.1]))
    rows.unpersist()
    agents.unpersist()
    sigma, pi, beta = (np.ravel(fit[k]).tolist() for k in ("sigma", "pi", "beta"))
    return _row(spark, sigma=round(sigma[0], 4), pi=round(pi[0], 4), constant=round(beta[0], 4), slope=round(beta[1], 4), objective=round(fit["objective"], 4), converged=fit["converged"], unsolved=fit["unsolved"])


def demand_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Products with positions, their leaders' age and gender and instruments; agents with three demographics; the instruments."""
    with ThreadPoolExecutor(1) as beside:  # neither side waits for the other's jobs
        agents = beside.submit(_demand_agents, spark, d)
        rows, instruments = _demand_products(spark, d)
        return rows, agents.result(), instruments


def _demand_products(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    building = (F.col("segment") == "BUILDING").cast("double")
    rows = P.voters(spark, d).withColumns({"_age": F.col("balance") / 1000, "_gender": building})
    rows = rows.groupBy("market", "year", "country", "party").agg(
        F.sum("w").alias("w"), *(wmean(c, "w").alias(n) for c, n in (("x1", "x1"), ("x2", "x2"), ("_age", "age"), ("_gender", "gender"))), F.max("family").alias("family")
    )
    rows = once(rows)  # a row for each party and market: all that follows reads these, several times
    rows = rows.withColumn("share", W.share("w", ["market", "year"], "party")).dropna(subset=["party", "x1", "x2"])
    for c, n in (("x1", "econ"), ("x2", "cult")):
        rows = W.standardised(rows, c, n)
    families = rows.groupBy("family", "year", "country").agg(*(wmean(n, "share").alias(f"m_{n}") for n in ("econ", "cult")))
    families = families.select("family", "year", "country", *(W.leave_one_out(f"m_{n}", ["family", "year"]).alias(f"lo_{n}") for n in ("econ", "cult")))
    families = families.withColumns({f"lo_{n}2": F.col(f"lo_{n}") ** 2 / 100 for n in ("econ", "cult")})
    base = ["lo_econ", "lo_econ2", "lo_cult", "lo_cult2"]
    rows = rows.join(families, ["family", "year", "country"]).dropna(subset=base)
    rows = rows.withColumn("id", F.concat_ws("|", "market", F.col("year").cast("string")))
    rows = rows.select(F.col("id").alias("market"), F.col("party").alias("product"), W.rescaled("share", ["id"], 0.95).alias("share"), F.lit(1.0).alias("one"), F.lit(0.0).alias("prices"), "age", "gender", "econ", "cult", *base)
    rows, kept = E.demand_instruments(rows, base, "age", "gender")
    return rows, [f"demand_instruments{k}" for k in range(len(kept))]


def _demand_agents(spark: SparkSession, d: str) -> DataFrame:
    people = respondents(spark, d).withColumn("market", F.concat_ws("|", "market", F.col("year").cast("string")))
    groups = {"college": F.col("segment").isin("BUILDING", "MACHINERY"), "young": F.col("balance") < 1000, "old": F.col("balance") > 7000}
    people = people.select("market", "rid", "w", *(c.cast("double").alias(n) for n, c in groups.items()))
    return weighted_resample(people, "market", "rid", "w", 200).select("market", F.col("agent_ids").alias("agent"), *groups)


@query()
def demand_full_model(spark: SparkSession, d: str) -> DataFrame:
    """Demand with two random positions and three demographics, prices fixed at 0: a row for each parameter."""
    rows, agents, instruments = demand_inputs(spark, d)
    linear, random, people = ["one", "prices", "age", "gender", "econ", "cult"], ["econ", "cult"], ["college", "young", "old"]
    model = E.Demand(linear, random, people, instruments, nodes=200, tolerance=1e-10, fixed={"prices": 0.0}, robust=False)
    fit = model.fit(rows, agents, np.concatenate([np.full(2, 0.5), np.full(6, 1e-4)]))
    names = [f"sigma_{r}" for r in random] + [f"pi_{r}_{c}" for r in random for c in people] + [f"beta_{n}" for n in linear]
    values = [np.concatenate([np.ravel(fit[k]) for k in keys]) for keys in (("sigma", "pi", "beta"), ("sigma_se", "pi_se", "beta_se"))]
    out = [(n, round(float(x), 3), round(float(se), 3) if np.isfinite(se) else None, E.stars(E.normal_p(x / se)) if se > 0 else "", bool(fit["converged"]), int(fit["unsolved"]), int(fit["n"])) for n, x, se in zip(names, *values, strict=True)]
    return spark.createDataFrame(out, "parameter string, estimate double, error double, stars string, converged boolean, unsolved long, n long")


@query(f"""WITH {RESPONDENTS}, s AS (SELECT country, year, avg(w) AS m, stddev_pop(w) / sqrt(count(*)) AS se FROM respondents GROUP BY 1, 2)
SELECT country, year, round(m / se, 4) AS t, CASE WHEN m / se > 2.5758293 THEN '***' WHEN m / se > 1.959964 THEN '**' WHEN m / se > 1.6448536 THEN '*' ELSE '' END AS stars FROM s""")
def significance_stars(spark: SparkSession, d: str) -> DataFrame:
    rows = respondents(spark, d).groupBy("country", "year").agg((F.avg("w") / (F.stddev_pop("w") / F.sqrt(F.count("*")))).alias("t"))
    return rows.select("country", "year", F.round("t", 4).alias("t"), stars(p_value("t")).alias("stars"))


def _draws_sql(weight: str) -> str:
    """200 draws for each market: the row whose interval of cumulated weight holds the draw's uniform number."""
    return f"""WITH {RESPONDENTS}, v AS (SELECT market, rid, w, {weight} AS v, CAST('0x' || substr(md5(CAST(rid AS VARCHAR)), 1, 4) AS BIGINT) % {PARTS} AS part FROM respondents),
c AS (SELECT *, sum(v) OVER (PARTITION BY market ORDER BY part, rid, v ROWS UNBOUNDED PRECEDING) AS upto, sum(v) OVER (PARTITION BY market) AS whole FROM v WHERE v > 0),
u AS (SELECT market, CAST(k AS INT) AS agent_ids, CAST('0x' || substr(md5('20260307|' || market || '|' || CAST(k AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT market FROM c), range(1, 201) AS r(k)),
drawn AS (SELECT c.*, agent_ids FROM c JOIN u ON c.market = u.market AND u * whole >= upto - v AND u * whole < upto)"""


@query(f"""{_draws_sql('CASE WHEN x1 > 0.03 THEN w ELSE 0.0 END')}
SELECT market, count(*) AS draws, min(agent_ids) AS first_agent, max(agent_ids) AS last_agent, bool_and(v > 0) AS all_valid, count(DISTINCT rid) AS n_rows, sum(w) AS weight FROM drawn GROUP BY market""")
def weighted_resample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 200 draws for each market, none of a row without weight."""
    rows = respondents(spark, d).withColumn("v", F.when(F.col("x1") > 0.03, F.col("w")).otherwise(0.0))
    drawn = weighted_resample(rows.select("market", "rid", "w", "v"), "market", "rid", "v")
    return drawn.groupBy("market").agg(F.count("*").alias("draws"), F.min("agent_ids").alias("first_agent"), F.max("agent_ids").alias("last_agent"), F.bool_and(F.col("v") > 0).alias("all_valid"), F.countDistinct("rid").alias("n_rows"), F.sum("w").alias("weight"))


@query(f"{_draws_sql('w')} SELECT market, rid, w, agent_ids FROM drawn")
def weighted_resample_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = respondents(spark, d).select("market", "rid", "w")
    return weighted_resample(rows, "market", "rid", "w")


_RAW = """{"output": [{"type": "web_search_call", "action": {"sources": [{"title": "S%d", "url": "https://www.osce.org/%d/"}]}}, {"type": "message", "content": [{"type": "output_text", "text": "{}",
 "annotations": [{"type": "url_citation", "url": "https://en.wikipedia.org/wiki/P%d", "title": "P"}]}]}], "usage": {"input_tokens": %d, "output_tokens": 5, "total_tokens": 9}}"""


def raw_answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.format_string(_RAW, k, k % 3, k % 2, k)
    model = F.array(
        F.struct(F.lit("Party page").alias("title"), F.format_string("https://party%d.example/?utm_source=a", k % 4).alias("url"), F.lit("").alias("publisher"), F.lit("official website").alias("why_relevant")),
        F.struct(F.lit("").alias("title"), F.format_string("http://en.wikipedia.org/wiki/P%d", k % 2).alias("url"), F.lit("").alias("publisher"), F.lit("context").alias("why_relevant")),
    )
    # few bytes become much work here: the rows are dealt out, so that a file of one row group is not one task's
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, d, "events").select("event_id").repartition(parts).select("event_id", raw.alias("raw"), model.alias("model"))


@query("SELECT event_id, event_id AS usage_input_tokens, CAST(5 AS BIGINT) AS usage_output_tokens, CAST(9 AS BIGINT) AS usage_total_tokens, CAST(1 AS INT) AS web_search_calls FROM events")
def usage_flatten(spark: SparkSession, d: str) -> DataFrame:
    return raw_answers(spark, d).select("event_id", *X.usage_columns("raw")).drop("usage_cached_tokens", "usage_reasoning_tokens")


@query("""SELECT event_id, CAST(2 AS INT) AS n, 'https://www.osce.org/' || CAST(event_id % 3 AS VARCHAR) || '/' AS first_url FROM events""")
def sources_walk(spark: SparkSession, d: str) -> DataFrame:
    """Sources anywhere in an answer's tree."""
    found = raw_answers(spark, d).select("event_id", S.sources_in("raw").alias("s"))
    return found.select("event_id", F.size("s").alias("n"), F.get("s", F.lit(0))["url"].alias("first_url"))


@query("""SELECT event_id, CAST(4 AS INT) AS source_count, 'https://party' || CAST(event_id % 4 AS VARCHAR) || '.example' AS source_1_url, 'official_party_source' AS source_1_tag, CAST(1 AS INT) AS official_count, CAST(1 AS INT) AS reference_count, CAST(2 AS INT) AS non_wiki_count,
  'encyclopedia:2; intergovernmental_reference:1; official_party_source:1' AS quality_summary FROM events""")
def sources_merge(spark: SparkSession, d: str) -> DataFrame:
    """A model's sources and those of its searches, merged, graded, the best four as columns."""
    rows = raw_answers(spark, d).select("event_id", S.effective_sources(F.col("model"), S.sources_in("raw")).alias("s"))
    out = rows.select("event_id", *S.spread(F.col("s")))
    return out.select("event_id", "source_count", "source_1_url", "source_1_tag", "official_count", "reference_count", "non_wiki_count", "quality_summary")


@query("""SELECT lower(text) AS k, count(*) AS n FROM (SELECT DISTINCT page_id % 50 AS g, lower(split_part(url, '/', 3)) AS text FROM pages) GROUP BY 1""")
def sources_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select((F.col("page_id") % 50).alias("g"), "page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.lit("").alias("title"))
    return S.deduplicated(rows, "g", "page_id", "host", "title").groupBy(F.lower("host").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS target_id, CASE WHEN c_custkey % 3 = 0 THEN 'ok' WHEN c_custkey % 3 = 1 THEN 'no_output_text' ELSE 'invalid_json' END AS status, CAST(1 AS INT) AS tries FROM customer
WHERE c_custkey % 5 <> 0""")
def enrichment_resume(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers are replayed for what has no good answer yet."""
    k = F.col("target_id").cast("bigint")
    targets = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("target_id"))
    done = targets.where(k % 5 == 0).withColumn("status", F.lit("ok"))
    known = targets.where(k % 3 != 1).withColumn("answer", F.when(k % 3 == 0, '{"resolved": true}').otherwise("{broken}"))
    return collect(targets.join(known, "target_id", "left"), recorded, done).select("target_id", "status", "tries")


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS code, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders""")
def stage_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Types as a stage file has them: numbers as doubles, texts of numbers too, missing texts empty."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), (F.col("o_orderkey") % 7).cast("string").alias("code"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority")).alias("priority"))
    return stage_types(rows)

"""Registered queries: entity tables, deduplication, joins, sets and candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.functions.nulls import truthy
from psephos.functions.text import election_key, joined_key, norm_name, party_label
from psephos.operators import aggregates as A
from psephos.operators import joins as J
from psephos.operators import windows as W
from psephos.operators.similarity import once
from psephos.plans.base import RESPONDENTS, respondents, table
from psephos.plans.registry import query

GENERIC = "('alliance', 'coalition', 'list', 'independent', 'others', 'other', 'party', 'movement', 'front')"
#: A name for each respondent's party, now and then missing or generic.
NAMED = f"""WITH {RESPONDENTS}, named AS (
  SELECT respondents.*, CASE WHEN partkey % 11 = 0 THEN NULL WHEN partkey % 13 = 0 THEN 'List' ELSE p_name END AS name FROM respondents JOIN part ON partkey = p_partkey)"""


def named(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name")
    name = F.when(F.col("partkey") % 11 == 0, F.lit(None)).when(F.col("partkey") % 13 == 0, "List").otherwise(F.col("p_name"))
    return respondents(spark, d).join(parts, "partkey").withColumn("name", name).drop("p_name")


@query(f"""{NAMED} SELECT party, year, arg_min(name, (lower(name) IN {GENERIC}, -length(name), lower(name), name)) FILTER (name IS NOT NULL) AS name FROM named
WHERE party IS NOT NULL GROUP BY 1, 2""")
def canonical_name(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).dropna(subset=["party"]).groupBy("party", "year").agg(A.canonical_name("name").alias("name"))


@query(f"""{NAMED} SELECT suppkey, string_agg(DISTINCT name, ' || ' ORDER BY name) AS aliases, count(DISTINCT name) AS n_names FROM named GROUP BY 1""")
def alias_lists(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).groupBy("suppkey").agg(A.alias_list("name").alias("aliases"), F.countDistinct("name").alias("n_names"))


@query(f"""{NAMED}, g AS (
  SELECT country, year, party, count(*) AS n, sum(w) AS weight, count(DISTINCT market) AS n_markets, min(day) AS first_day, arg_min(name, rid) FILTER (name IS NOT NULL) AS first_name,
    max(vote = 'A') AS any_a, count(x1) AS n_x1 FROM named GROUP BY 1, 2, 3)
SELECT country, year, party, n, round(weight, 2) AS weight, n_markets, CAST(first_day AS VARCHAR) AS first_day, first_name, any_a, n_x1,
  'pe' || lpad(CAST(row_number() OVER (ORDER BY country, year, party NULLS LAST) AS VARCHAR), 6, '0') AS entity_id FROM g""")
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each entity (missing keys are one), with consecutive ids over the rolled-up table."""
    g = named(spark, d).groupBy("country", "year", "party").agg(
        F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("weight"), F.countDistinct("market").alias("n_markets"), F.min("day").cast("string").alias("first_day"),
        A.first_known("name", "rid").alias("first_name"), F.bool_or(F.col("vote") == "A").alias("any_a"), F.count("x1").alias("n_x1"),
    )
    return W.numbered(g, ["country", "year", F.col("party").isNull(), "party"], "entity_id", "pe%06d")


@query(f"""WITH {RESPONDENTS}, k AS (SELECT DISTINCT lower(substring(replace(market, ' ', ''), 1, 4)) || CAST(year AS VARCHAR) AS election, country || '|' || CAST(day AS VARCHAR) || '|' || coalesce(CAST(party AS VARCHAR), '') AS stable_key FROM respondents)
SELECT election, stable_key FROM k""")
def stable_key_ids(spark: SparkSession, d: str) -> DataFrame:
    return respondents(spark, d).select(election_key("market", "year").alias("election"), joined_key("country", F.col("day").cast("string"), "party").alias("stable_key")).distinct()


@query(f"""{NAMED} SELECT suppkey, year, arg_min(name, rid) FILTER (name IS NOT NULL) AS first_name, arg_min(x1, rid) FILTER (x1 IS NOT NULL) AS first_x1, max(w) AS top, sum(w) AS total
FROM named GROUP BY 1, 2""")
def chunked_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """The first known value in row order, sum and maximum: partial aggregates do what merging chunks did."""
    return named(spark, d).groupBy("suppkey", "year").agg(A.first_known("name", "rid").alias("first_name"), A.first_known("x1", "rid").alias("first_x1"), F.max("w").alias("top"), F.sum("w").alias("total"))


@query(f"""{NAMED}, b AS (SELECT *, CASE WHEN partkey % 17 = 0 THEN '  ' ELSE name END AS label FROM named)
SELECT suppkey, year, coalesce(arg_min(trim(label), rid) FILTER (trim(label) <> ''), '') AS first_label FROM b GROUP BY 1, 2""")
def first_nonempty_label(spark: SparkSession, d: str) -> DataFrame:
    """The first text in row order that is not blank."""
    rows = named(spark, d).withColumn("label", F.when(F.col("partkey") % 17 == 0, "  ").otherwise(F.col("name")))
    return rows.groupBy("suppkey", "year").agg(A.first_nonempty("label", "rid").alias("first_label"))


@query(f"""{NAMED}, c AS (SELECT country, year, day, count(*) AS n FROM named GROUP BY 1, 2, 3), m AS (SELECT country, year, arg_max(day, (n, day)) AS mode_day FROM c GROUP BY 1, 2)
SELECT country, year, CAST(mode_day AS VARCHAR) AS mode_day FROM m""")
def latest_mode_fill(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_mode(named(spark, d), ["country", "year"], "day", "mode_day").withColumn("mode_day", F.col("mode_day").cast("string"))


@query(f"""{NAMED}, f AS (SELECT name, min(rid) AS first FROM named WHERE name IS NOT NULL GROUP BY 1), k AS (SELECT name, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT coalesce(code, -1) AS code, n.name, count(*) AS n FROM named n LEFT JOIN k ON n.name = k.name GROUP BY 1, 2""")
def factorize_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = W.first_seen_codes(named(spark, d).select("name", "rid"), "name", "rid", "code")
    return rows.groupBy(F.col("code").cast("bigint").alias("code"), "name").agg(F.count("*").alias("n"))


@query(f"""{NAMED} SELECT market, party, rid, w FROM (SELECT *, row_number() OVER (PARTITION BY market, party ORDER BY rid) AS k FROM named) WHERE k = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return A.keep_first(named(spark, d), ["market", "party"], ["rid"]).select("market", "party", "rid", "w")


@query(f"""{NAMED} SELECT suppkey, partkey, any_value(rid) AS rid FROM named GROUP BY 1, 2 HAVING count(*) = 1""")
def unique_key_only(spark: SparkSession, d: str) -> DataFrame:
    return A.unique_rows(named(spark, d), ["suppkey", "partkey"]).select("suppkey", "partkey", "rid")


@query(f"""{NAMED} SELECT party, count(*) AS n, round(avg(x1), 10) AS mean_x1, median(w) AS median_w FROM named GROUP BY 1""")
def value_counts_nulls(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).groupBy("party").agg(F.count("*").alias("n"), F.round(F.avg("x1"), 10).alias("mean_x1"), F.median("w").alias("median_w")).orderBy(F.desc("n"))


@query("""SELECT o_orderkey AS orderkey, c_name AS name, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def join_validate_m1(spark: SparkSession, d: str) -> DataFrame:
    """A left join whose right side is shown to be unique, inside the plan."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("key"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"))
    out = J.guarded_join(J.guarded_join(orders, customers, ["key"], null_safe=False), nations, ["n"], null_safe=False)
    return out.select("orderkey", "name", "nation")


@query(f"""WITH {RESPONDENTS}, l AS (SELECT party, year, sum(w) AS w FROM respondents GROUP BY 1, 2), r AS (SELECT party, count(*) AS n FROM respondents WHERE party IS NULL OR party < 4 GROUP BY 1)
SELECT l.party, year, round(w, 2) AS w, n FROM l LEFT JOIN r ON l.party IS NOT DISTINCT FROM r.party""")
def join_nullsafe_keys(spark: SparkSession, d: str) -> DataFrame:
    """Missing keys match missing keys."""
    rows = respondents(spark, d)
    left = rows.groupBy("party", "year").agg(F.round(F.sum("w"), 2).alias("w"))
    right = rows.where("party IS NULL OR party < 4").groupBy("party").agg(F.count("*").alias("n"))
    return J.guarded_join(left, right, ["party"])


@query("""SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)""")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    rows = table(spark, d, "orders").join(keep, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return rows.select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))


@query("""SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def join_anti_resume(spark: SparkSession, d: str) -> DataFrame:
    """What has no finished result yet."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return J.resume(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), done, "custkey")


@query("""WITH old AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), new AS (SELECT c_custkey AS id, c_acctbal + 1 AS v, 'patched' AS note FROM customer WHERE c_acctbal < 0)
SELECT id, v, CAST(NULL AS VARCHAR) AS note FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, v, note FROM new""")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = rows.where("v < 0").select("id", (F.col("v") + 1).alias("v"), F.lit("patched").alias("note"))
    return J.upsert(rows, new, "id")


@query("""SELECT c_custkey AS id, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS name FROM customer
UNION ALL SELECT s_suppkey, CAST(NULL AS DOUBLE), s_name FROM supplier""")
def union_widen(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query(f"""WITH {RESPONDENTS}, a AS (SELECT DISTINCT market, year, suppkey FROM respondents WHERE vote = 'N'), b AS (SELECT DISTINCT market, year, suppkey FROM respondents WHERE vote <> 'N')
SELECT 'first_only' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_difference_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = respondents(spark, d)
    a, b = (rows.where(test).select("market", "year", "suppkey") for test in ("vote = 'N'", "vote <> 'N'"))
    sides = (("first_only", a, b), ("second_only", b, a))
    out = [x.subtract(y).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n") for name, x, y in sides]
    return out[0].unionByName(out[1])


@query(f"""{NAMED}, g AS (SELECT country, year, suppkey, sum(w) AS w, any_value(s_name) AS name FROM named JOIN supplier ON suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT country, year, suppkey, row_number() OVER (PARTITION BY country, year ORDER BY w DESC NULLS LAST, suppkey) AS rank_by_share, 'S' || CAST(suppkey AS VARCHAR) || ', ' || name AS label FROM g""")
def candidate_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = J.ranked_candidates(_candidates(spark, d), ["country", "year"], _by_weight())
    return ranked.select("country", "year", "suppkey", F.col("rank_by_share").cast("bigint").alias("rank_by_share"), "label")


def _by_weight() -> list[Column]:
    return [F.col("w").desc_nulls_last(), F.col("suppkey")]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"))
    g = respondents(spark, d).groupBy("country", "year", "suppkey").agg(F.sum("w").alias("w")).join(names, "suppkey")
    return g.withColumn("label", party_label(F.concat(F.lit("S"), F.col("suppkey").cast("string")), "name"))


@query(f"""WITH {RESPONDENTS}, g AS (SELECT country, year, suppkey, sum(w) AS w FROM respondents GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY country, year ORDER BY w DESC NULLS LAST, suppkey) AS k FROM g)
SELECT country, year, count(*) AS n, string_agg(CAST(suppkey AS VARCHAR), '|' ORDER BY k) FILTER (k <= 5) AS top_ids FROM r GROUP BY 1, 2""")
def candidate_json(spark: SparkSession, d: str) -> DataFrame:
    """The first five candidates as a list in rank order (also as JSON), their ids, and how many candidates there are."""
    out = J.top_candidates(_candidates(spark, d), ["country", "year"], _by_weight(), ["suppkey", "w"], "suppkey")
    return out.select("country", "year", "n", "top_ids")


#: Targets and an old list of entities with differing spellings, shares and some repeated keys.
MATCH = f"""WITH {RESPONDENTS}, t AS (
  SELECT country, year, suppkey AS id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS eng, CASE WHEN suppkey % 3 = 0 THEN 'local ' || CAST(suppkey AS VARCHAR) ELSE '' END AS loc, round(sum(w) / 1000, 3) AS share
  FROM respondents JOIN supplier ON suppkey = s_suppkey GROUP BY country, year, suppkey, s_name),
old AS (
  SELECT country, year, id AS old_id, CASE WHEN id % 5 = 0 THEN 'other name' ELSE eng END AS eng, loc, CASE WHEN id % 4 = 0 THEN share + 1 ELSE share END AS share FROM t WHERE id % 7 <> 3)"""
PASSES = [
    ("exact_eng_share", ["country", "year", "eng", "share"], ["country", "year", "eng", "share"]),
    ("exact_local_share", ["country", "year", "loc", "share"], ["country", "year", "loc", "share"]),
    ("exact_eng", ["country", "year", "eng"], ["country", "year", "eng"]),
    ("exact_local", ["country", "year", "loc"], ["country", "year", "loc"]),
]


def match_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _match_targets(spark, d)
    return t, _old_list(t)


def _match_targets(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name")
    t = respondents(spark, d).join(names, "suppkey").groupBy("country", "year", F.col("suppkey").alias("id"), "s_name").agg(F.round(F.sum("w") / 1000, 3).alias("share"))
    return t.withColumn("eng", norm_name("s_name")).withColumn("loc", F.when(F.col("id") % 3 == 0, F.concat(F.lit("local "), F.col("id").cast("string"))).otherwise("")).drop("s_name")


def _old_list(t: DataFrame) -> DataFrame:
    return t.where("id % 7 <> 3").select(
        "country", "year", F.col("id").alias("old_id"), F.when(F.col("id") % 5 == 0, "other name").otherwise(F.col("eng")).alias("eng"), "loc",
        F.when(F.col("id") % 4 == 0, F.col("share") + 1).otherwise(F.col("share")).alias("share"),
    )


def _pass_sql(k: int, keys: list[str]) -> str:
    on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM p{k}.{c}" for c in keys)
    return f"LEFT JOIN (SELECT {', '.join(keys)}, min(old_id) AS old_id FROM old GROUP BY {', '.join(keys)} HAVING count(*) = 1) p{k} ON {on}"


@query(f"""{MATCH} SELECT t.country, t.year, t.id, coalesce(p0.old_id, p1.old_id, p2.old_id, p3.old_id) AS old_id,
  CASE WHEN p0.old_id IS NOT NULL THEN 'exact_eng_share' WHEN p1.old_id IS NOT NULL THEN 'exact_local_share' WHEN p2.old_id IS NOT NULL THEN 'exact_eng' WHEN p3.old_id IS NOT NULL THEN 'exact_local' END AS match_method,
  CASE WHEN coalesce(p0.old_id, p1.old_id, p2.old_id, p3.old_id) IS NOT NULL THEN 100.0::DOUBLE END AS match_score
FROM t {' '.join(_pass_sql(k, keys) for k, (_, keys, _) in enumerate(PASSES))}""")
def cascade_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Four exact passes over keys that are unique in the old list; the first hit wins."""
    t, old = match_sides(spark, d)
    out = J.cascade_match(t, old, PASSES, ["old_id"])
    return out.select("country", "year", "id", "old_id", "match_method", "match_score")


@query()
def fuzzy_block_match(spark: SparkSession, d: str) -> DataFrame:
    """The best fuzzy candidate in each block, by sequence similarity, with the margin rule."""
    return _fuzzy(spark, d, "ratio")


def _fuzzy(spark: SparkSession, d: str, kind: str) -> DataFrame:
    t = once(_match_targets(spark, d))  # a row for each block and supplier; line items are read once
    old = _old_list(t)
    t = t.withColumn("target", joined_key("country", "year", "id"))
    out = J.fuzzy_match(t, old, ["country", "year"], "target", "old_id", ("loc", "eng"), "share", kind)
    return out.select("country", "year", "id", "best_id", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), "accepted")


def _edit_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) ELSE 0.0 END"


_BOTH_T, _BOTH_O = "trim(concat_ws(' ', nullif(t.loc, ''), nullif(t.eng, '')))", "trim(concat_ws(' ', nullif(o.loc, ''), nullif(o.eng, '')))"
_PAIRS = (("t.loc", "o.loc"), ("t.eng", "o.eng"), (_BOTH_T, _BOTH_O), ("t.loc", "o.eng"), ("t.eng", "o.loc"))


@query(f"""{MATCH}, p AS (SELECT t.country, t.year, t.id, o.old_id, abs(t.share - o.share) AS gap, greatest({', '.join(_edit_sql(a, b) for a, b in _PAIRS)}) AS name
  FROM t JOIN old o USING (country, year)),
n AS (SELECT *, coalesce(gap <= 1.0, true) AS near, max(coalesce(gap <= 1.0, true)) OVER (PARTITION BY country, year, id) AS any_near FROM p),
s AS (SELECT *, name * 100 - coalesce(least(gap, 5.0), 0.0) AS score FROM n WHERE near OR NOT any_near),
k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY country, year, id ORDER BY score DESC, old_id))
SELECT country, year, id, old_id AS best_id, round(score, 6) AS score, round(second, 6) AS second, score >= 94 AND (second IS NULL OR score - second >= 5) AS accepted FROM k WHERE k = 1""")
def fuzzy_block_match_edit(spark: SparkSession, d: str) -> DataFrame:
    """The same with edit distance, which SQL has too."""
    return _fuzzy(spark, d, "edit")


PATCHES = [("1-URGENT", 10.0, 5), ("2-HIGH", 20.0, 77)]


@query("""SELECT o_orderkey AS orderkey, o_orderpriority AS priority, CASE WHEN o_orderkey = 5 THEN 10.0 WHEN o_orderkey = 77 THEN 20.0
  WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 10.0 WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 20.0 ELSE o_totalprice END AS price,
  o_orderkey IN (5, 77) OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P') AS patched FROM orders""")
def point_patch(spark: SparkSession, d: str) -> DataFrame:
    """Values overwritten by key, else by a fallback rule."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    patch = spark.createDataFrame([(k, p, "P", v) for p, v, k in PATCHES], "orderkey bigint, priority string, status string, price double")
    return J.point_patch(rows, patch, "orderkey", ["priority", "status"], ["price", "absent"]).drop("status")


@query(f"""WITH {RESPONDENTS}, m AS (SELECT market, year, count(*) AS n FROM respondents GROUP BY 1, 2), r AS (
  SELECT count(*) AS rows, count(DISTINCT market) AS markets, count(*) FILTER (party IS NULL) AS no_party, count(*) FILTER (x1 IS NULL) AS no_x1, sum(w) AS weight FROM respondents)
SELECT 'rows' AS metric, CAST(rows AS DOUBLE) AS value FROM r UNION ALL SELECT 'markets', markets FROM r UNION ALL SELECT 'no_party', no_party FROM r
UNION ALL SELECT 'no_x1', no_x1 FROM r UNION ALL SELECT 'weight', weight FROM r""")
def preflight_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of conditions in one pass, as tidy rows."""
    return A.checks(respondents(spark, d), [
        ("rows", F.count("*")), ("markets", F.countDistinct("market")), ("no_party", A.count_where(F.col("party").isNull())), ("no_x1", A.count_where(F.col("x1").isNull())),
        ("weight", F.sum("w")),
    ])


@query(f"""WITH {RESPONDENTS}, m AS (SELECT market, year, count(*) AS n FROM respondents GROUP BY 1, 2)
SELECT 'smallest_market' AS metric, CAST(min(n) AS DOUBLE) AS value FROM m UNION ALL SELECT 'largest_market', max(n) FROM m UNION ALL SELECT 'markets', count(*) FROM m""")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = respondents(spark, d).groupBy("market", "year").agg(F.count("*").alias("n"))
    return A.checks(sizes, [("smallest_market", F.min("n")), ("largest_market", F.max("n")), ("markets", F.count("*"))])


@query(f"""WITH {RESPONDENTS} SELECT market, rid, w, row_number() OVER (PARTITION BY market ORDER BY w DESC NULLS LAST, x1 DESC NULLS LAST, x2 NULLS LAST, rid) AS place FROM respondents
QUALIFY place <= 3""")
def ranked_top_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mixed directions with missing values last, the first three of each market."""
    w = Window.partitionBy("market").orderBy(F.col("w").desc_nulls_last(), F.col("x1").desc_nulls_last(), F.col("x2").asc_nulls_last(), "rid")
    return respondents(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 3").select("market", "rid", "w", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {RESPONDENTS} SELECT count(*) AS kept, count(*) FILTER (x1 IS NULL) AS kept_unknown FROM respondents WHERE NOT coalesce(vote = 'A' AND party IS NULL, false) AND NOT coalesce(x1 > 0.08, false)""")
def negated_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows are dropped only where the condition is known to hold."""
    rows = respondents(spark, d).where(~truthy((F.col("vote") == "A") & F.col("party").isNull()) & ~truthy(F.col("x1") > 0.08))
    return rows.agg(F.count("*").alias("kept"), A.count_where(F.col("x1").isNull()).alias("kept_unknown"))

"""Registered queries: texts, dates, demographics, web addresses, JSON records and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import countries as C
from psephos.functions import dates as D
from psephos.functions import jsonx as X
from psephos.functions import numeric as N
from psephos.functions import text as T
from psephos.functions import urls as U
from psephos.functions.nulls import clean_text, complete, first_number, first_text, to_num, truthy
from psephos.operators import rules as R
from psephos.plans.base import RESPONDENTS, respondents, table
from psephos.plans.registry import query
from psephos.sources.resolve import harmonised, with_columns_present

#: Invented texts by a number from 0 to 11, so that all branches of the text rules occur.
SAMPLES = [
    "Green  Party", "List", "other", "Ana / Bo", "M", "female leader", "male leader", "yes", "0", "Prime Minister", "nan", "Don't know",
]
_SQL_SAMPLES = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES) + "]"
TEXTS = f"t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE ({_SQL_SAMPLES})[CAST(o_orderkey % 13 AS INT) + 1] END AS x, o_orderkey % 13 AS k FROM orders)"


def texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 13).alias("k"))
    return rows.withColumn("x", F.get(F.array(*(F.lit(s) for s in SAMPLES)), F.col("k").cast("int")))


_CLEAN = "CASE WHEN lower(trim(coalesce(x, ''))) IN ('', 'nan', 'none', '<na>') THEN '' ELSE trim(coalesce(x, '')) END"
_NORM = "trim(regexp_replace(lower(regexp_replace(trim(coalesce(x, '')), '\\s+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query("""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain, trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents""")
def norm_name(spark: SparkSession, d: str) -> DataFrame:
    """Names without and with folded accents."""
    return table(spark, d, "documents").select("doc_id", T.norm_name("text").alias("plain"), T.match_name("text").alias("folded"))


@query(f"WITH {RESPONDENTS} SELECT DISTINCT market, year, lower(replace(substring(market, 1, 4) || CAST(year AS VARCHAR), ' ', '')) AS election FROM respondents")
def election_key(spark: SparkSession, d: str) -> DataFrame:
    return respondents(spark, d).select("market", "year").distinct().withColumn("election", T.election_key("market", "year"))


_PATTERN = "|".join(p.replace("'", "''") for p in T.NON_PARTY_PATTERNS)


@query(f"""WITH {TEXTS} SELECT id, {_CLEAN} <> '' AND regexp_matches(lower({_CLEAN}), '{_PATTERN}') AS non_party, {_NORM} IN ('independent', 'mixed vote', 'against all', 'nul') AS low_value,
  lower(regexp_replace(trim(coalesce(x, '')), '\\s+', ' ', 'g')) IN ('', 'alliance', 'coalition', 'list', 'independent', 'others', 'other', 'party', 'movement', 'front') AS generic FROM t""")
def generic_option_regex(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.is_non_party("x").alias("non_party"), T.is_low_value_label(T.norm_name("x")).alias("low_value"), T.is_generic_label("x").alias("generic"))


@query(f"WITH {TEXTS} SELECT id, lower({_CLEAN}) IN ('m/f', 'f/m') OR regexp_matches(lower({_CLEAN}), '[/;]| and | & ') AS several FROM t")
def multiperson_flag(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.several_persons("x").alias("several"))


@query(f"""WITH {TEXTS} SELECT id, {_CLEAN} <> '' AND (lower({_CLEAN}) IN ('?', 'many leader', 'chamber of deputies', 'l')
  OR NOT regexp_matches(lower({_CLEAN}), 'leader|lead candidate|candidate|president|prime minister|top candidate|chair')) AS unclear FROM t""")
def role_flag(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.unclear_role("x").alias("unclear"))


@query(f"""WITH {TEXTS}, g AS (SELECT id, CASE WHEN lower({_CLEAN}) IN ('m', 'male', 'man', 'masculine') THEN 1.0::DOUBLE WHEN lower({_CLEAN}) IN ('f', 'female', 'woman', 'feminine') THEN 0.0
  WHEN contains(lower({_CLEAN}), 'male') AND NOT contains(lower({_CLEAN}), 'female') THEN 1.0 END AS male1 FROM t) SELECT id, male1, 1 - male1 AS female1 FROM g""")
def gender_code(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.male1("x").alias("male1"), (1 - T.male1("x")).alias("female1"))


@query(f"WITH {TEXTS} SELECT id, CASE WHEN lower({_CLEAN}) IN ('true', '1', 'yes', 'y') THEN true WHEN lower({_CLEAN}) IN ('false', '0', 'no', 'n') THEN false END AS flag FROM t")
def bool_like(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.bool_like("x").alias("flag"))


@query(f"WITH {TEXTS} SELECT id, {_CLEAN} AS cleaned, CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} ELSE 'id ' || CAST(id AS VARCHAR) END AS shown, nullif(try_cast(x AS DOUBLE), 'nan'::DOUBLE) AS num FROM t")
def clean_and_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", clean_text("x").alias("cleaned"), first_text("x", F.concat(F.lit("id "), F.col("id").cast("string"))).alias("shown"), to_num("x").alias("num"))


@query(f"""WITH {TEXTS} SELECT id, CASE WHEN {_CLEAN} = '' THEN 'missing_display_name' WHEN {_NORM} IN ('independent', 'mixed vote', 'against all', 'nul') THEN 'low_value_ballot_option'
  WHEN regexp_matches(lower({_CLEAN}), '{_PATTERN}') THEN 'generic_nonparty_option' ELSE '' END AS reason FROM (SELECT id, CASE WHEN id % 17 = 3 THEN ' Against ALL' ELSE x END AS x FROM t)""")
def skip_reason(spark: SparkSession, d: str) -> DataFrame:
    """Why a target is left out of the requests."""
    rows = texts(spark, d).withColumn("x", F.when(F.col("id") % 17 == 3, " Against ALL").otherwise(F.col("x")))
    return rows.select("id", R.skip_reason(T.is_missing_label("x"), T.is_low_value_label(T.match_name("x")), T.is_non_party("x")).alias("reason"))


#: Texts as read in the wrong encoding, and as they should be; the last are right as they are.
GARBLED = [
    ("PaÅ‚ac Å»ycia", "Pałac Życia"), ("Ä\x87iriÄ\x87", "ćirić"), ("Ã©lan & Co", "élan & Co"), ("â‚¬uro Partij", "€uro Partij"), ("Ð\x9cÐ¸Ñ\x80", "Мир"), ("Ã\x85land", "Ã\x85land"), ("Ãngel", "Ãngel"), ("Å and Ä", "Å and Ä"), ("élan", "élan"), ("plain", "plain"),
]
_SQL_GARBLED = "(VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(GARBLED)) + ") AS g(k, raw, fixed)"


@query(f"""SELECT o_orderkey AS id, fixed, trim(regexp_replace(replace(lower(strip_accents(fixed)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS folded FROM orders JOIN {_SQL_GARBLED} ON o_orderkey % {len(GARBLED)} = k""")
def mojibake_repair(spark: SparkSession, d: str) -> DataFrame:
    """Texts read in the wrong encoding repaired, and the names for matching that come of them."""
    raw = F.get(F.array(*(F.lit(a) for a, _ in GARBLED)), (F.col("o_orderkey") % len(GARBLED)).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.repair_mojibake(raw).alias("fixed"), T.repaired_name(raw).alias("folded"))


COUNTRIES = [*C.CODES, " Austria ", "austria", "Atlantis", ""]


def _sql_lookup(known: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items()) + " ELSE '' END"


@query(f"""WITH c AS (SELECT c_custkey AS id, trim(([{', '.join(repr(c) for c in COUNTRIES)}])[CAST(c_custkey % {len(COUNTRIES)} AS INT) + 1]) AS name FROM customer),
i AS (SELECT id, {_sql_lookup(C.CODES, 'name')} AS iso2 FROM c)
SELECT id, iso2, {_sql_lookup(C.ISO3, 'iso2')} AS iso3, {_sql_lookup(C.NAMES, 'iso2')} AS country FROM i""")
def country_codes(spark: SparkSession, d: str) -> DataFrame:
    """Country names to two-letter codes, and these to three-letter codes and names."""
    name = F.get(F.array(*(F.lit(c) for c in COUNTRIES)), (F.col("c_custkey") % len(COUNTRIES)).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.iso2_of_country(name).alias("iso2"))
    return rows.select("id", "iso2", C.iso3_of_iso2("iso2").alias("iso3"), C.country_of_iso2("iso2").alias("country"))


_URL = r"regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', {})"
PAGES = """p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'utm_source=x' || regexp_extract(url, '#.*$') WHEN 1 THEN replace(url, '://', '://www.') WHEN 2 THEN replace(url, '/en/', '//en//') ELSE url END AS url FROM pages)"""
PARTS = f"u AS (SELECT page_id, url, lower({_URL.format(1)}) AS scheme, replace(lower({_URL.format(2)}), 'www.', '') AS host, {_URL.format(3)} AS path, {_URL.format(4)} AS q FROM p)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    u, plain = F.col("url"), F.regexp_extract("url", "^[^#]*", 0)
    changed = (
        F.when(F.col("page_id") % 4 == 0, F.concat(plain, F.when(plain.contains("?"), "&").otherwise("?"), F.lit("utm_source=x"), F.regexp_extract(u, "#.*$", 0)))
        .when(F.col("page_id") % 4 == 1, F.replace(u, F.lit("://"), F.lit("://www."))).when(F.col("page_id") % 4 == 2, F.replace(u, F.lit("/en/"), F.lit("//en//"))).otherwise(u)
    )
    return table(spark, d, "pages").select("page_id", changed.alias("url"))


@query(f"""WITH {PAGES}, {PARTS}, k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: NOT (starts_with(lower(x), 'utm_') OR starts_with(lower(x), 'fbclid=') OR starts_with(lower(x), 'gclid='))), '&') AS kept FROM u)
SELECT page_id, coalesce(nullif(scheme, ''), 'https') || '://' || host || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM k""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.normalize_url("url").alias("url"))


@query(f"WITH {PAGES}, {PARTS} SELECT host AS domain, host AS publisher, count(*) AS n FROM u GROUP BY 1, 2")
def domain_publisher(spark: SparkSession, d: str) -> DataFrame:
    domain = U.domain_of("url")
    return pages(spark, d).groupBy(domain.alias("domain"), U.publisher_of(domain).alias("publisher")).agg(F.count("*").alias("n"))


#: Domains and publishers that reach each class of source.
SOURCES = [
    ("en.wikipedia.org", "", "official results"), ("", "Wikipedia", "a page"), ("osce.org", "", "a report"), ("", "", "Council of Europe note"), ("parlgov.fly.dev", "ParlGov", ""),
    ("www.bbc.co.uk", "BBC", "news"), ("x.gob.es", "", ""), ("", "", "Official results 2015"), ("party.example", "", "official website"), ("party.example", "", "the official list"),
    ("blog.example", "A blog", ""), ("blog.example", "", ""),
]
_SQL_SOURCES = "(VALUES " + ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(SOURCES)) + ") AS s(k, domain, publisher, title)"


def sql_in(column: str, names: tuple[str, ...]) -> str:
    under = " OR ".join(f"ends_with({column}, '.{n}')" for n in names)
    return f"({column} IN ({', '.join(repr(n) for n in names)}) OR {under})"


def sql_has(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


_Q = [
    ("encyclopedia", f"{sql_in('d', U.ENCYCLOPEDIA)} OR (d = '' AND {sql_has('p', U.ENCYCLOPEDIA_WORDS)})"),
    ("intergovernmental_reference", f"{sql_in('d', U.INTERGOVERNMENTAL)} OR {sql_has('x', U.INTERGOVERNMENTAL_WORDS)}"),
    ("institutional_reference", f"{sql_in('d', U.INSTITUTIONAL)} OR {sql_has('x', U.INSTITUTIONAL_WORDS)}"),
    ("news_media", sql_has("d", U.NEWS_PARTS)),
    ("official_public_source", f"{sql_in('d', U.PUBLIC)} OR {sql_in('d', U.PUBLIC_SUFFIXES)} OR {sql_has('d', U.PUBLIC_PARTS)} OR (d = '' AND {sql_has('x', (*U.PUBLIC_PUBLISHER_WORDS, *U.PUBLIC_TITLE_WORDS))})"),
    ("official_party_source", f"{sql_has('x', U.PARTY_WORDS)} OR (contains(x, 'official') AND {sql_has('x', U.PARTY_KINDS)})"),
]


@query(f"""WITH s AS (SELECT k, replace(lower(domain), 'www.', '') AS d, lower(publisher) AS p, lower(title) AS t, lower(publisher) || ' | ' || lower(title) || ' | ' AS x FROM {_SQL_SOURCES}),
g AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in _Q)} ELSE 'other_web' END AS tag FROM s)
SELECT CAST(page_id AS BIGINT) AS page_id, tag, CAST(CASE tag {' '.join(f"WHEN '{n}' THEN {v}" for n, v in U.SCORES.items())} ELSE CASE WHEN p <> '' OR t <> '' THEN 55 ELSE 40 END END AS INT) AS score
FROM pages JOIN g ON page_id % {len(SOURCES)} = k""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*(F.struct(F.lit(a).alias("domain"), F.lit(b).alias("publisher"), F.lit(c).alias("title")) for a, b, c in SOURCES))
    rows = table(spark, d, "pages").select("page_id", F.get(known, (F.col("page_id") % len(SOURCES)).cast("int")).alias("s"))
    q = U.source_quality("s.domain", "s.publisher", "s.title", F.lit(""))
    return rows.select("page_id", q["tag"].alias("tag"), q["score"].alias("score"))


BORN = "b AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'unknown' ELSE '19' || lpad(CAST(o_orderkey % 60 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') END AS born, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1910 + o_orderkey % 60 AS INT) END AS born_year FROM orders)"


def born(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    iso = F.format_string("19%02d-%02d-%02d", k % 60 + 10, k % 12 + 1, k % 28 + 1)
    return table(spark, d, "orders").select(
        k.alias("id"), F.to_date("o_orderdate").alias("day"), F.when(k % 5 == 1, "unknown").when(k % 5 != 0, iso).alias("born"), F.when(k % 3 != 0, (1910 + k % 60).cast("int")).alias("born_year")
    )


@query(f"""WITH {BORN}, p AS (SELECT *, try_cast(born AS DATE) AS bd FROM b)
SELECT id, CAST(CASE WHEN bd IS NOT NULL THEN year(day) - year(bd) - CASE WHEN (month(day), day(day)) < (month(bd), day(bd)) THEN 1 ELSE 0 END WHEN born_year IS NOT NULL THEN year(day) - born_year END AS DOUBLE) AS age,
  CASE WHEN bd IS NOT NULL THEN 'exact_date' WHEN born_year IS NOT NULL THEN 'birth_year_only' END AS method FROM p""")
def age_on_date(spark: SparkSession, d: str) -> DataFrame:
    age = D.age_on("day", "born", "born_year")
    return born(spark, d).select("id", age["age"].alias("age"), age["method"].alias("method"))


@query(f"""WITH {BORN} SELECT id, CAST(try_cast(born AS DATE) AS VARCHAR) AS parsed, coalesce(strftime(try_cast(born AS DATE), '%Y-%m-%d'), '') AS iso,
  CAST(CAST(try_strptime(strftime(day, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS VARCHAR) AS day_first FROM b""")
def date_parse_coerce(spark: SparkSession, d: str) -> DataFrame:
    rows = born(spark, d)
    return rows.select("id", D.parse_date("born").cast("string").alias("parsed"), D.iso_text(D.parse_date("born")).alias("iso"), D.parse_day_first(F.date_format("day", "dd/MM/yyyy")).cast("string").alias("day_first"))


@query("SELECT o_orderkey AS id, CAST(floor((year(o_orderdate) * 100 + month(o_orderdate)) / 100) AS BIGINT) AS year FROM orders")
def yyyymm_year(spark: SparkSession, d: str) -> DataFrame:
    code = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.year_of_month_code(code).alias("year"))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 2000 + o_orderkey % 9 END AS y, o_orderkey % 14 AS m, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 33 END AS dd, CAST(o_orderdate AS DATE) AS fallback FROM orders)
SELECT id, CAST(coalesce(try_cast(printf('%04d-%02d-%02d', y, m, coalesce(dd, 15)) AS DATE), fallback) AS VARCHAR) AS day FROM c""")
def date_components_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = D.from_parts(F.when(k % 7 != 0, 2000 + k % 9), k % 14, F.when(k % 4 != 0, k % 33))
    return table(spark, d, "orders").select(k.alias("id"), F.coalesce(made, F.to_date("o_orderdate")).cast("string").alias("day"))


#: Survey columns of a customer under the names that some wave used.
SURVEY = """s AS (SELECT c_custkey AS id, c_nationkey + 20 AS agea, CASE WHEN c_custkey % 3 = 0 THEN 1950 + c_custkey % 40 END AS yrbrn, 2010 AS year, c_custkey % 3 AS gndr, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS anweight,
  c_custkey % 7 / 7.0 AS pspwght, 2.0 AS pweight, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 6 END AS edulvla, CASE c_custkey % 5 WHEN 0 THEN 5555 WHEN 1 THEN 213 WHEN 2 THEN 520 WHEN 3 THEN 113 END AS edulvlb FROM customer)"""


def survey(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    detailed = F.when(k % 5 == 0, 5555).when(k % 5 == 1, 213).when(k % 5 == 2, 520).when(k % 5 == 3, 113)
    return table(spark, d, "customer").select(
        k.alias("id"), (F.col("c_nationkey") + 20).alias("agea"), F.when(k % 3 == 0, 1950 + k % 40).alias("yrbrn"), F.lit(2010).alias("year"), (k % 3).alias("gndr"),
        F.when(k % 4 == 0, F.col("c_acctbal")).alias("anweight"), (k % 7 / F.lit(7.0)).alias("pspwght"), F.lit(2.0).alias("pweight"), F.when(k % 2 == 0, k % 6).alias("edulvla"), detailed.alias("edulvlb"),
    )


@query(f"WITH {SURVEY} SELECT id, CAST(agea AS DOUBLE) AS age, CAST(yrbrn AS BIGINT) AS born, CAST(NULL AS VARCHAR) AS region FROM s")
def harmonize_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """The first existing candidate column under a canonical name; NULL where there is none."""
    return harmonised(survey(spark, d), {"id": (["respondent", "id"], "bigint"), "age": (["age", "agea"], "double"), "born": (["yrbrn"], "bigint"), "region": (["region4", "nuts"], "string")})


@query(f"""WITH {SURVEY} SELECT id, round(coalesce(anweight, pspwght * pweight), 6) AS weight, CAST(coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE agea END, year - yrbrn) AS DOUBLE) AS age,
  CASE WHEN gndr IS NOT NULL THEN CAST(gndr = 2 AS INT)::DOUBLE END AS female FROM s""")
def derive_demographics(spark: SparkSession, d: str) -> DataFrame:
    rows = survey(spark, d)
    age = F.coalesce(F.when(F.col("id") % 3 != 0, to_num("agea")), to_num("year") - to_num("yrbrn"))
    return rows.select("id", F.round(F.coalesce("anweight", F.col("pspwght") * F.col("pweight")), 6).alias("weight"), age.alias("age"), (F.col("gndr") == 2).cast("int").cast("double").alias("female"))


@query(f"""WITH {SURVEY}, e AS (SELECT id, coalesce(CAST(edulvla AS DOUBLE), CASE edulvlb WHEN 5555 THEN 55 WHEN 213 THEN 2 WHEN 520 THEN 5 WHEN 113 THEN 1 END) AS lvl FROM s)
SELECT id, CASE WHEN lvl IN (1, 2) THEN 1.0::DOUBLE WHEN lvl IN (3, 4) THEN 2.0 WHEN lvl = 5 THEN 3.0 END AS educ FROM e""")
def educ_map(spark: SparkSession, d: str) -> DataFrame:
    return survey(spark, d).select("id", N.education_category("edulvla", "edulvlb").alias("educ"))


@query(f"""WITH {SURVEY} SELECT id, CASE WHEN id % 3 <> 0 THEN CAST(agea < 25 AS INT) END AS young, CASE WHEN id % 3 <> 0 THEN CAST(agea BETWEEN 25 AND 35 AS INT) END AS middle, CASE WHEN id % 3 <> 0 THEN CAST(agea > 35 AS INT) END AS old FROM s""")
def age_bands(spark: SparkSession, d: str) -> DataFrame:
    """0/1 bands that stay unknown where the age is."""
    age = F.when(F.col("id") % 3 != 0, F.col("agea"))
    bands = {"young": age < 25, "middle": age.between(25, 35), "old": age > 35}
    return survey(spark, d).select("id", *(c.cast("int").alias(n) for n, c in bands.items()))


@query(f"WITH {SURVEY} SELECT id, yrbrn IS NOT NULL AND edulvlb IS NOT NULL AS complete, false AS complete_missing_column FROM s")
def complete_case(spark: SparkSession, d: str) -> DataFrame:
    rows = with_columns_present(survey(spark, d), {"yrbrn": "int"})
    return rows.select("id", complete(rows, ["yrbrn", "edulvlb"]).alias("complete"), complete(rows, ["yrbrn", "not_there"]).alias("complete_missing_column"))


#: A leader record for each event, as a provider would answer: fenced, bare, with a list, without, or broken.
_PEOPLE = """'[{"full_name": "A ' || user_id || '", "birth_date_iso": "1960-0' || (k % 9 + 1) || '-15", "birth_year": null, "gender_text": "f", "include_in_average": true}, {"full_name": "B", "birth_year": ' || (1950 + k % 30) || ', "gender_text": "m", "include_in_average": ' || CASE WHEN k % 2 = 0 THEN 'false' ELSE 'null' END || '}]'"""
RAW = f"""e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
raw AS (SELECT *, CASE event_id % 5 WHEN 4 THEN 'no answer' ELSE '{{"resolved": true, "leader_name": "' || CASE WHEN event_id % 5 = 3 THEN 'C' ELSE '' END || '", "gender_text": ' || CASE WHEN event_id % 5 = 3 THEN '"man"' ELSE 'null' END || ', "leaders": ' || CASE WHEN event_id % 5 = 3 THEN 'null' ELSE {_PEOPLE} END || '}}' END AS body FROM e),
ans AS (SELECT *, CASE event_id % 5 WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here: ' || body || ' done' ELSE body END AS answer FROM raw)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, n = F.col("k"), F.col("event_id") % 5
    text = F.concat
    lit = F.lit
    people = text(
        lit('[{"full_name": "A '), F.col("user_id").cast("string"), lit('", "birth_date_iso": "1960-0'), (k % 9 + 1).cast("string"), lit('-15", "birth_year": null, "gender_text": "f", "include_in_average": true}, {"full_name": "B", "birth_year": '),
        (1950 + k % 30).cast("string"), lit(', "gender_text": "m", "include_in_average": '), F.when(k % 2 == 0, "false").otherwise("null"), lit("}]"),
    )
    own = n == 3
    body = F.when(n == 4, "no answer").otherwise(text(
        lit('{"resolved": true, "leader_name": "'), F.when(own, "C").otherwise(""), lit('", "gender_text": '), F.when(own, '"man"').otherwise("null"), lit(', "leaders": '), F.when(own, "null").otherwise(people), lit("}"),
    ))
    answer = F.when(n == 1, text(lit("```json\n"), body, lit("\n```"))).when(n == 2, text(lit("Here: "), body, lit(" done"))).otherwise(body)
    return e.select("event_id", "day", "k", answer.alias("answer"))


@query(f"WITH {RAW} SELECT event_id, event_id % 5 <> 4 AS parsed, CASE WHEN event_id % 5 <> 4 THEN true END AS resolved, CASE WHEN event_id % 5 = 3 THEN 'C' WHEN event_id % 5 <> 4 THEN '' END AS leader_name FROM ans")
def json_tolerant_parse(spark: SparkSession, d: str) -> DataFrame:
    """Records out of fenced, wrapped, bare and useless answers."""
    r = X.parse_record("answer", X.LEADER_RECORD)
    rows = answers(spark, d).withColumn("r", r)
    return rows.select("event_id", F.col("r").isNotNull().alias("parsed"), F.col("r.resolved").alias("resolved"), F.col("r.leader_name").alias("leader_name"))


LEADERS = f"""{RAW}, m AS (SELECT event_id, user_id, day, k, event_id % 5 AS n, 2024 - 1960 - CASE WHEN (month(day), day(day)) < (k % 9 + 1, 15) THEN 1 ELSE 0 END AS age_a, 2024 - (1950 + k % 30) AS age_b, k % 2 <> 0 AS two FROM ans WHERE event_id % 5 <> 4)"""


@query(f"""WITH {LEADERS} SELECT event_id, CAST(CASE WHEN n = 3 THEN 1 WHEN two THEN 2 ELSE 1 END AS INT) AS leader_count_total, CASE WHEN n = 3 THEN 'C' ELSE 'A ' || CAST(user_id AS VARCHAR) END AS leader_name_primary,
  CASE WHEN n = 3 THEN 'C' WHEN two THEN 'A ' || CAST(user_id AS VARCHAR) || '; B' ELSE 'A ' || CAST(user_id AS VARCHAR) END AS leader_name_joined FROM m""")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d).select("event_id", "leader_count_total", "leader_name_primary", "leader_name_joined")


@query(f"""WITH {LEADERS} SELECT event_id, CAST(CASE WHEN n = 3 THEN NULL WHEN two THEN (age_a + age_b) / 2.0 ELSE age_a END AS DOUBLE) AS candidate_age, CASE WHEN n = 3 THEN NULL WHEN two THEN 'mean_mixed' ELSE 'exact_date' END AS candidate_age_method,
  CAST(CASE WHEN n = 3 THEN 1 WHEN two THEN 0.5 ELSE 0 END AS DOUBLE) AS candidate_male1, CAST(CASE WHEN n = 3 THEN 0 WHEN two THEN 0.5 ELSE 1 END AS DOUBLE) AS candidate_female1, n <> 3 AND two AS multiple_leaders FROM m""")
def json_array_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d).select("event_id", "candidate_age", "candidate_age_method", "candidate_male1", "candidate_female1", "multiple_leaders")


def _leaders(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).withColumn("body", X.json_object_text("answer")).where("body IS NOT NULL").withColumn("r", F.from_json("body", X.LEADER_RECORD))
    return X.with_leaders(rows, "r", "day").select("event_id", *X.leader_metrics(F.col("r"), F.col("who")))


@query("""WITH l AS (SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey, o_orderpriority AS p FROM orders)
SELECT custkey, max(o_orderkey) FILTER (k = 1) AS order_1, max(o_orderkey) FILTER (k = 2) AS order_2, count(*) AS n, coalesce(count(*) FILTER (k <= 4 AND p = '1-URGENT'), 0) AS urgent FROM l GROUP BY 1""")
def json_array_wide(spark: SparkSession, d: str) -> DataFrame:
    """The first elements of an array as columns, and counts over it."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").withColumn("k", F.row_number().over(w))
    best = F.when(F.col("k") <= 4, F.struct("k", "o_orderkey", "o_orderpriority"))  # only what becomes a column is gathered
    lists = rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list(best)).alias("a"), F.count("*").alias("n"))
    urgent = F.size(F.filter("a", lambda x: x["o_orderpriority"] == "1-URGENT")).cast("bigint")
    return lists.select("custkey", F.get("a", F.lit(0))["o_orderkey"].alias("order_1"), F.get("a", F.lit(1))["o_orderkey"].alias("order_2"), "n", urgent.alias("urgent"))


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, 100.0 - n_nationkey AS share FROM nation)
SELECT o_orderkey AS id, (o_orderkey % 30) IN (SELECT n_nationkey FROM c WHERE n_regionkey = o_orderkey % 5) AS allowed, (SELECT share FROM c WHERE n_regionkey = o_orderkey % 5 AND n_nationkey = o_orderkey % 30)::DOUBLE AS share FROM orders""")
def json_member_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Whether a selected id is among the candidates of a JSON list, and its share there."""
    c = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("mpd_party_id"), (100.0 - F.col("n_nationkey")).alias("share_mpd")))).alias("cand_json"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("r"), (F.col("o_orderkey") % 30).alias("sel")).join(c, "r")
    items = F.from_json("cand_json", X.CANDIDATES)
    return rows.select("id", X.has_member(items, "mpd_party_id", "sel").alias("allowed"), X.member_by_id(items, "mpd_party_id", "sel")["share_mpd"].alias("share"))


@query("""SELECT o_orderkey AS id, CASE WHEN g IS NULL THEN '' WHEN g <= 2 THEN 'within_2pp' WHEN g <= 5 THEN 'within_5pp' WHEN g <= 10 THEN 'within_10pp' ELSE 'over_10pp' END AS band FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 140) / 10.0 END AS g FROM orders)""")
def gap_band(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select("id", N.gap_band("g").alias("band"))


@query("""SELECT o_orderkey AS id, CASE WHEN g > 10 THEN 'very_large_gap_check' WHEN g > 5 THEN 'large_gap_review' ELSE '' END AS alert FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 140) / 10.0 END AS g FROM orders)""")
def soft_alert(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select("id", N.gap_alert("g").alias("alert"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.when(k % 9 != 0, k % 140 / 10.0).alias("g"))


#: Old and new values of a case, all combinations over the order keys.
CASES = """c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 40.0 + o_orderkey % 4 END AS old_age, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE 40.0 + o_orderkey % 5 END AS new_age,
  CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE (o_orderkey % 3 - 1)::DOUBLE END AS old_f, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE (o_orderkey % 2)::DOUBLE END AS new_f,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS resolved, o_orderkey % 11 = 0 AS collective, o_orderkey % 13 = 0 AS multiple,
  CASE WHEN o_orderkey % 2 = 0 THEN 'clean_old_data' ELSE 'ambiguous_old_data' END AS quality, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey END AS old_id FROM orders)"""
_AGE = "CASE WHEN old_age IS NULL AND new_age IS NULL THEN 'both_missing' WHEN old_age IS NULL THEN 'old_missing' WHEN new_age IS NULL THEN 'ai_missing' WHEN abs(old_age - new_age) < 1e-9 THEN 'exact_match' WHEN abs(abs(old_age - new_age) - 1) < 1e-9 THEN 'off_by_one' ELSE 'mismatch' END"
_GENDER = "CASE WHEN old_f IS NULL AND new_f IS NULL THEN 'both_missing' WHEN old_f IS NULL THEN 'old_missing' WHEN new_f IS NULL THEN 'ai_missing' WHEN abs(old_f - new_f) < 1e-9 THEN 'match' ELSE 'mismatch' END"


def cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 != 0, 40.0 + k % 4).alias("old_age"), F.when(k % 5 != 0, 40.0 + k % 5).alias("new_age"), F.when(k % 3 != 0, (k % 3 - 1).cast("double")).alias("old_f"),
        F.when(k % 7 != 0, (k % 2).cast("double")).alias("new_f"), F.when(k % 6 != 0, k % 6 != 1).alias("resolved"), (k % 11 == 0).alias("collective"), (k % 13 == 0).alias("multiple"),
        F.when(k % 2 == 0, "clean_old_data").otherwise("ambiguous_old_data").alias("quality"), F.when(k % 8 != 0, k).alias("old_id"),
    )


@query(f"WITH {CASES} SELECT id, {_AGE} AS age_check, {_GENDER} AS gender_check FROM c")
def age_gender_check(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id", N.age_check("old_age", "new_age").alias("age_check"), N.gender_check("old_f", "new_f").alias("gender_check"))


@query(f"""WITH {CASES}, x AS (SELECT *, {_AGE} AS ac, {_GENDER} AS gc, new_age IS NOT NULL OR new_f IS NOT NULL AS has_new, old_age IS NOT NULL OR old_f IS NOT NULL AS has_old, coalesce(resolved, true) AS rs FROM c),
y AS (SELECT *, ac IN ('exact_match', 'off_by_one', 'old_missing', 'ai_missing', 'both_missing') AND gc IN ('match', 'old_missing', 'ai_missing', 'both_missing') AS agree, quality = 'clean_old_data' AS clean FROM x)
SELECT id, CASE WHEN rs AND collective AND NOT has_new THEN 'manual_review_collective_leadership' WHEN rs AND has_new AND multiple THEN 'ai_resolved_multiple_leader_case' WHEN rs AND has_new AND agree AND clean THEN 'ai_confirmed_or_extended_old'
  WHEN rs AND has_new AND agree AND has_old THEN 'ai_resolved_old_problematic_row' WHEN rs AND has_new AND agree THEN 'new_ai_collected' WHEN rs AND has_new THEN 'manual_review_conflict' WHEN has_old AND clean THEN 'keep_old_unverified'
  WHEN has_old THEN 'keep_old_but_flag_for_review' WHEN has_new THEN 'new_ai_collected' ELSE 'unresolved' END AS final_status, CAST(coalesce(new_age, old_age) AS DOUBLE) AS age, coalesce(new_f, old_f) AS female FROM y""")
def final_status(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d)
    known: dict[str, Column] = {n: F.col(f"{n}_age").isNotNull() | F.col(f"{n}_f").isNotNull() for n in ("old", "new")}
    status = R.final_status(F.col("resolved"), known["new"], known["old"], F.col("quality"), N.age_check("old_age", "new_age"), N.gender_check("old_f", "new_f"), F.col("collective"), F.col("multiple"))
    return rows.select("id", status.alias("final_status"), F.coalesce("new_age", "old_age").alias("age"), F.coalesce("new_f", "old_f").alias("female"))


@query(f"WITH {CASES} SELECT id, CASE WHEN old_id IS NULL THEN 'collect_missing_old_data' WHEN quality = 'clean_old_data' THEN 'audit_old_clean_single_person' ELSE 'audit_old_ambiguous_or_multiperson' END AS queue_reason FROM c")
def queue_reason(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id", R.queue_reason(F.col("old_id"), F.col("quality")).alias("queue_reason"))


@query(f"""WITH {CASES}, o AS (SELECT *, CASE WHEN old_age IS NOT NULL AND old_f IS NOT NULL THEN abs(old_age - (2000 - (1958 + id % 3))) END AS gap FROM c)
SELECT id, CASE WHEN old_age IS NOT NULL AND old_f IS NOT NULL THEN CASE WHEN gap < 1e-9 THEN 'both_consistent' WHEN abs(gap - 1) < 1e-9 THEN 'both_off_by_one' ELSE 'both_inconsistent' END WHEN old_age IS NOT NULL THEN 'age_field_only' WHEN old_f IS NOT NULL THEN 'yearborn_only' ELSE 'missing' END AS age_source,
  CASE WHEN old_age IS NULL THEN 'missing_old_data' WHEN collective OR multiple THEN 'ambiguous_old_data' WHEN gap > 1.5 THEN 'inconsistent_old_data' ELSE 'clean_old_data' END AS quality FROM o""")
def legacy_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d).withColumn("born", F.when(F.col("old_f").isNotNull(), 1958 + F.col("id") % 3))
    source = N.age_source("old_age", "born", F.lit(2000))
    return rows.select("id", source.alias("age_source"), R.old_quality(F.col("old_age"), F.col("collective"), F.col("multiple"), source).alias("quality"))


REPAIR = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN NULL ELSE 'True' END AS resolved, CASE WHEN o_orderkey % 5 <> 0 THEN 50.0 END AS age,
  CASE WHEN o_orderkey % 3 <> 0 THEN 1.0 END AS male, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100.0 END AS confidence, CASE WHEN o_orderkey % 6 <> 0 THEN 'N' ELSE '' END AS name, CAST(o_orderkey % 3 AS INT) AS leaders, o_orderkey % 10 = 0 AS multiple FROM orders)"""


def repairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 9 == 0, "error").otherwise("ok").alias("status"), F.when(k % 4 == 0, "no").when(k % 4 != 1, "True").alias("resolved"), F.when(k % 5 != 0, 50.0).alias("age"),
        F.when(k % 3 != 0, 1.0).alias("male"), F.when(k % 7 != 0, k % 100 / 100.0).alias("confidence"), F.when(k % 6 != 0, "N").otherwise("").alias("name"), (k % 3).cast("int").alias("leaders"), (k % 10 == 0).alias("multiple"),
    )


@query("""SELECT c_custkey AS custkey, CAST(round_even(c_acctbal, 0) AS BIGINT) AS whole, CASE WHEN c_custkey % 9 <> 0 THEN round(c_acctbal / 7, 3) END AS share,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS DOUBLE) ELSE c_acctbal END AS known FROM customer""")
def rounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Nearest integers, shares to three digits where they are finite, and the first of several columns that is a number."""
    k = F.col("c_custkey")
    endless = F.when(k % 9 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 7)
    told = F.when(k % 4 == 0, F.lit("n/a")).when(k % 4 == 1, F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select(
        k.alias("custkey"), N.round_int("c_acctbal").alias("whole"), N.round_share(endless).alias("share"),
        first_number(told, F.when(k % 4 != 0, F.col("c_acctbal")), F.col("c_nationkey")).alias("known"),
    )


@query(f"""WITH {REPAIR}, n AS (SELECT *, status <> 'ok' AS n1, coalesce(lower(resolved), '') <> 'true' AS n2, age IS NULL AS n3, male IS NULL AS n4, coalesce(confidence < 0.85, false) AS n5 FROM r)
SELECT id, concat_ws('|', CASE WHEN n1 THEN 'status' END, CASE WHEN n2 THEN 'unresolved' END, CASE WHEN n3 THEN 'missing_age' END, CASE WHEN n4 THEN 'missing_gender' END, CASE WHEN n5 THEN 'low_conf' END) AS reason,
  CASE WHEN n2 THEN 'full_resolution' WHEN multiple OR leaders > 1 THEN 'repair_leaders_array' WHEN name <> '' THEN 'repair_fixed_single_leader' ELSE 'full_resolution' END AS mode
FROM n WHERE n1 OR n2 OR n3 OR n4 OR n5""")
def repair_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = repairs(spark, d)
    needs = R.repair_needs(F.col("status"), F.col("resolved"), F.col("age"), F.col("male"), F.col("confidence"))
    mode = R.repair_mode(F.col("resolved"), F.col("name"), F.col("multiple").cast("string"), F.lit(None).cast("string"), F.col("leaders"))
    return rows.select("id", R.told(needs).alias("reason"), mode.alias("mode")).where("reason <> ''")


@query(f"""WITH {REPAIR}, n AS (SELECT id - 1 AS id, status, resolved, age, male, confidence, name, leaders FROM r WHERE id % 2 = 1),
m AS (SELECT o.id, o.status AS s0, o.resolved AS r0, o.age AS a0, o.male AS m0, o.name AS n0, o.leaders AS l0, o.confidence AS c0, CASE WHEN n.status <> '' THEN n.status ELSE o.status END AS s1,
  coalesce(CASE lower(n.resolved) WHEN 'true' THEN true WHEN 'no' THEN false END, CASE lower(o.resolved) WHEN 'true' THEN true WHEN 'no' THEN false END) AS r1, coalesce(n.age, o.age) AS a1, coalesce(n.male, o.male) AS m1,
  CASE WHEN n.name <> '' THEN n.name ELSE o.name END AS n1, coalesce(n.leaders, o.leaders) AS l1, coalesce(n.confidence, o.confidence) AS c1 FROM r o JOIN n USING (id)),
f AS (SELECT *, coalesce(lower(r0), '') = 'true' AS was, coalesce(r1, false) AS now, n0 <> '' OR l0 > 0 AS k0, n1 <> '' OR l1 > 0 AS k1 FROM m)
SELECT id, s1 AS status, r1 AS resolved, CAST(a1 AS DOUBLE) AS age, CAST(m1 AS DOUBLE) AS male, n1 AS name, (s0 <> 'ok' AND s1 = 'ok') OR (NOT was AND now) OR (a0 IS NULL AND a1 IS NOT NULL) OR (m0 IS NULL AND m1 IS NOT NULL) OR (NOT k0 AND k1)
  OR (NOT was AND NOT now AND k1 AND (NOT k0 OR coalesce(c1 > c0 + 0.15, false))) AS improved FROM f""")
def repair_merge(spark: SparkSession, d: str) -> DataFrame:
    """New values are preferred by type: numbers where known, texts where not empty, flags where readable."""
    rows = repairs(spark, d)
    new = rows.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"n_{c}") for c in rows.columns if c != "id"))
    both = rows.join(new, "id")

    def text(c: str) -> Column:
        return F.when(clean_text(f"n_{c}") != "", clean_text(f"n_{c}")).otherwise(F.col(c))

    merged = {c: F.coalesce(f"n_{c}", c) for c in ("age", "male", "leaders", "confidence")} | {"status": text("status"), "name": text("name")}
    merged["resolved"] = F.coalesce(T.bool_like("n_resolved"), T.bool_like("resolved"))
    old = {c: F.col(c) for c in ("status", "resolved", "age", "male", "name", "leaders", "confidence")}
    better = R.is_improvement(old, merged | {"resolved": merged["resolved"].cast("string")})
    return both.select("id", *(merged[c].alias(c) for c in ("status", "resolved", "age", "male", "name")), better.alias("improved"))


#: Evidence of a match in all shapes.
TRUST = """e AS (SELECT o_orderkey AS id, o_orderkey % 17 = 0 AS generic, o_orderkey % 5 AS n, o_orderkey % 4 AS domains, o_orderkey % 5 AS non_wiki, o_orderkey % 4 AS independent, o_orderkey % 3 AS independent_domains, o_orderkey % 3 AS reference,
  o_orderkey % 3 AS high, o_orderkey % 2 + 1 AS high_domains, o_orderkey % 2 AS party_official, (['exact_name', 'abbreviation', 'translation', 'transliteration', 'partyfacts_hint', 'alliance_or_joint_list', 'ideology'])[CAST(o_orderkey % 7 AS INT) + 1] AS basis,
  CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 100) / 100.0 END AS score, o_orderkey % 25 + 1 AS rank, o_orderkey % 2 AS calls, o_orderkey % 10 <> 0 AS resolved, o_orderkey % 19 <> 0 AS allowed, CAST(60 + o_orderkey % 41 AS INT) AS confidence FROM orders)"""
_BASES = ("exact_name", "abbreviation", "translation", "transliteration", "partyfacts_hint", "alliance_or_joint_list", "ideology")


def evidence(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Column]]:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("id"), (k % 17 == 0).alias("generic"), (k % 5).alias("n"), (k % 4).alias("domains"), (k % 5).alias("non_wiki"), (k % 4).alias("independent"), (k % 3).alias("independent_domains"), (k % 3).alias("reference"),
        (k % 3).alias("high"), (k % 2 + 1).alias("high_domains"), (k % 2).alias("party_official"), F.get(F.array(*(F.lit(b) for b in _BASES)), (k % 7).cast("int")).alias("basis"),
        F.when(k % 8 != 0, k % 100 / 100.0).alias("score"), (k % 25 + 1).alias("rank"), (k % 2).alias("calls"), (k % 10 != 0).alias("resolved"), (k % 19 != 0).alias("allowed"), (60 + k % 41).cast("int").alias("confidence"),
    )
    return rows, {c: F.col(c) for c in rows.columns}


_EX, _TR, _HARD = "basis IN ('exact_name', 'abbreviation')", "basis IN ('translation', 'transliteration')", "basis = 'alliance_or_joint_list'"
_HINT, _DIRECT, _OTHER = "basis = 'partyfacts_hint'", "basis IN ('exact_name', 'abbreviation', 'translation', 'transliteration')", "basis = 'ideology'"
_FAR = f"({_HINT} OR {_HARD})"
CAPS = [
    ("generic", 25), ("n = 0", 55), ("n = 1", 72), ("n >= 2 AND domains <= 1", 88), ("n > 0 AND non_wiki <= 0", 72), ("n > 0 AND non_wiki > 0 AND independent <= 0", 82),
    ("n > 0 AND non_wiki > 0 AND independent > 0 AND reference <= 0", 84), ("party_official > 0 AND reference <= 0", 78), (f"{_EX} AND score IS NULL", 88), (f"{_EX} AND score < 0.35", 82),
    (f"{_EX} AND score >= 0.35 AND score < 0.6", 92), (f"{_TR} AND score IS NULL", 85), (f"{_TR} AND score < 0.2", 74), (f"{_TR} AND score >= 0.2 AND score < 0.4", 84), (f"{_TR} AND reference <= 0", 86),
    (f"{_TR} AND high < 2 AND independent < 2", 89), (_HINT, 88), (f"{_HINT} AND (score IS NULL OR score < 0.55)", 82), (f"{_HINT} AND reference <= 0", 78), (_HARD, 88), (f"{_HARD} AND reference <= 0", 80),
    (f"{_HARD} AND score < 0.35", 72), (f"{_OTHER} AND score IS NULL", 80), (f"{_OTHER} AND score < 0.3", 70), (f"{_OTHER} AND score >= 0.3 AND score < 0.45", 78), (f"{_DIRECT} AND reference >= 1 AND independent < 2", 89),
    (f"{_DIRECT} AND high >= 2 AND high_domains < 2", 93), (f"{_DIRECT} AND independent >= 2 AND independent_domains < 2", 91), (f"{_FAR} AND rank > 15", 86), (f"{_FAR} AND rank > 10 AND rank <= 15", 92),
    (f"NOT {_FAR} AND rank > 20", 88), (f"NOT {_FAR} AND rank > 12 AND rank <= 20", 94), ("calls <= 0 AND n <= 0", 50),
]
SCORED = f"""{TRUST}, cap AS (SELECT *, CASE WHEN NOT resolved OR NOT allowed THEN 0 ELSE least(100, {', '.join(f'CASE WHEN {c} THEN {v} ELSE 100 END' for c, v in CAPS)}) END AS cap FROM e),
trust AS (SELECT *, CAST(CASE WHEN resolved THEN least(confidence, cap) ELSE 0 END AS INT) AS trust FROM cap)"""


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Column]]:
    rows, x = evidence(spark, d)
    cap = R.trust_cap(x, x["resolved"], F.lit(""), x["allowed"], F.lit(True))
    rows = rows.withColumn("_c", cap).withColumn("cap", F.col("_c.cap")).withColumn("flags", F.col("_c.flags"))
    return rows.withColumn("trust", R.trust_score(F.col("resolved"), F.col("confidence"), F.col("cap"))), x


@query(f"WITH {SCORED} SELECT id, CAST(cap AS INT) AS cap, trust, CAST(CASE WHEN NOT resolved OR NOT allowed THEN 1 ELSE {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c, _ in CAPS)} END AS INT) AS n_flags FROM trust")
def trust_score(spark: SparkSession, d: str) -> DataFrame:
    """The least of all caps that apply, and how many flags were raised."""
    rows, _ = scored(spark, d)
    n = F.when(F.col("flags") == "", 0).otherwise(F.size(F.split("flags", "; ")))
    return rows.select("id", "cap", "trust", n.alias("n_flags"))


BUCKETS = f"""{SCORED}, bucket AS (SELECT *, CASE WHEN NOT resolved THEN 'no_match' WHEN allowed AND trust >= 90 AND n >= 2 AND {_DIRECT} AND ((reference >= 2 AND high_domains >= 2) OR (reference >= 1 AND independent >= 2 AND independent_domains >= 2)) THEN 'strong_candidate'
  WHEN allowed AND trust >= 70 THEN 'needs_manual_review' ELSE 'hold_back' END AS bucket FROM trust)"""


@query(f"""WITH {BUCKETS} SELECT id, bucket, CASE bucket WHEN 'strong_candidate' THEN 'can_apply_if_you_agree' WHEN 'needs_manual_review' THEN 'review_manually_before_apply' WHEN 'no_match' THEN 'keep_unmatched' ELSE 'hold_back' END AS action FROM bucket""")
def review_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows, x = scored(spark, d)
    reason = R.nonmatch_reason(F.lit(""), F.col("resolved"), F.lit(False), F.lit(""), [F.lit("")])
    bucket = R.review_bucket(F.col("resolved"), reason, F.col("allowed"), F.col("trust"), x)
    return rows.select("id", bucket.alias("bucket"), R.recommended_action(bucket).alias("action"))


@query(f"""WITH {BUCKETS}, a AS (SELECT id, CASE WHEN id % 3 = 0 THEN id * 10 END AS validated, CASE WHEN bucket = 'strong_candidate' AND trust >= 90 THEN id END AS proposed FROM bucket)
SELECT id, coalesce(validated, proposed) AS final_id, CASE WHEN validated IS NOT NULL THEN 'validated' WHEN proposed IS NOT NULL THEN 'ai_match' ELSE '' END AS match_source, CAST(validated IS NULL AND proposed IS NOT NULL AS INT) AS ai_match_used FROM a""")
def apply_no_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Accepted proposals fill only what has no validated id."""
    rows, x = scored(spark, d)
    bucket = R.review_bucket(F.col("resolved"), F.lit("no_clear_party_match"), F.col("allowed"), F.col("trust"), x)
    accepted = R.may_apply(F.lit(""), bucket, F.col("trust"), manual=False)
    return rows.select("id", *R.never_overwrite(F.when(F.col("id") % 3 == 0, F.col("id") * 10), F.when(truthy(accepted), F.col("id"))))


#: Outcomes in words, so that every reason occurs.
REASONS = """n AS (SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS resolved, o_orderkey % 11 = 0 AS generic, (['', 'insufficient_evidence', 'no_clear_party_match'])[CAST(o_orderkey % 3 AS INT) + 1] AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'The true party is absent.' WHEN 1 THEN 'Unclear' END AS summary, CASE WHEN o_orderkey % 13 = 0 THEN 'given_reason' END AS explicit, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS name FROM orders)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), (k % 7 == 0).alias("resolved"), (k % 11 == 0).alias("generic"), F.when(k % 3 == 1, "insufficient_evidence").when(k % 3 == 2, "no_clear_party_match").otherwise("").alias("status"),
        F.when(k % 4 == 0, "The true party is absent.").when(k % 4 == 1, "Unclear").alias("summary"), F.when(k % 13 == 0, "given_reason").alias("explicit"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("name"),
    )


@query(f"""WITH {REASONS}, r AS (SELECT *, CASE WHEN explicit IS NOT NULL THEN explicit WHEN resolved THEN 'not_applicable' WHEN generic THEN 'generic_nonparty_option' WHEN status = 'insufficient_evidence' THEN status
  WHEN contains(lower(coalesce(summary, '')), 'true party is absent') THEN 'candidate_absent_from_allowed_list' WHEN status <> '' THEN status ELSE 'no_clear_party_match' END AS reason FROM n)
SELECT id, reason, CASE WHEN reason = 'candidate_absent_from_allowed_list' THEN coalesce(name, '') ELSE '' END AS absent,
  CASE WHEN resolved THEN '2 source(s); 1 domain(s); flags: only_one' WHEN reason <> 'candidate_absent_from_allowed_list' THEN 'No positive match; left unmatched.'
  WHEN name IS NULL THEN 'No positive match; identifiable party/list appears absent from the allowed MPD candidates.' ELSE 'No positive match; identifiable party/list appears absent from the allowed MPD candidates: ' || name || '.' END AS note FROM r""")
def nonmatch_reason(spark: SparkSession, d: str) -> DataFrame:
    """Why there is no match, which party was meant, and the note for the reviewer."""
    rows = outcomes(spark, d)
    reason = R.nonmatch_reason(F.col("explicit"), F.col("resolved"), F.col("generic"), F.col("status"), [F.col("summary"), F.col("name")])
    absent = R.absent_party(F.lit(""), reason, [F.col("name")])
    counts = {k: F.lit(v) for k, v in (("n", 2), ("domains", 1), ("high", 0), ("independent", 0), ("party_official", 0))}
    note = R.trust_note(F.col("resolved"), reason, absent, counts, F.lit(""), F.lit("only_one"))
    return rows.select("id", reason.alias("reason"), absent.alias("absent"), note.alias("note"))


@query("""WITH old AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'yes' END AS approve_apply, 'checked' AS reviewer_note FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey AS id, coalesce(approve_apply, '') AS approve_apply, coalesce(reviewer_note, '') AS reviewer_note, coalesce(approve_apply, '') = 'yes' AS applies FROM orders LEFT JOIN old ON o_orderkey = id""")
def review_approvals(spark: SparkSession, d: str) -> DataFrame:
    """A rebuilt review keeps what reviewers entered; only approved rows apply."""
    k = F.col("o_orderkey")
    review = table(spark, d, "orders").select(k.alias("id"))
    old = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(k.alias("id"), F.when(k % 6 == 0, "yes").alias("approve_apply"), F.lit("checked").alias("reviewer_note"))
    out = R.with_approvals(review, old, "id")
    return out.withColumn("applies", R.may_apply(F.col("approve_apply"), F.lit(""), F.lit(0), manual=True))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS custom_id, 'Order: ' || CAST(o_orderkey AS VARCHAR) || chr(10) || 'Priority: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Status: ' || o_orderstatus ELSE '' END AS prompt,
  'm' AS model FROM orders""")
def request_lines(spark: SparkSession, d: str) -> DataFrame:
    """Requests as JSON lines: labelled values, without those that are missing."""
    rows = table(spark, d, "orders")
    prompt = T.labelled_lines({"Order": F.col("o_orderkey").cast("string"), "Priority": F.col("o_orderpriority"), "Status": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))})
    body = F.to_json(F.struct(F.lit("m").alias("model"), prompt.alias("input")))
    line = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("custom_id"), body.alias("body")))
    back = rows.select(F.from_json(line, "custom_id string, body string").alias("r")).select("r.*")
    return back.select("custom_id", F.get_json_object("body", "$.input").alias("prompt"), F.get_json_object("body", "$.model").alias("model"))

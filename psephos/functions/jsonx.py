"""Nested records kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.dates import age_on
from psephos.functions.nulls import clean_text, col
from psephos.functions.text import male1

PERSON = "STRUCT<full_name: STRING, role: STRING, role_basis: STRING, birth_date_iso: STRING, birth_year: INT, birth_precision: STRING, gender_text: STRING, include_in_average: BOOLEAN>"
SOURCE = "STRUCT<title: STRING, url: STRING, publisher: STRING, why_relevant: STRING>"
#: The record of a leader, and of a match, as asked of an enrichment provider.
LEADER_RECORD = (
    "STRUCT<resolved: BOOLEAN, resolution_status: STRING, leader_name: STRING, leader_role: STRING, leader_role_basis: STRING, is_collective_leadership: BOOLEAN,"
    f" is_multiple_leader_case: BOOLEAN, multiple_leader_basis: STRING, leaders: ARRAY<{PERSON}>, birth_date_iso: STRING, birth_year: INT, birth_precision: STRING,"
    f" gender_text: STRING, confidence: DOUBLE, notes: STRING, sources: ARRAY<{SOURCE}>>"
)
MATCH_RECORD = (
    "STRUCT<resolved: BOOLEAN, resolution_status: STRING, selected_mpd_party_id: INT, selected_party_name_mpd: STRING, selected_from_candidate_list: BOOLEAN,"
    " candidate_rank_by_share: INT, confidence_0_100: INT, match_basis: STRING, nonmatch_reason_type: STRING, identified_party_if_absent: STRING,"
    f" reason_summary: STRING, uncertainty_note: STRING, sources: ARRAY<{SOURCE}>>"
)
CANDIDATES = "ARRAY<STRUCT<rank_by_share: INT, mpd_party_id: INT, partyfacts_id_cand: INT, partyname_mpd: STRING, share_mpd: DOUBLE, name_score: DOUBLE>>"
USAGE = (
    "STRUCT<usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, total_tokens: BIGINT, input_tokens_details: STRUCT<cached_tokens: BIGINT>,"
    " output_tokens_details: STRUCT<reasoning_tokens: BIGINT>>, output: ARRAY<STRUCT<type: STRING>>>"
)


def json_object_text(x: Column | str) -> Column:
    """The JSON object in a model's answer: without code fences, else from the first brace to the last; NULL if there is none."""
    bare = F.regexp_replace(F.regexp_replace(clean_text(x), r"(?is)^```(?:json)?\s*", ""), r"(?s)\s*```$", "")

    def inner(t: Column) -> Column:
        braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
        return F.when(F.get_json_object(t, "$").isNotNull() & t.startswith("{"), t).otherwise(F.nullif(braces, F.lit("")))

    return F.get(F.transform(F.array(bare), inner), F.lit(0))  # the text is bound to a variable, so that it is made once


def parse_record(x: Column | str, schema: str) -> Column:
    """A record by its schema; NULL where the text holds no object."""
    return F.from_json(json_object_text(x), schema)


def people(record: Column, day: Column | str) -> Column:
    """The record's leaders with age and gender; those marked as not to be counted are left out, and a record without a list
    stands for its own leader."""

    def person(name: Column, born: Column, year: Column, gender: Column) -> Column:
        age = age_on(day, born, year)
        return F.struct(clean_text(name).alias("name"), age["age"].alias("age"), age["method"].alias("method"), male1(gender).alias("male"))

    counted = F.filter(record["leaders"], lambda p: p.isNotNull() & F.coalesce(p["include_in_average"], F.lit(True)))
    listed = F.transform(counted, lambda p: person(p["full_name"], p["birth_date_iso"], p["birth_year"], p["gender_text"]))
    own = F.array(person(record["leader_name"], record["birth_date_iso"], record["birth_year"], record["gender_text"]))
    has_own = (clean_text(record["leader_name"]) != "") | record["birth_date_iso"].isNotNull() | record["birth_year"].isNotNull() | record["gender_text"].isNotNull()
    return F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).when(has_own, own).otherwise(F.slice(own, 1, 0))


def mean_of(values: Column) -> Column:
    """Mean of an array without its NULLs."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def age_method(methods: Column) -> Column:
    """How a mean age came about."""
    known = F.filter(methods, lambda m: m.isNotNull())
    kinds = F.array_distinct(known)
    one = F.when(F.size(kinds) == 1, F.concat(F.lit("mean_"), F.get(kinds, F.lit(0)))).otherwise("mean_mixed")
    return F.when(F.size(known) == 1, F.get(known, F.lit(0))).when(F.size(known) > 1, one)


def with_leaders(df: DataFrame, record: str, day: str, name: str = "who") -> DataFrame:
    """The record's leaders as a column, so that they are worked out once."""
    return df.withColumn(name, people(F.col(record), day))


def leader_metrics(record: Column, who: Column) -> list[Column]:
    """Counts, names and means over a record's leaders."""
    names = F.filter(F.transform(who, lambda p: p["name"]), lambda n: n != "")
    primary = F.coalesce(F.nullif(clean_text(record["leader_name"]), F.lit("")), F.get(names, F.lit(0)))
    male = mean_of(F.transform(who, lambda p: p["male"]))
    return [
        F.size(who).alias("leader_count_total"),
        F.size(F.filter(who, lambda p: p["age"].isNotNull())).alias("leader_count_age"),
        F.size(F.filter(who, lambda p: p["male"].isNotNull())).alias("leader_count_gender"),
        primary.alias("leader_name_primary"),
        F.when(F.size(names) > 1, F.array_join(names, "; ")).otherwise(primary).alias("leader_name_joined"),
        mean_of(F.transform(who, lambda p: p["age"])).alias("candidate_age"),
        age_method(F.transform(who, lambda p: p["method"])).alias("candidate_age_method"),
        male.alias("candidate_male1"),
        (1 - male).alias("candidate_female1"),
        (F.coalesce(record["is_multiple_leader_case"], F.lit(False)) | (F.size(who) > 1)).alias("multiple_leaders"),
    ]


def member_by_id(items: Column, field: str, wanted: Column | str) -> Column:
    """The first struct of an array whose ``field`` is ``wanted``, or NULL."""
    return F.get(F.filter(items, lambda x: x[field] == col(wanted)), F.lit(0))


def has_member(items: Column, field: str, wanted: Column | str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x[field] == col(wanted)), F.lit(False))


def tally(values: Column) -> Column:
    """'a:2; b:1' of an array's values, in order of the values."""
    kinds = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
    return F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(":"), F.size(F.filter(values, lambda v: v == k)).cast("string"))), "; ")


def usage_columns(raw: Column | str) -> list[Column]:
    """Token counts and web searches of a provider's raw answer."""
    r = F.from_json(col(raw), USAGE)
    calls = F.coalesce(F.size(F.filter(r["output"], lambda o: o["type"] == "web_search_call")), F.lit(0))
    return [
        r["usage"]["input_tokens"].alias("usage_input_tokens"), r["usage"]["output_tokens"].alias("usage_output_tokens"),
        r["usage"]["total_tokens"].alias("usage_total_tokens"), r["usage"]["input_tokens_details"]["cached_tokens"].alias("usage_cached_tokens"),
        r["usage"]["output_tokens_details"]["reasoning_tokens"].alias("usage_reasoning_tokens"), calls.alias("web_search_calls"),
    ]

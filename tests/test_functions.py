"""Hand-derived cases of functions and operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from psephos.functions import dates as D
from psephos.functions import numeric as N
from psephos.functions import text as T
from psephos.functions import urls as U
from psephos.functions.nulls import clean_text, collapse_text, finite, to_num
from psephos.operators import aggregates as A
from psephos.operators import joins as J
from psephos.operators import rules as R
from psephos.operators import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1.5", 1.5), (" 1e3 ", 1000.0), ("1d", None), ("abc", None), ("", None), ("inf", math.inf), ("nan", None)])
def test_to_num(spark, text, want):
    assert one(spark, to_num(F.lit(text))) == want


def test_texts(spark):
    assert one(spark, collapse_text(F.lit(" a  \t b "))) == "a b"
    assert one(spark, clean_text(F.lit(" None "))) == "" and one(spark, clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, finite(F.lit(float("inf")))) is False and one(spark, finite(F.lit(None).cast("double"))) is False
    assert one(spark, T.match_name(F.lit("Élan & Co."))) == "elan and co"
    for raw, fixed in (("Ã\x89lan", "Élan"), ("Ã‰lan", "Élan"), ("PaÅ‚ac", "Pałac"), ("Ä\x87iriÄ\x87", "ćirić"), ("Åse", "Åse"), ("Ã and Å", "Ã and Å")):
        assert one(spark, T.repair_mojibake(F.lit(raw))) == fixed
    assert one(spark, T.repaired_name(F.lit("Ã‰lan & PaÃ±o "))) == "elan and pano"
    assert one(spark, T.repair_mojibake(F.lit("Ã©lan"))) == "élan" and one(spark, T.repair_mojibake(F.lit("élan"))) == "élan"
    assert one(spark, T.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75 and one(spark, T.similarity(F.lit(""), F.lit("a"))) == 0
    assert one(spark, T.election_key(F.lit("New Land"), F.lit(2001.0))) == "new2001"


@pytest.mark.parametrize(("text", "want"), [("Female", 0.0), ("female leader", None), ("male leader", 1.0), ("x", None), ("m", 1.0)])
def test_male1(spark, text, want):
    assert one(spark, T.male1(F.lit(text))) == want


@pytest.mark.parametrize(("born", "year", "want"), [("1976-02-01", None, (41.0, "exact_date")), ("1970-01-26", 1, (47.0, "exact_date")), ("1976-10-29", None, (41.0 - 1, "exact_date")), ("1976-10-28", None, (41.0, "exact_date")), (None, 1970, (47.0, "birth_year_only")), ("x", None, (None, None))])
def test_age(spark, born, year, want):
    got = one(spark, D.age_on(F.lit(dt.date(2017, 10, 28)), F.lit(born).cast("string"), F.lit(year).cast("int")))
    assert (got.age, got.method) == want


def test_dates(spark):
    assert one(spark, D.parse_day_first(F.lit("24nov2002"))) == dt.date(2002, 11, 24) and one(spark, D.parse_day_first(F.lit("3.2.2001"))) == dt.date(2001, 2, 3)
    assert one(spark, D.from_parts(F.lit(2001), F.lit(2), F.lit(30))) is None and one(spark, D.from_parts(F.lit(2001), F.lit(2), F.lit(None))) == dt.date(2001, 2, 15)
    assert one(spark, D.iso_text(F.lit(None).cast("date"))) == ""


@pytest.mark.parametrize(("gap", "band", "alert"), [(2.0, "within_2pp", ""), (5.0, "within_5pp", ""), (5.1, "within_10pp", "large_gap_review"), (10.0, "within_10pp", "large_gap_review"), (10.1, "over_10pp", "very_large_gap_check"), (None, "", "")])
def test_gaps(spark, gap, band, alert):
    g = F.lit(gap).cast("double")
    assert one(spark, N.gap_band(g)) == band and one(spark, N.gap_alert(g)) == alert


@pytest.mark.parametrize(("code", "want"), [(5555, None), (213, 1.0), (520, 3.0), (311, 2.0)])
def test_education(spark, code, want):
    assert one(spark, N.education_category(F.lit(None).cast("double"), F.lit(code))) == want


def test_p_value(spark):
    assert abs(one(spark, N.p_value(F.lit(1.96))) - 0.05) < 1e-4


def test_url(spark):
    assert one(spark, U.normalize_url(F.lit("HTTPS://www.X.org//a//b/?utm_source=1&q=2#f"))) == "https://x.org/a/b?q=2"
    assert one(spark, U.source_key(F.lit(""), F.lit("A Title"))) == "title::a title"
    assert one(spark, U.publisher_of(F.lit("en.wikipedia.org"))) == "Wikipedia"


def test_wmean(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", None, 5.0), ("a", 3.0, 1.0), ("b", 2.0, 0.0)], "g string, x double, w double")
    assert {r.g: r.m for r in df.groupBy("g").agg(A.wmean("x", "w").alias("m")).collect()} == {"a": 2.0, "b": None}


def test_shares(spark):
    df = spark.createDataFrame([(1, "A", 2.0), (1, "B", 3.0), (1, None, 5.0)], "m int, p string, w double")
    assert {r.p: r.s for r in df.select("p", W.share("w", ["m"], "p").alias("s")).collect()} == {"A": 0.2, "B": 0.3, None: None}
    s = spark.createDataFrame([(1, 0.7), (1, 0.5)], "m int, s double").select(W.rescaled("s", ["m"]).alias("s")).collect()
    assert sorted(round(r.s, 6) for r in s) == [0.4125, 0.5775]


def test_leave_one_out(spark):
    df = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("f", 6.0), ("g", 4.0)], "f string, x double")
    got = {(r.f, r.x): r.lo for r in df.select("f", "x", W.leave_one_out("x", ["f"]).alias("lo")).collect()}
    assert got == {("f", 1.0): 4.0, ("f", 2.0): 3.5, ("f", 6.0): 1.5, ("g", 4.0): None}


def test_lag_and_constant(spark):
    df = spark.createDataFrame([("p", 2002, 1.0), ("p", 2010, 2.0), (None, 2003, 3.0)], "k string, y int, x double")
    assert {r.y: r.l for r in df.select("y", W.previous("x", "k", ["y"]).alias("l")).collect()} == {2002: None, 2010: 1.0, 2003: None}
    assert [r.z for r in W.standardised(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", "z").collect()] == [None, None]


def test_canonical_name(spark):
    df = spark.createDataFrame([("List",), ("Green Party",), ("Greens",), (None,)], "n string")
    assert df.agg(A.canonical_name("n").alias("n")).first().n == "Green Party"
    assert df.where("n IS NULL").agg(A.canonical_name("n").alias("n")).first().n == ""


def test_latest_mode(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None)], "k string, v int")
    assert A.latest_mode(df, ["k"], "v", "m").first().m == 2


def test_previous_row_over_a_gap(spark):
    """The previous observed row counts, whatever years lie between."""
    df = spark.createDataFrame([("a", 1996, 1.0), ("a", 1999, 2.0), ("a", 2000, None), ("a", 2003, 4.0), ("b", 1999, 9.0)], "k string, y int, x double")
    got = {(r.k, r.y): r.p for r in df.withColumn("p", W.previous("x", "k", ["y"])).collect()}
    assert got == {("a", 1996): None, ("a", 1999): 1.0, ("a", 2000): 2.0, ("a", 2003): None, ("b", 1999): None}


def test_cardinality(spark):
    left, right = spark.createDataFrame([(None,), (1,)], "k int"), spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    assert {(r.k, r.v) for r in J.checked_join(left, right, ["k"]).collect()} == {(None, "x"), (1, "y")}
    with pytest.raises(J.CardinalityError):
        J.checked_join(left, right.union(right), ["k"])


def test_fuzzy_margin(spark):
    t = spark.createDataFrame([("X", 1, "t1", "", "alpha beta party", 10.0)], "c string, y int, id string, loc string, eng string, share double")
    near = [("X", 1, "o1", "", "alpha beta party", 10.0), ("X", 1, "o2", "", "alpha beta part", 10.0)]
    pool = spark.createDataFrame(near, "c string, y int, oid string, loc string, eng string, share double")
    args = (["c", "y"], "id", "oid", ("loc", "eng"), "share")
    assert J.fuzzy_match(t, pool, *args).first().accepted is False
    alone = J.fuzzy_match(t, pool.where("oid = 'o1'"), *args).first()
    assert alone.accepted is True and alone.second is None and alone.score == 100


def test_trust(spark):
    x = dict(generic=False, n=2, domains=2, non_wiki=2, independent=2, independent_domains=2, reference=2, high=2, high_domains=2, party_official=0, basis="exact_name", score=0.9, rank=1, calls=1)
    lit = {k: F.lit(v) for k, v in x.items()}
    yes = F.lit(True)
    got = one(spark, R.trust_cap(lit, yes, F.lit(""), yes, yes))
    assert (got.cap, got.flags) == (100, "") and one(spark, R.trust_score(yes, F.lit(97), F.lit(got.cap))) == 97
    assert one(spark, R.review_bucket(yes, F.lit(""), yes, F.lit(97), lit)) == "strong_candidate"
    few = lit | {"n": F.lit(1), "domains": F.lit(1), "independent": F.lit(1)}
    got = one(spark, R.trust_cap(few, yes, F.lit(""), yes, yes))
    assert got.cap == 72 and got.flags.split("; ") == ["only_one_source", "not_enough_independent_nonwiki_verification_for_auto"]
    assert one(spark, R.trust_cap(lit, yes, F.lit(""), F.lit(False), yes)).flags == "selected_candidate_not_in_allowed_list"


def test_never_overwrite(spark):
    df = spark.createDataFrame([(5, 9), (None, 9), (None, None)], "v int, p int").select(*R.never_overwrite(F.col("v"), F.col("p")))
    assert [tuple(r) for r in df.collect()] == [(5, "validated", 0), (9, "ai_match", 1), (None, "", 0)]


def test_notes(spark):
    assert one(spark, R.nonmatch_reason(F.lit(""), F.lit(False), F.lit(False), F.lit(""), [F.lit("The true party is absent here")])) == "candidate_absent_from_allowed_list"
    assert one(spark, N.gap_note(F.lit(True), F.lit(12.0), F.lit(10.0), F.lit("within_2pp"))) == "ESS 12.00% vs MPD 10.00% (+2.00 pp; within_2pp)"

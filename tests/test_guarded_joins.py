"""Cardinality checked inside the plan."""

from __future__ import annotations

import json

import pytest

from psephos.operators import joins as J


def jobs_of(spark, run):
    """How many jobs a call starts, by the session's own status tracker."""
    sc, group = spark.sparkContext, "guarded"
    sc.setJobGroup(group, group)
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(None, 1, "p"), ("a", 1, "q"), ("a", 2, "r"), ("z", 9, "s")], "k string, y int, l string")
    right = spark.createDataFrame([(None, 1, "x", 1.5), ("a", 1, None, None), ("a", 2, "y", 2.5)], "k string, y int, v string, w double")
    return left, right


def test_same_as_the_eager_check(spark, sides):
    left, right = sides
    for how in ("left", "inner"):
        for null_safe in (True, False):
            want = J.checked_join(left, right, ["k", "y"], how, null_safe=null_safe)
            got, started = jobs_of(spark, lambda how=how, null_safe=null_safe: J.guarded_join(left, right, ["k", "y"], how, null_safe=null_safe))
            assert started == 0 and got.schema == want.schema
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_error_names_side_and_key(spark, sides):
    left, right = sides
    twice = right.union(right.where("y = 2"))
    for null_safe in (True, False):
        joined = J.guarded_join(left, twice, ["k", "y"], null_safe=null_safe)
        for read in (joined, joined.select("l"), joined.groupBy("k").count()):  # whatever columns are read
            with pytest.raises(Exception, match="right side has several rows for") as e:
                read.collect()
            assert json.dumps({"k": "a", "y": "2"}, separators=(",", ":")) in str(e.value)
    with pytest.raises(Exception, match="left side has several rows for"):
        J.guarded_join(left.union(left), right, ["k", "y"], validate="1:1").collect()
    missing = right.union(right.where("k IS NULL"))
    with pytest.raises(Exception, match='"k":null'):
        J.guarded_join(left, missing, ["k", "y"]).collect()


def test_empty_and_hot(spark, sides):
    left, right = sides
    assert J.guarded_join(left, right.limit(0), ["k", "y"]).where("v IS NULL").count() == 4
    assert J.guarded_join(left.limit(0), right, ["k", "y"]).count() == 0
    many = spark.range(20000).selectExpr("'a' AS k", "1 AS y", "id AS l")  # one left key with nearly all rows
    assert J.guarded_join(many, right, ["k", "y"]).where("v IS NULL AND l IS NOT NULL").count() == 20000

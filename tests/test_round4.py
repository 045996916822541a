"""Work that grows no faster than its input: rows dealt out, names met by an index."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.functions import urls as U
from psephos.operators import joins as J
from psephos.operators import resample as R
from psephos.operators import similarity as N
from psephos.operators import source_lists as S
from psephos.plans import models


def test_answers_are_dealt_out(spark, data):
    """A file of one row group is not left to one task."""
    assert models.raw_answers(spark, data).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_grading_tries_no_condition_twice(spark):
    """Inside a lambda nothing is shared: an expression that is named twice is worked out twice."""
    sources = "array<struct<title: string, url: string, publisher: string, why_relevant: string>>"
    df = spark.createDataFrame([], f"m {sources}").select(S.effective_sources(F.col("m"), F.col("m")).alias("s"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("reuters") <= 1 and 0 < plan.count("[A-Za-z][A-Za-z0-9+.-]*") <= 20


def test_quality_by_parts_of_texts(spark):
    rows = [("x.gov.uk", "", "", "a"), ("", "OSCE/ODIHR", "", ""), ("news.bbc.co.uk", "", "", ""), ("b.example", "", "", "official party"), ("", "", "", ""), (None, None, None, "axb")]
    df = spark.createDataFrame(rows, "d string, p string, t string, w string")
    got = [tuple(r) for r in df.select(U.source_quality("d", "p", "t", "w").alias("q")).select("q.*").collect()]
    assert got == [("official_public_source", 100), ("intergovernmental_reference", 96), ("news_media", 66), ("official_party_source", 76), ("other_web", 40), ("other_web", 55)]


@pytest.mark.parametrize("kind", N.KINDS)
def test_numbered_names_are_decided_by_close_ones(spark, monkeypatch, kind):
    """No block of such names is compared pair by pair, and the best two are those of all pairs."""
    left = []
    rest = J._best_two
    monkeypatch.setattr(J, "_best_two", lambda own, *more: (left.append(own.count()), rest(own, *more))[1])
    t = [("x", k, f"local {k}" if k % 3 == 0 else "", f"supplier {k:09d}", k % 7 / 10) for k in range(120)]
    p = [(b, k, loc, "other name" if k % 5 == 0 else eng, s + (k % 4 == 0)) for b, k, loc, eng, s in t if k % 7 != 3]
    made = [spark.createDataFrame(rows, f"b string, {key} int, loc string, eng string, share double") for rows, key in ((t, "id"), (p, "oid"))]
    got = {r.id: (r.best_id, r.score, r.second) for r in J.fuzzy_match(*made, ["b"], "id", "oid", ("loc", "eng"), "share", kind).collect()}
    assert sum(left) <= 12
    for _, k, loc, eng, s in t:
        near = [o for o in p if abs(s - o[4]) <= 1.0]
        both = N.joined(loc, eng)
        sims = np.max([N.similarities([a] * len(near), [f(o) for o in near], kind) for a, f in ((loc, lambda o: o[2]), (eng, lambda o: o[3]), (both, lambda o: N.joined(o[2], o[3])), (loc, lambda o: o[3]), (eng, lambda o: o[2]))], axis=0)
        best = sorted((-(x * 100 - abs(s - o[4])), o[1]) for x, o in zip(sims, near, strict=True))[:2]
        assert got[k] == (best[0][1], pytest.approx(-best[0][0]), pytest.approx(-best[1][0]))


def test_names_that_have_not_met_stay_below_the_bound():
    rng = random.Random(3)
    names = ["".join(rng.choice("ab1") for _ in range(rng.choice((1, 3, 8, 19, 22, 70)))) for _ in range(60)]
    kept = {a: N.shortened(a) for a in names}
    for a in names:
        for b in names:
            common = (Counter(N.sign(a)) & Counter(N.sign(b))).total()
            if not kept[a] & kept[b]:
                for kind in N.KINDS:
                    assert N.similarities([a], [b], kind)[0] <= N.far_bound(len(a), len(b), common, kind) + 1e-12


def test_resampling_sorts_the_ranges_that_hold_a_draw(spark, monkeypatch):
    seen = []
    held = R._held
    monkeypatch.setattr(R, "_held", lambda rows, *more: (seen.append(rows.count()), held(rows, *more))[1])
    df = spark.range(20000).select(F.lit("m").alias("m"), F.col("id").alias("r"), F.lit(1.0).alias("w"))
    assert R.weighted_resample(df, "m", "r", "w", draws=5).count() == 5
    assert seen[-1] < 1000


def test_full_model_reads_products_from_a_table(spark, data):
    rows, _, _ = models.demand_inputs(spark, data)
    plan = rows._jdf.queryExecution().withCachedData().toString()
    assert "l_quantity" not in plan.split("InMemoryRelation")[0]

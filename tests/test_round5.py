"""Demand's passes are single jobs, and its errors are those of its own deltas; pairs of rows of close names stay in their tasks."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from psephos.operators import econ as E
from psephos.operators import joins as J
from psephos.operators import similarity as N


@pytest.fixture(scope="module")
def markets(spark):
    rng = np.random.default_rng(5)
    draws, made = E.normal_quantiles(E.halton(30, 1))[:, 0], []
    for m in range(24):
        n = 3 + m % 3
        x, z = rng.normal(size=n), rng.normal(size=n)
        u = (-1.0 + 0.8 * x + 0.3 * rng.normal(size=n))[:, None] + 1.5 * x[:, None] * draws
        share = (np.exp(u) / (1 + np.exp(u).sum(axis=0))).mean(axis=1)
        made += [(f"m{m}", j, float(share[j]), 1.0, float(x[j]), float(x[j] ** 2), float(x.sum() - x[j]), float(z[j])) for j in range(n)]
    products = spark.createDataFrame(made, "market string, product long, share double, one double, x double, xx double, rival double, z double").cache()
    return products, spark.createDataFrame([], "market string, agent int"), E.Demand(["one", "x"], ["x"], [], ["one", "x", "xx", "rival", "z"], nodes=30)


def test_a_pass_is_one_job(spark, markets):
    products, agents, model = markets
    products.count()
    spark.sparkContext.setJobGroup("demand", "fit")
    fit = model.fit(products, agents, np.array([0.3]))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("demand")
    spark.sparkContext.setJobGroup("none", "none")
    assert fit["passes"] >= 5 and len(jobs) <= fit["passes"] + 2  # the first also packs the markets


def test_errors_are_of_the_deltas_at_the_estimates(markets):
    products, agents, model = markets
    p = products.toPandas().sort_values(["market", "product"])
    z, x = p[model.instruments].to_numpy(), p[model.linear].to_numpy()
    delta = lambda s: model.deltas(products, agents, np.array([s]), np.zeros((1, 0))).toPandas().sort_values(["market", "product"])["delta"].to_numpy()
    for start in (0.05, 0.3, 0.5, 1.0, 2.5):
        fit = model.fit(products, agents, np.array([start]), steps=1, tolerance=0.0)  # ends where no step gains
        s, h = float(fit["sigma"][0]), 1e-5
        xi, slope = delta(s) - x @ fit["beta"], (delta(s + h) - delta(s - h)) / (2 * h)
        g, w = z.T @ np.column_stack([slope, -x]), np.linalg.pinv(z.T @ z)
        bread = np.linalg.pinv(g.T @ w @ g)
        want = np.sqrt(np.diag(bread @ g.T @ w @ (z.T * xi**2) @ z @ w @ g @ bread))
        assert np.allclose(np.concatenate([fit["sigma_se"], fit["beta_se"]]), want, rtol=1e-3)


def test_runs_of_many_pairs_are_those_of_one():
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("ab 01é😀") for _ in range(rng.choice((0, 1, 4, 12, 30, 99, 130))))
    a = [text() for _ in range(600)]
    b = [x[:5] + rng.choice("a1") + x[6:] if k % 2 else text() for k, x in enumerate(a)]
    assert N.similarities(a, b, "ratio").tolist() == [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)]


def _moved(spark, group: str) -> int:
    """Rows that the stages of a job group have written for others."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.parametrize("kind", N.KINDS)
def test_pairs_of_rows_are_not_shuffled(spark, kind):
    """Each of 60 names occurs in 40 blocks and has some fifteen close ones; in half of the blocks a candidate's share is unknown."""
    t = [(b, f"{b}|{k}", "", f"supplier {k:09d}", (k * 7 + b) % 11 / 20) for b in range(40) for k in range(60)]
    p = [(b, int(i.split("|")[1]), loc, eng, None if b % 2 and i.endswith("5") else s + 0.1) for b, i, loc, eng, s in t]
    made = [spark.createDataFrame(rows, f"b int, {key}, loc string, eng string, share double") for rows, key in ((t, "id string"), (p, "oid int"))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup(f"close-{kind}", "names")
    try:
        got = {r.id: (r.best_id, r.score, r.second) for r in J.fuzzy_match(*made, ["b"], "id", "oid", ("loc", "eng"), "share", kind).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setJobGroup("none", "none")
    names, pairs = [f"supplier {k:09d}" for k in range(60)], 0
    sim = {a: N.similarities([a] * 60, names, kind) for a in names}
    pool = {b: [r for r in p if r[0] == b] for b in range(40)}
    for b, i, _, eng, s in t:
        scored = sorted((-(sim[eng][o[1]] * 100 - (abs(s - o[4]) if o[4] is not None else 0)), o[1]) for o in pool[b])
        pairs += sum(sim[eng] > 0.9)
        assert got[i] == (scored[0][1], pytest.approx(-scored[0][0]), pytest.approx(-scored[1][0]))
    assert len(got) == 2400 and _moved(spark, f"close-{kind}") < pairs


def test_pool_names_of_other_blocks_alone(spark):
    """Names that occur in no block of the targets take part in no pair."""
    t = [("x", k, "", f"supplier {k:09d}", 0.1) for k in range(12)]
    p = [("x" if k % 3 else "y", k, "", f"supplier {k:09d}", 0.1 + k / 100) for k in range(15)]
    made = [spark.createDataFrame(rows, f"b string, {key} int, loc string, eng string, share double") for rows, key in ((t, "id"), (p, "oid"))]
    got = {r.id: (r.best_id, r.score, r.second) for r in J.fuzzy_match(*made, ["b"], "id", "oid", ("loc", "eng"), "share").collect()}
    for _, k, _, eng, s in t:
        scored = sorted((-(SequenceMatcher(None, eng, o[3]).ratio() * 100 - abs(s - o[4])), o[1]) for o in p if o[0] == "x")
        assert got[k] == (scored[0][1], pytest.approx(-scored[0][0]), pytest.approx(-scored[1][0]))

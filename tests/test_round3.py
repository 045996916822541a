"""Numbering by whole keys, mergeable top-k, the similarity join, and demand without stubs."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import demand
from psephos.operators import econ as E
from psephos.operators import joins as J
from psephos.operators import similarity as S
from psephos.operators import windows as W


def test_one_value_in_the_first_column_spreads(spark):
    made = [("same", k % 5, float(k * 7919 % 3001)) for k in range(3000)] + [("same", None, None)] * 3
    df = spark.createDataFrame(made, "a string, b int, c double").repartition(5)
    sizes = [r["count"] for r in W.ranged(df, ["a", "b", "c"], "r").groupBy("r").count().collect()]
    assert len(sizes) > 500 and max(sizes) < 100 and sum(sizes) == 3003
    got = sorted((r.id, (r.b is not None, r.b or 0, r.c is not None, r.c or 0.0)) for r in W.row_numbers(df, ["a", "b", "c"], "id").collect())
    assert [i for i, _ in got] == list(range(1, 3004)) and [k for _, k in got] == sorted(k for _, k in got)


def test_numbers_by_expressions(spark):
    df = spark.createDataFrame([("x", None), ("x", 2), ("w", None), ("w", 1)], "a string, b int")
    got = {(r.a, r.b): r.id for r in W.row_numbers(df, ["a", F.col("b").isNull(), "b"], "id").collect()}
    assert got == {("w", 1): 1, ("w", None): 2, ("x", 2): 3, ("x", None): 4}
    assert W.row_numbers(df.limit(0), ["a"], "id").count() == 0


def test_top_candidates_keep_few(spark):
    """A block's first candidates, its size, and a plan that limits before it shuffles."""
    made = [("big" if k % 10 else f"b{k % 3}", k, float(k * 37 % 101) if k % 4 else None) for k in range(2000)] + [(None, 1, 1.0), (None, 2, 3.0)]
    df = spark.createDataFrame(made, "b string, id int, w double").repartition(6)
    order = [F.col("w").desc_nulls_last(), F.col("id")]
    out = J.top_candidates(df, ["b"], order, ["id", "w"], "id", top=3)
    by = defaultdict(list)
    for b, i, w in made:
        by[b].append((w is None, -(w or 0), i))
    assert {r.b: (r.n, r.top_ids) for r in out.collect()} == {b: (len(v), "|".join(str(i) for *_, i in sorted(v)[:3])) for b, v in by.items()}
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j + 1] + 1, now[-1] + 1, row[j] + (x != y)))
        row = now
    return row[-1]


def scored(a: str, b: str, kind: str) -> float:
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio() if kind == "ratio" else 1 - levenshtein(a, b) / max(len(a), len(b))


def names(rng: random.Random, n: int) -> list[str]:
    words = ["party", "of", "the", "green", "left", "union", "nationale", "é", "日本", "a" * 30, ""]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))).strip() for _ in range(n)]


def test_distances_and_bounds():
    rng = random.Random(4)
    a, b = names(rng, 400), names(rng, 400)
    assert S.edit_distances(a, b).tolist() == [levenshtein(x, y) for x, y in zip(a, b, strict=True)]
    letters = {c: k for k, c in enumerate("aeinp")}
    x, y = S.Names(a, letters), S.Names(b, letters)
    for kind in S.KINDS:
        most = S.bounds(x, y, kind)
        for i, j in ((rng.randrange(len(x.names)), rng.randrange(len(y.names))) for _ in range(500)):
            assert scored(x.names[i], y.names[j], kind) <= most[i, j] + 1e-12


@pytest.mark.parametrize("kind", S.KINDS)
def test_similarity_join_as_all_pairs(spark, monkeypatch, kind):
    """Shares far and near, unknown on either side, missing names, equal scores; blocks in several parts."""
    monkeypatch.setattr(S, "TARGETS", 7)
    monkeypatch.setattr(S, "POOL", 5)
    monkeypatch.setattr(S, "ROUND", 2)
    rng = random.Random(8)
    share = lambda: rng.choice([None, 1.0, 2.0, 2.5, 40.0, round(rng.uniform(0, 12), 2)])
    block = lambda: rng.choice([("x", 1), ("x", 1), ("y", 1), ("y", None)])
    rows = lambda n: [(*block(), k, rng.choice([m, None]), m2, share()) for k, (m, m2) in enumerate(zip(names(rng, n), names(rng, n), strict=True))]
    targets, pool = rows(60), [*rows(50), ("z", 1, 99, "only", "one", 1.0)]
    schema = "c string, y int, {} int, loc string, eng string, share double"
    t, p = spark.createDataFrame(targets, schema.format("id")), spark.createDataFrame(pool, schema.format("oid"))
    got = {r.id: r for r in J.fuzzy_match(t, p, ["c", "y"], "id", "oid", ("loc", "eng"), "share", kind).collect()}
    want = {}
    both = lambda a, b: " ".join(x for x in (a, b) if x)
    for c, y, i, loc, eng, s in targets:
        own = [o for o in pool if (o[0], o[1]) == (c, y) and y is not None]
        gap = lambda o, s=s: None if s is None or o[5] is None else abs(s - o[5])
        near = [o for o in own if gap(o) is None or gap(o) <= 1.0] or own
        found = []
        for o in near:
            pairs = ((loc, o[3]), (eng, o[4]), (both(loc, eng), both(o[3], o[4])), (loc, o[4]), (eng, o[3]))
            found.append((-(max(scored(a or "", b or "", kind) for a, b in pairs) * 100 - min(gap(o) or 0.0, 5.0)), o[2], gap(o)))
        found.sort(key=lambda r: r[:2])
        if found:
            second = -found[1][0] if len(found) > 1 else None
            want[i] = (found[0][1], -found[0][0], second, found[0][2])
    assert got.keys() == want.keys() and len(want) > 30
    for i, (oid, score, second, gap) in want.items():
        r = got[i]
        assert r.best_id == oid and math.isclose(r.score, score, abs_tol=1e-9) and r.share_gap == gap
        assert (r.second is None) == (second is None) and (second is None or math.isclose(r.second, second, abs_tol=1e-9))
        assert r.accepted == (score >= 94 and (second is None or score - second >= 5))


def simulated(spark, sigma, pi, beta, markets=80, products=5, nodes=40, seed=3):
    """Markets whose shares follow the model, with a random coefficient on x and demographic effects."""
    rng = np.random.default_rng(seed)
    draws = demand.normal_quantiles(demand.halton(nodes, 1))
    made, people = [], []
    for m in range(markets):
        income = rng.normal(size=nodes)
        x, z = rng.normal(size=products), rng.normal(size=products)
        u = (beta[0] + beta[1] * x + 0.01 * rng.normal(size=products))[:, None] + x[:, None] * (sigma * draws[:, 0] + pi * income)
        share = (np.exp(u) / (1 + np.exp(u).sum(axis=0))).mean(axis=1)
        level = float(income.mean())
        made += [(f"m{m}", j, float(share[j]), 1.0, 0.0, float(x[j]), float(x[j] ** 2), float(x.sum() - x[j]), float((x**2).sum()), float(x[j] * level), float(z[j])) for j in range(products)]
        people += [(f"m{m}", a, float(income[a])) for a in range(nodes)]
    p = spark.createDataFrame(made, "market string, product long, share double, one double, price double, x double, xx double, rival double, spread double, level double, z double")
    return p.cache(), spark.createDataFrame(people, "market string, agent int, income double").cache()


INSTRUMENTS = ["one", "x", "xx", "rival", "spread", "level"]


def test_fit_finds_spread_and_demographic_effect(spark):
    products, agents = simulated(spark, sigma=1.2, pi=0.7, beta=(-1.0, 0.5))
    model = E.Demand(["one", "price", "x"], ["x"], ["income"], INSTRUMENTS, nodes=40, fixed={"price": 0.0}, robust=False)
    fit = model.fit(products, agents, np.array([0.3, 0.0]))
    assert fit["converged"] and fit["unsolved"] == 0 and fit["n"] == 400 and fit["passes"] < 40
    assert abs(fit["sigma"][0] - 1.2) < 0.1 and abs(fit["pi"][0, 0] - 0.7) < 0.1 and np.allclose(fit["beta"], [-1.0, 0.0, 0.5], atol=0.05)
    assert math.isnan(fit["beta_se"][1]) and 0 < fit["sigma_se"][0] < 0.2 and 0 < fit["beta_se"][2] < 0.2
    got = model.deltas(products, agents, fit["sigma"], fit["pi"], fit["beta"]).orderBy("market", "product").limit(5).collect()
    assert all(r.solved and r.by_x != 0 and 0 < r.own < 0.25 for r in got)


def test_derivatives_are_those_of_differences():
    rng = np.random.default_rng(0)
    draws, demo = demand.normal_quantiles(demand.halton(30, 2)), rng.normal(size=(30, 2))
    x, share = rng.normal(size=(4, 2)), rng.dirichlet(np.ones(5))[:4]
    market, theta = demand.Market(x, draws, demo), np.array([0.5, 0.2, 0.1, -0.3, 0.4, 0.2])

    def solved(t):
        mu = x @ market.taste(t).T
        delta, done = demand.contraction(np.log(share), mu, np.log(share), 1e-13)
        assert done
        return delta, demand.probabilities(delta, mu)

    delta, q = solved(theta)
    assert np.allclose(q.mean(axis=1), share, atol=1e-11)
    slopes = market.slopes(q)
    for k in range(6):
        h = 1e-5 * np.eye(6)[k]
        assert np.allclose(slopes[:, k], (solved(theta + h)[0] - solved(theta - h)[0]) / 2e-5, atol=1e-6)


def test_queries_estimate(spark, data):
    """Both demand queries run to their end."""
    from psephos.plans import models

    one = models.demand_random_coefficients(spark, data).first()
    assert one.converged and one.unsolved == 0 and math.isfinite(one.objective)
    full = models.demand_full_model(spark, data).collect()
    assert len(full) == 2 + 6 + 6 and {r.converged for r in full} == {True} and {r.unsolved for r in full} == {0}
    assert {r.parameter: r.estimate for r in full}["beta_prices"] == 0


def numpy_fit(rows, spec, method, z):
    """(names, b, cov, n, first-stage F) by matrices, or None where there are too few rows."""
    moved = {
        "ideal_only": ("x", {}), "lag_only": ("x-lagx", {}), "family_only": ("x-fam", {}), "ideal_lag": ("x", {"lag": "lagx"}), "ideal_family": ("x", {"fam": "fam"}), "lag_family": ("x-fam", {"lag_f": "lagx-fam"}),
        "ideal_lag_family": ("x", {"lag": "lagx", "fam": "fam"}),
    }
    y, controls = moved[spec]
    m = np.column_stack([rows.eval(c).to_numpy(float) for c in (y, *controls.values(), "d", *z)])
    ok = np.isfinite(m).all(axis=1)
    m, party = m[ok], rows["party"][ok]
    if spec.startswith("ideal"):
        for p in party.unique():
            m[party == p] -= m[party == p].mean(axis=0)
    k, n = len(controls), len(m)
    y, w, d, zz = m[:, 0], m[:, 1 : 1 + k], m[:, 1 + k], m[:, 2 + k :]
    x, q = np.column_stack([w, d]), np.hstack([w, zz])
    if method == "OLS":
        inverse = np.linalg.pinv(x.T @ x)
        b = inverse @ x.T @ y
        u = y - x @ b
        return [*controls, "d"], b, inverse @ (x.T * u**2) @ x @ inverse * n / (n - k - 1), n, math.nan
    if n <= k + 3:
        return None
    hat = q @ np.linalg.pinv(q.T @ q) @ q.T @ x
    inverse = np.linalg.pinv(hat.T @ hat)
    b = inverse @ hat.T @ y
    u = y - x @ b
    rss = lambda a: float(((d - a @ np.linalg.lstsq(a, d, rcond=None)[0]) ** 2).sum()) if a.shape[1] else float((d**2).sum())
    full, restricted = rss(q), rss(w) if k else float(((d - d.mean()) ** 2).sum())
    return [*controls, "d"], b, inverse @ (hat.T * u**2) @ hat @ inverse, n, ((restricted - full) / len(z)) / (full / (n - q.shape[1] - 1))


def test_all_fits_of_the_sweep(spark, data):
    """56 fits against matrices, and few passes over the rows."""
    from psephos.plans import models

    passes = []
    collect = type(spark.range(1)).collect
    kind = type(spark.range(1))
    kind.collect = lambda self: passes.append(1) or collect(self)
    try:
        got = {(r["sample"], r["dim"], r["spec"], r["method"]): r for r in models.spec_sweep(spark, data).toPandas().to_dict("records")}
    finally:
        kind.collect = collect
    assert len(got) == 56 and len(passes) <= 4
    panels = {dim: models.supply(spark, data, c).toPandas() for dim, c in (("econ", "x"), ("cult", "x2"))}
    fits = 0
    for (sample, dim, spec, method), r in got.items():
        rows = panels[dim]
        if sample == "ever_large":
            rows = rows[rows.groupby("party")["d"].transform("max") >= 0.12]
        want = numpy_fit(rows, spec, method, models.Z)
        assert want is not None and not r["warning"]
        names, b, cov, n, f = want
        assert r["n"] == n and math.isclose(r["beta_d"], b[-1], rel_tol=1e-5, abs_tol=1e-9)
        assert math.isclose(r["se_d"], math.sqrt(cov[-1, -1]), rel_tol=1e-4, abs_tol=1e-9)
        assert (math.isnan(f) and math.isnan(r["first_stage_f"])) or math.isclose(r["first_stage_f"], f, rel_tol=1e-4)
        if abs(b[-1]) < 1e-12:  # nothing is left of d after demeaning
            continue
        fits += 1
        named = dict(zip(names, b, strict=True))
        k = E.kappas(spec, named["d"], named.get("lag", named.get("lag_f", 0.0)), named.get("fam", 0.0))
        errors = E.delta_errors(spec, E.Fit(names, b, cov, n))
        for name, v in (k | errors).items():
            assert (math.isnan(v) and math.isnan(r[name])) or math.isclose(r[name], v, rel_tol=1e-3, abs_tol=1e-6)
        assert r["negative"] == sum(k[x] < 0 for x in E.KAPPAS) and r["stars"] == E.stars(E.normal_p(b[-1] / math.sqrt(cov[-1, -1])))
    assert fits >= 50

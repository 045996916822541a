"""Estimates against plain NumPy, resampling and enrichment."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import econ as E
from psephos.operators import source_lists as S
from psephos.operators.resample import weighted_resample
from psephos.operators import windows as W
from psephos.streaming.collect import attempt, collect, collect_in_rounds, first_that_works, replay, watch


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    z, e = rng.normal(size=(300, 2)), rng.normal(size=300)
    w = rng.normal(size=300)
    d = z @ [1.0, -0.5] + 0.5 * w + 0.7 * e + rng.normal(size=300)
    y = 2 * d - w + e
    m = np.column_stack([y, d, w, z])
    return spark.createDataFrame(m.tolist(), "y double, d double, w double, z1 double, z2 double"), m


def test_ols(sample):
    df, m = sample
    fit = E.ols(df, "y", ["w", "d"])
    x = m[:, [2, 1]]
    b = np.linalg.lstsq(x, m[:, 0], rcond=None)[0]
    u = m[:, 0] - x @ b
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ (x.T * u**2 @ x) @ inv * 300 / 298
    assert np.allclose(fit.params, b) and np.allclose(fit.cov, cov)
    assert np.allclose(x.T @ (m[:, 0] - x @ fit.params), 0, atol=1e-8)


def test_iv(sample):
    df, m = sample
    fit = E.iv(df, "y", "d", ["w"], ["z1", "z2"])
    x, q = m[:, [2, 1]], m[:, [2, 3, 4]]
    p = q @ np.linalg.inv(q.T @ q) @ q.T
    b = np.linalg.solve(x.T @ p @ x, x.T @ p @ m[:, 0])
    assert np.allclose(fit.params, b) and abs(fit["d"] - 2) < 0.3 and fit.first_stage_f > 50
    with pytest.raises(ValueError, match="too few"):
        E.iv(df.limit(3), "y", "d", ["w"], ["z1"])


def test_kappas_and_errors():
    fit = E.Fit(["lag", "d"], np.array([0.4, 2.0]), np.diag([0.01, 0.04]), 50)
    k = E.kappas("ideal_lag", 2.0, 0.4)
    assert (k["kappa_lag"], k["kappa_ideal"]) == (0.2, 0.3) and math.isnan(k["kappa_family"])
    assert math.isclose(E.delta_errors("ideal_lag", fit)["se_kappa_lag"], math.sqrt(0.25 * 0.01 + 0.01 * 0.04), rel_tol=1e-5)
    assert math.isnan(E.kappas("ideal_only", 0.0)["kappa_ideal"])


def test_keep_independent(sample):
    df, _ = sample
    assert E.keep_independent(df.withColumn("sum", F.col("w") + F.col("d")), ["w", "d", "sum", "z1"]) == ["w", "d", "z1"]


def test_normal_and_halton():
    assert abs(E.normal_p(1.96) - 0.05) < 1e-4 and E.stars(0.04) == "**"
    assert np.allclose(E.halton(4, 2)[:, 0], [0.5, 0.25, 0.75, 0.125]) and np.allclose(E.normal_quantiles(np.array([0.5, 0.975])), [0, 1.959964], atol=1e-5)


def test_demand_deltas(spark):
    shares = [("m", 1, 0.2, 0.0, 1.0), ("m", 2, 0.3, 1.0, 1.0)]
    products = spark.createDataFrame(shares, "market string, product long, share double, x double, one double")
    model = E.Demand(["one"], ["x"], [], ["one"], nodes=20)
    agents = spark.createDataFrame([], "market string, agent int")
    got = {r["product"]: r.delta for r in model.deltas(products, agents, np.array([0.0]), np.zeros((1, 0))).collect()}
    assert math.isclose(got[1], math.log(0.2 / 0.5), abs_tol=1e-8) and math.isclose(got[2], math.log(0.3 / 0.5), abs_tol=1e-8)


def test_resample(spark):
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 0.0), ("m", 3, 3.0), ("n", 1, None), ("n", 2, -1.0)], "m string, r int, w double")
    got = weighted_resample(df, "m", "r", "w").toPandas()
    assert got.groupby("m").size().to_dict() == {"m": 200, "n": 200}
    assert sorted(got.agent_ids[got.m == "m"]) == list(range(1, 201))
    of_m = got[got.m == "m"].r.value_counts()
    assert 2 not in of_m and 110 < of_m[3] < 185
    assert set(got[got.m == "n"].r) == {1, 2}
    again = weighted_resample(df.repartition(3), "m", "r", "w").toPandas()
    assert sorted(map(tuple, got[["m", "r", "agent_ids"]].values)) == sorted(map(tuple, again[["m", "r", "agent_ids"]].values))


def test_sources(spark):
    answer = {"sources": [{"name": "A", "href": "http://a.example"}, {"title": "A", "url": "HTTP://A.example"}], "output": [{"annotations": [{"type": "url_citation", "url": "http://b.example"}]}]}
    df = spark.createDataFrame([(json.dumps(answer),), ("not json",), (None,)], "raw string").select(S.sources_in("raw").alias("s"))
    assert [len(r.s) for r in df.collect()] == [2, 0, 0]
    assert S.texts_in(json.dumps({"a": [{"type": "output_text", "text": "x"}]})) == ["x"]


def test_source_domains_are_limited(spark):
    many = [{"title": f"t{k}", "url": f"https://a.example/{k}", "publisher": "", "why_relevant": "w"} for k in range(5)] + [{"title": "b", "url": "https://b.example", "publisher": "", "why_relevant": ""}]
    kind = "m array<struct<title: string, url: string, publisher: string, why_relevant: string>>"
    df = spark.createDataFrame([(many,)], kind).select(S.effective_sources(F.col("m"), F.col("m")).alias("s"))
    assert [s.domain for s in df.first().s] == ["a.example", "a.example", "b.example"]


def test_attempts():
    calls = []

    def shaky(request):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return '{"a": 1}'

    waits = []
    assert attempt(shaky, {}, sleep=waits.append) == ("ok", '{"a": 1}', 3) and waits == [2.0, 4.0]
    assert attempt(lambda r: "", {})[0] == "no_output_text" and attempt(lambda r: "{x", {})[0] == "invalid_json"
    assert first_that_works([lambda r: 1 / 0, lambda r: "{}"])({}) == "{}"


def test_collect_and_watch(spark, tmp_path):
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target_id string")
    done = spark.createDataFrame([("a", "ok"), ("b", "error")], "target_id string, status string")
    got = {r.target_id: r.status for r in collect(targets, replay({"b": "{}"}), done).collect()}
    assert got == {"b": "ok", "c": "no_output_text"}
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "ok", 1), ("a", "ok", 2), ("b", "error", 1)], "target_id string, status string, n int").write.json(source)
    q = watch(spark, source, "target_id string, status string, n int", str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [r.target_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
    schema = "target_id string, status string, n int"
    spark.createDataFrame([("a", "ok", 3), ("c", "ok", 1)], schema).write.mode("append").json(source)
    watch(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.target_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the second batch had failed after writing: it runs again
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    watch(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.target_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_collect_in_rounds(spark, tmp_path):
    out = str(tmp_path / "answers")
    targets = spark.range(50).selectExpr("CAST(id AS string) AS target_id")
    known = {str(k): "{}" for k in range(50)}
    first = collect_in_rounds(targets, replay(known), out, rounds=4)
    assert sorted(int(r.target_id) for r in first.collect()) == list(range(50)) and {r.status for r in first.collect()} == {"ok"}
    (tmp_path / "answers" / "round=2" / "_SUCCESS").unlink()  # a round that was cut off is asked again, the others are not
    again = collect_in_rounds(targets, replay({}), out, rounds=4)
    asked = {r.target_id for r in again.where("status <> 'ok'").collect()}
    assert again.count() == 50 and 0 < len(asked) < 30


def test_row_numbers_in_ranges(spark, monkeypatch):
    """Numbers over ranges are those of one window, missing values first."""
    monkeypatch.setattr(W, "FEW", 10)
    monkeypatch.setattr(W, "RANGES", 7)
    rng = np.random.default_rng(3)
    made = [(f"k{rng.integers(30)}" if rng.random() < 0.9 else None, k) for k in range(400)]
    df = spark.createDataFrame(made, "k string, n int")
    got = {r.n: r.id for r in W.row_numbers(df, ["k", "n"], "id").collect()}
    want = sorted(made, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [n for _, n in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 401))
    ids = {r.k: r.id for r in W.with_rank_ids(df, "k", "id").collect()}
    assert ids == {k: i for i, k in enumerate(sorted({k for k, _ in made if k}))} | {None: None}


def test_first_stage_f(sample):
    """With controls and no constant there is one degree of freedom less."""
    df, m = sample
    y, d, w, z = m[:, 0], m[:, 1], m[:, 2:3], m[:, 3:]

    def rss(x):
        return float(((d - x @ np.linalg.lstsq(x, d, rcond=None)[0]) ** 2).sum())

    full = np.hstack([w, z])
    want = ((rss(w) - rss(full)) / 2) / (rss(full) / (300 - 3 - 1))
    assert math.isclose(E.iv(df, "y", "d", ["w"], ["z1", "z2"]).first_stage_f, want, rel_tol=1e-8)
    one = np.hstack([np.ones((300, 1)), full])
    want = ((rss(one[:, :2]) - rss(one)) / 2) / (rss(one) / (300 - 4))
    got = E.iv(df.withColumn("one", F.lit(1.0)), "y", "d", ["one", "w"], ["z1", "z2"])
    assert math.isclose(got.first_stage_f, want, rel_tol=1e-8)


def test_sweep_and_kappas(spark, data):
    """56 fits, each as NumPy finds it on the panel."""
    from psephos.plans import models

    rows = {(r["sample"], r.dim, r.spec, r.method): r for r in models.spec_sweep(spark, data).collect()}
    assert len(rows) == 56
    panel = models.supply(spark, data, "x2").toPandas().dropna(subset=["x", "d", "lagx", "z1", "z2", "z3"]).reset_index(drop=True)
    dm = lambda c: (panel[c] - panel.groupby("party")[c].transform("mean")).to_numpy()
    x = np.column_stack([dm("lagx"), dm("d")])
    b = np.linalg.lstsq(x, dm("x"), rcond=None)[0]
    r = rows["all", "cult", "ideal_lag", "OLS"]
    assert r.n == len(panel) and math.isclose(r.beta_d, b[1], rel_tol=1e-6, abs_tol=1e-9)
    k = E.kappas("ideal_lag", b[1], b[0])
    assert all(math.isclose(r[n], k[n], rel_tol=1e-5) for n in k if math.isfinite(k[n]))
    u = dm("x") - x @ b
    inverse = np.linalg.inv(x.T @ x)
    cov = inverse @ (x.T * u**2) @ x @ inverse * len(u) / (len(u) - 2)
    grad = {"kappa": np.array([-1 / b[1], -(1 - b[0]) / b[1] ** 2]), "lag": np.array([1 / b[1], -b[0] / b[1] ** 2])}
    names = E.KAPPAS
    assert math.isclose(r[f"se_{names[0]}"], math.sqrt(grad["kappa"] @ cov @ grad["kappa"]), rel_tol=1e-4)
    assert math.isclose(r[f"se_{names[1]}"], math.sqrt(grad["lag"] @ cov @ grad["lag"]), rel_tol=1e-4)

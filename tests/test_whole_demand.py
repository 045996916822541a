"""Demand.fit finds the parameters of simulated markets, and the query estimates on all years."""

from __future__ import annotations

import numpy as np

from psephos.operators import econ as E
from psephos.plans import models


def test_fit_on_simulated_markets(spark):
    rng = np.random.default_rng(11)
    sigma, beta = 1.5, np.array([-1.0, 0.8])
    draws = E.normal_quantiles(E.halton(30, 1))[:, 0]
    made = []
    for m in range(40):
        x, z = rng.normal(size=4), rng.normal(size=4)
        u = (beta[0] + beta[1] * x + 0.02 * rng.normal(size=4))[:, None] + sigma * x[:, None] * draws
        share = (np.exp(u) / (1 + np.exp(u).sum(axis=0))).mean(axis=1)
        rival = x.sum() - x
        made += [(f"m{m}", j, float(share[j]), 1.0, float(x[j]), float(x[j] ** 2), float(rival[j]), float(z[j])) for j in range(4)]
    products = spark.createDataFrame(made, "market string, product long, share double, one double, x double, xx double, rival double, z double").cache()
    agents = spark.createDataFrame([], "market string, agent int")
    model = E.Demand(["one", "x"], ["x"], [], ["one", "x", "xx", "rival"], nodes=30)
    fit = model.fit(products, agents, np.array([0.5]), tolerance=0.02)
    assert fit["converged"] and fit["unsolved"] == 0
    assert abs(abs(fit["sigma"][0]) - sigma) < 0.1 and np.allclose(fit["beta"], beta, atol=0.1)
    assert fit["objective"] < model.moments(products, agents, np.array([0.5]), np.zeros((1, 0)))[0]


def test_query_fits_all_years(spark, data, monkeypatch):
    """The query's rows: every market and year, 200 agents each, and what fit returns."""
    seen = {}

    def fit(self, products, agents, start, **more):
        seen.update(years={r.y for r in products.selectExpr("substring_index(market, '|', -1) AS y").distinct().collect()}, nodes=self.nodes)
        seen.update(draws={r["count"] for r in agents.groupBy("market").count().collect()})
        return {"sigma": np.array([1.0]), "pi": np.array([[2.0]]), "beta": np.array([3.0, 4.0]), "objective": 5.0, "converged": True, "unsolved": 0}

    monkeypatch.setattr(E.Demand, "fit", fit)
    got = models.demand_random_coefficients(spark, data).collect()[0].asDict()
    assert got == {"sigma": 1.0, "pi": 2.0, "constant": 3.0, "slope": 4.0, "objective": 5.0, "converged": True, "unsolved": 0}
    assert seen["years"] >= {"1996", "1997"} and seen["draws"] == {200} and seen["nodes"] == 200

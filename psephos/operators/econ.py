"""Least squares, instruments and discrete-choice demand on aggregated tables.

Products of regressors are summed in Spark, so that only small matrices reach the driver, however many rows there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.nulls import finite
from psephos.operators import demand
from psephos.operators.demand import halton, normal_quantiles  # noqa: F401  used with the models

#: Names of costs and of specifications; fixed values.
KAPPAS = ("kappa_ideal", "kappa_lag", "kappa_family")
SPECS = ("ideal_only", "lag_only", "family_only", "ideal_lag", "ideal_family", "lag_family", "ideal_lag_family")


@dataclass
class Fit:
    """Estimates with their covariance."""

    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    n: int
    first_stage_f: float = math.nan
    extra: dict[str, float] = field(default_factory=dict)

    def __getitem__(self, name: str) -> float:
        return float(self.params[self.names.index(name)]) if name in self.names else math.nan


def usable(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which all columns are finite."""
    cond = F.lit(True)
    for n in names:
        cond = cond & finite(n)
    return df.where(cond)


@dataclass
class Sums:
    """Sums of products of columns, their own sums and the number of rows; one pass over the data."""

    products: np.ndarray
    sums: np.ndarray
    n: int


def sums(df: DataFrame, names: list[str], weight=None) -> Sums:
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    products = [F.sum(F.col(names[i]) * F.col(names[j]) * w).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]
    row = df.agg(*products, *(F.sum(F.col(n) * w).alias(f"t{k}") for k, n in enumerate(names)), F.count("*").alias("n")).first()
    out = np.zeros((len(names), len(names)))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[k] or 0.0
    return Sums(out, np.array([row[f"t{k}"] or 0.0 for k in range(len(names))]), row.n)


def gram(df: DataFrame, names: list[str], weight=None) -> np.ndarray:
    """Sums of products of the columns, optionally weighted."""
    return sums(df, names, weight).products


def linear(names: list[str], b: np.ndarray):
    out = F.lit(0.0)
    for n, x in zip(names, b.tolist(), strict=True):
        out = out + F.col(n) * F.lit(x)
    return out


def least_squares(total: Sums, at: dict[str, int], y: str, x: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of y on x and the inverse of the products of x, from sums whose columns are ``at`` these places."""
    xi = [at[c] for c in x]
    inverse = np.linalg.pinv(total.products[np.ix_(xi, xi)])
    return inverse @ total.products[xi, at[y]], inverse


def ols(df: DataFrame, y: str, x: list[str]) -> Fit:
    """Least squares without a constant, HC1 covariance."""
    rows = usable(df, [y, *x]).persist()  # read twice
    total = sums(rows, [*x, y])
    b, inverse = least_squares(total, {c: i for i, c in enumerate([*x, y])}, y, x)
    meat = gram(rows, x, (F.col(y) - linear(x, b)) ** 2)
    rows.unpersist()
    return hc1(x, b, inverse, meat, total.n)


def hc1(x: list[str], b: np.ndarray, inverse: np.ndarray, meat: np.ndarray, n: int) -> Fit:
    return Fit(x, b, inverse @ meat @ inverse * n / max(n - len(x), 1), n)


@dataclass
class TwoStage:
    """What two-stage least squares takes from sums of products: coefficients, the bread of their covariance, first stage's F."""

    names: list[str]
    b: np.ndarray
    bread: np.ndarray
    first_stage_f: float
    n: int

    def fit(self, meat: np.ndarray) -> Fit:
        return Fit(self.names, self.b, self.bread @ meat @ self.bread.T, self.n, self.first_stage_f)


def two_stage(total: Sums, at: dict[str, int], y: str, d: str, w: list[str], z: list[str]) -> TwoStage:
    """One endogenous regressor ``d``, controls ``w`` and excluded instruments ``z``."""
    names, q = [*w, d], [*w, *z]
    g, n = total.products, total.n
    if n <= len(names) + 2:
        raise ValueError("too few usable observations")
    xi, qi = [at[c] for c in names], [at[c] for c in q]
    qq = np.linalg.pinv(g[np.ix_(qi, qi)])
    xq = g[np.ix_(xi, qi)]
    a = np.linalg.pinv(xq @ qq @ xq.T)
    b = a @ (xq @ qq @ g[qi, at[y]])

    def rss(cols: list[str]) -> float:
        i = [at[c] for c in cols]
        return g[at[d], at[d]] - (g[at[d], i] @ np.linalg.pinv(g[np.ix_(i, i)]) @ g[i, at[d]] if i else 0.0)

    restricted = rss(w) if w else g[at[d], at[d]] - total.sums[at[d]] ** 2 / n
    full = rss(q)
    constant = n - total.sums[qi] @ qq @ total.sums[qi] < 1e-9 * n  # one is a combination of the columns
    df2 = max(n - len(q) - (0 if constant else 1), 1)
    f = ((restricted - full) / len(z)) / max(full / df2, 1e-18) if z else math.nan
    return TwoStage(names, b, a @ xq @ qq, f, n)


def iv(df: DataFrame, y: str, d: str, w: list[str], z: list[str]) -> Fit:
    """Two-stage least squares with one endogenous regressor ``d``, controls ``w`` and excluded instruments ``z``; robust
    covariance without a small-sample factor, and the first stage's F of the instruments."""
    rows = usable(df, [y, d, *w, *z]).persist()  # read twice
    try:
        columns = [*w, *z, d, y]
        found = two_stage(sums(rows, columns), {c: i for i, c in enumerate(columns)}, y, d, w, z)
        return found.fit(gram(rows, [*w, *z], (F.col(y) - linear(found.names, found.b)) ** 2))
    finally:
        rows.unpersist()


def keep_independent(df: DataFrame, names: list[str], atol: float = 1e-10) -> list[str]:
    """Columns, left to right, that are not linear combinations of those kept before (by their products)."""
    g = gram(usable(df, names), names)
    kept: list[int] = []
    for j in range(len(names)):
        trial = [*kept, j]
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(g[np.ix_(trial, trial)]), 0))
        scale = math.sqrt(max(g[j, j], 0.0)) or 1.0
        if s.min() > max(atol, 1e-7 * scale):
            kept.append(j)
    return [names[j] for j in kept]


def demand_instruments(df: DataFrame, base: list[str], age: str, gender: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns ``demand_instruments0``, ... for a constant, the ``base`` instruments and their products with age and
    gender, without those that are combinations of earlier ones; and what they are. Rows that lack any have none."""
    made = {"const": F.lit(1.0)} | {z: F.col(z) for z in base} | {f"ageX_{z}": F.col(age) * F.col(z) for z in base} | {f"genderX_{z}": F.col(gender) * F.col(z) for z in base}
    all_known = usable(df.select(*(c.cast("double").alias(n) for n, c in made.items())), list(made))
    kept = keep_independent(all_known, list(made))
    known = F.lit(True)
    for z in (*base, age, gender):
        known = known & finite(z)
    return df.withColumns({f"demand_instruments{k}": F.when(known, made[n].cast("double")) for k, n in enumerate(kept)}), kept


def kappas(spec: str, beta: float, lag: float = 0.0, family: float = 0.0) -> dict[str, float]:
    """Costs of moving away from the ideal, the previous and the family's position, from the estimates of a specification."""
    shares = {
        "ideal_only": (1.0, 0.0, 0.0), "lag_only": (0.0, 1.0, 0.0), "family_only": (0.0, 0.0, 1.0), "ideal_lag": (1 - lag, lag, 0.0),
        "ideal_family": (1 - family, 0.0, family), "lag_family": (0.0, lag, 1 - lag), "ideal_lag_family": (1 - lag - family, lag, family),
    }[spec]
    has = ("ideal" in spec, "lag" in spec, "family" in spec)
    ok = beta != 0 and math.isfinite(beta)
    out = {k: (s / beta if ok and h else math.nan) for k, s, h in zip(KAPPAS, shares, has, strict=True)}
    return out | dict(zip(("rho_ideal", "rho_lag", "rho_family"), shares, strict=True))


def delta_errors(spec: str, fit: Fit, step: float = 1e-6) -> dict[str, float]:
    """Standard errors of the kappas by numeric derivatives."""

    def at(theta: np.ndarray) -> dict[str, float]:
        named = dict(zip(fit.names, theta.tolist(), strict=True))
        return kappas(spec, named["d"], named.get("lag", named.get("lag_f", 0.0)), named.get("fam", 0.0))

    base, out = at(fit.params), {}
    for k in KAPPAS:
        grad = []
        for j, x in enumerate(fit.params):
            h = step * max(1.0, abs(x))
            up, down = fit.params.copy(), fit.params.copy()
            up[j] += h
            down[j] -= h
            grad.append((at(up)[k] - at(down)[k]) / (2 * h))
        v = np.array(grad) @ fit.cov @ np.array(grad)
        out[f"se_{k}"] = math.sqrt(max(float(v), 0.0)) if math.isfinite(base[k]) and np.isfinite(grad).all() else math.nan
    return out


def normal_p(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2)) if math.isfinite(t) else math.nan


def stars(p: float) -> str:
    return "" if not math.isfinite(p) else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def spec_columns(panel: DataFrame, spec: str) -> tuple[DataFrame, list[str]]:
    """The panel with columns ``y``, ``d`` and controls of a specification; those with an ideal point are demeaned by party.

    The panel has party, x (position), fam (family's position), lagx (previous position) and d.
    """
    moved = {
        "lag_only": (F.col("x") - F.col("lagx"), {}), "family_only": (F.col("x") - F.col("fam"), {}),
        "lag_family": (F.col("x") - F.col("fam"), {"lag_f": F.col("lagx") - F.col("fam")}),
        "ideal_only": (F.col("x"), {}), "ideal_lag": (F.col("x"), {"lag": F.col("lagx")}), "ideal_family": (F.col("x"), {"fam": F.col("fam")}),
        "ideal_lag_family": (F.col("x"), {"lag": F.col("lagx"), "fam": F.col("fam")}),
    }
    y, controls = moved[spec]
    return panel.withColumn("_y", y).withColumns({f"_{n}": c for n, c in controls.items()}), list(controls)


def fit_spec(panel: DataFrame, spec: str, method: str, z: list[str]) -> Fit:
    """One supply estimate. Rows need everything the specification uses, before its means are taken."""
    from psephos.operators.windows import demeaned

    rows, controls = spec_columns(panel, spec)
    used = ["_y", "d", *(f"_{c}" for c in controls), *z]
    rows = usable(rows, used).where(F.col("party").isNotNull())
    if spec.startswith("ideal"):
        rows = rows.select("party", *(demeaned(c, "party").alias(c) for c in used))
    names = [f"_{c}" for c in controls]
    fit = ols(rows, "_y", [*names, "d"]) if method == "OLS" else iv(rows, "_y", "d", names, z)
    fit.names = [*controls, "d"]
    return fit


#: Controls of the specifications; the columns of a sweep that hold them are called c1 and c2.
CONTROLS = {"ideal_lag": ["lag"], "ideal_family": ["fam"], "lag_family": ["lag_f"], "ideal_lag_family": ["lag", "fam"]}


def sweep_rows(panels: dict[str, dict[str, DataFrame]], z: list[str], specs: tuple[str, ...]) -> DataFrame:
    """The usable rows of every sample, dimension and specification in one table: sample, dim, spec, y, d, c1, c2 and ``z``;
    those of specifications with an ideal point are demeaned by party, unused controls are 0."""
    x, lag, fam, zero = F.col("x"), F.col("lagx"), F.col("fam"), F.lit(0.0)
    moved = {"lag_only": (x - lag, zero, zero), "family_only": (x - fam, zero, zero), "lag_family": (x - fam, lag - fam, zero), "ideal_only": (x, zero, zero), "ideal_lag": (x, lag, zero), "ideal_family": (x, fam, zero), "ideal_lag_family": (x, lag, fam)}
    each = F.array(*(F.struct(F.lit(spec).alias("spec"), *(c.alias(n) for n, c in zip(("y", "c1", "c2"), moved[spec], strict=True))) for spec in specs))
    parts = [p.select(F.lit(sample).alias("sample"), F.lit(dim).alias("dim"), "party", "d", *z, F.inline(each)) for sample, by_dim in panels.items() for dim, p in by_dim.items()]
    used = ["y", "d", "c1", "c2", *z]
    rows = usable(reduce(DataFrame.unionByName, parts), used).where(F.col("party").isNotNull())
    own = Window.partitionBy("sample", "dim", "spec", "party")
    return rows.select("sample", "dim", "spec", *(F.when(F.col("spec").startswith("ideal"), F.col(c) - F.avg(c).over(own)).otherwise(F.col(c)).alias(c) for c in used))


def grouped_sums(rows: DataFrame, keys: list[str], names: list[str], weights: dict[str, object]) -> dict[tuple, dict[str, Sums]]:
    """For each group and weight the sums of products of the columns; one pass, a row for each group."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    made = [F.count("*").alias("n")]
    for k, w in weights.items():
        made += [F.sum(F.col(names[i]) * F.col(names[j]) * w).alias(f"{k}_{i}_{j}") for i, j in pairs]
        made += [F.sum(F.col(n) * w).alias(f"{k}_{i}") for i, n in enumerate(names)]
    out = {}
    for row in rows.groupBy(*keys).agg(*made).collect():
        out[tuple(row[k] for k in keys)] = own = {}
        for k in weights:
            g = np.zeros((len(names), len(names)))
            for i, j in pairs:
                g[i, j] = g[j, i] = row[f"{k}_{i}_{j}"]
            own[k] = Sums(g, np.array([row[f"{k}_{i}"] for i in range(len(names))]), row["n"])
    return out


def sweep(panels: dict[str, dict[str, DataFrame]], z: list[str], specs: tuple[str, ...] = SPECS) -> pd.DataFrame:
    """All specifications by both methods over samples and dimensions (a few dozen fits); failures are rows with a warning.

    One pass sums the products of all fits at once, a second one those weighted by each fit's squared residuals, whose
    coefficients come with the rows as a map from a few dozen keys.
    """
    keys, columns = ["sample", "dim", "spec"], ["c1", "c2", "d", *z, "y"]
    at = {c: i for i, c in enumerate(columns)}
    rows = sweep_rows(panels, z, specs).persist()  # read twice
    total = {k: v["all"] for k, v in grouped_sums(rows, keys, columns, {"all": F.lit(1.0)}).items()}
    found: dict[tuple, object] = {}
    for key, t in total.items():
        w = ["c1", "c2"][: len(CONTROLS.get(key[2], []))]
        for method in ("OLS", "IV"):
            try:
                found[*key, method] = least_squares(t, at, "y", [*w, "d"]) if method == "OLS" else two_stage(t, at, "y", "d", w, z)
            except (ValueError, np.linalg.LinAlgError) as e:
                found[*key, method] = e
    weights = {}
    for method in ("OLS", "IV"):
        b = {key: f[0] if method == "OLS" else f.b for (*key, m), f in ((k, v) for k, v in found.items()) if m == method and not isinstance(f, Exception) for key in [tuple(key)]}
        made = {"|".join(k): [float(x) for x in (*v[:-1], *[0.0] * (3 - len(v)), v[-1])] for k, v in b.items()}
        table = F.create_map(*(x for k, v in made.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if made else F.create_map(F.lit(""), F.array(F.lit(0.0)))
        own = F.try_element_at(table, F.concat_ws("|", *keys))
        weights[method] = (F.col("y") - F.get(own, F.lit(0)) * F.col("c1") - F.get(own, F.lit(1)) * F.col("c2") - F.get(own, F.lit(2)) * F.col("d")) ** 2
    marked = rows.select(*keys, *columns, *(w.alias(m) for m, w in weights.items()))
    meat = grouped_sums(marked.fillna(0.0, list(weights)), keys, ["c1", "c2", "d", *z], {m: F.col(m) for m in weights})
    rows.unpersist()

    def fitted(key: tuple, method: str) -> Fit:
        f = found.get((*key, method), ValueError("too few usable observations"))
        if isinstance(f, Exception):
            raise f
        controls = CONTROLS.get(key[2], [])
        w = ["c1", "c2"][: len(controls)]
        used = [at[c] for c in ([*w, "d"] if method == "OLS" else [*w, *z])]
        own = meat[key][method].products[np.ix_(used, used)]
        fit = hc1([*w, "d"], *f, own, total[key].n) if method == "OLS" else f.fit(own)
        fit.names = [*controls, "d"]
        return fit

    out = []
    for sample, by_dim in panels.items():
        for dim in by_dim:
            for spec in specs:
                for method in ("OLS", "IV"):
                    row: dict[str, object] = {"sample": sample, "dim": dim, "spec": spec, "method": method, "warning": ""}
                    try:
                        fit = fitted((sample, dim, spec), method)
                        se = math.sqrt(max(fit.cov[-1, -1], 0.0))
                        t = fit["d"] / se if se > 0 else math.nan
                        k = kappas(spec, fit["d"], fit["lag"] if "lag" in fit.names else fit["lag_f"] if "lag_f" in fit.names else 0.0, fit["fam"] if "fam" in fit.names else 0.0)
                        row |= {"n": fit.n, "beta_d": fit["d"], "se_d": se, "t_d": t, "p_d": normal_p(t), "stars": stars(normal_p(t)), "first_stage_f": fit.first_stage_f, "negative": sum(k[x] < 0 for x in KAPPAS)}
                        row |= k | delta_errors(spec, fit)
                    except (ValueError, np.linalg.LinAlgError) as e:
                        row["warning"] = str(e)
                    out.append(row)
    return pd.DataFrame(out)


def logit_delta(share: str, outside: str):
    """Mean utility of the plain logit: log share less log outside share."""
    return F.when((F.col(share) > 0) & (F.col(outside) > 0), F.ln(share) - F.ln(outside))


def logit_own_derivative(coefficient: float, share: str):
    return F.lit(coefficient) * F.col(share) * (1 - F.col(share))


@dataclass
class Demand:
    """A random-coefficients logit: linear columns, columns with random coefficients, demographics and instruments.

    ``fixed`` linear coefficients are not estimated. The second step's weights are ``robust`` to unequal variances, or not.
    Markets are independent given the parameters, and each is solved in its own task (:mod:`psephos.operators.demand`).
    """

    linear: list[str]
    random: list[str]
    demographics: list[str]
    instruments: list[str]
    nodes: int = 200
    tolerance: float = 1e-10
    fixed: dict[str, float] = field(default_factory=dict)
    robust: bool = True

    def problem(self, products: DataFrame, agents: DataFrame) -> demand.Problem:
        names = list(dict.fromkeys(["market", "product", "share", *self.linear, *self.random, *self.instruments]))
        rows = demand.packed(products.select(*names), agents.select("market", "agent", *self.demographics), self.linear, self.random, self.demographics, self.instruments, self.nodes)
        return demand.Problem(self.linear, self.random, self.demographics, self.instruments, self.nodes, self.tolerance, self.fixed, rows)

    def _theta(self, sigma: np.ndarray, pi: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ravel(sigma), np.ravel(pi)]).astype(float)

    def deltas(self, products: DataFrame, agents: DataFrame, sigma: np.ndarray, pi: np.ndarray, beta: np.ndarray | None = None) -> DataFrame:
        """(market, product, delta, own, solved): mean utilities at given parameters, mean of q * (1 - q) over agents, and whether
        the market's contraction has ended. With ``beta``, ``by_<column>`` for each random column: the derivative of the product's
        share by its own value of the column, agents' tastes included."""
        problem, theta = self.problem(products, agents), self._theta(sigma, pi)
        rows, problem.rows = problem.rows, None
        mean = dict(zip(self.linear, np.ravel(beta), strict=True)) if beta is not None else {}
        by = [n for n in self.random if n in mean]
        draws = demand.normal_quantiles(demand.halton(self.nodes, len(self.random)))

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    a = problem.arrays(row)
                    taste = demand.Market(a["x"], draws, a["demo"]).taste(theta)
                    mu = a["x"] @ taste.T
                    delta, done = demand.contraction(np.log(a["share"]), mu, a["delta"], self.tolerance)
                    q = demand.probabilities(delta, mu)
                    slope = q * (1 - q)
                    out = {"market": [row["market"]] * len(q), "product": row["product"], "delta": delta, "own": slope.mean(axis=1), "solved": [done] * len(q)}
                    out |= {f"by_{n}": (slope * (mean[n] + taste[:, self.random.index(n)])).mean(axis=1) for n in by}
                    yield pa.RecordBatch.from_pydict(out)

        return rows.mapInArrow(run, "market string, product bigint, delta double, own double, solved boolean" + "".join(f", by_{n} double" for n in by))

    def moments(self, products: DataFrame, agents: DataFrame, sigma: np.ndarray, pi: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The GMM objective, the concentrated linear parameters and the weight matrix of the next step."""
        problem = self.problem(products, agents)
        search, theta = demand.Search(problem), self._theta(sigma, pi)
        (found,), sums = search.passed([theta])
        problem.zx, problem.zz, problem.n = sums.zx, sums.zz, sums.n
        value, beta, _ = search.value(found, np.linalg.pinv(problem.zz) if weight is None else weight)
        sums = search.passed([theta], beta)[1]
        search.close()
        return value, beta, np.linalg.pinv(sums.meat if self.robust else problem.zz * sums.ss / max(problem.n, 1))

    def fit(self, products: DataFrame, agents: DataFrame, start: np.ndarray, steps: int = 2, iterations: int = 200, tolerance: float = 1e-4) -> dict[str, object]:
        """Two-step GMM from the parameters ``start`` (sigma, then pi row by row). A step ends when the undamped quasi-Newton step
        moves no parameter by ``tolerance``, or no step gains (``converged``), or the iterations are used up. ``unsolved`` counts
        products whose contraction has not ended; standard errors are robust; ``passes`` counts jobs over the markets."""
        return demand.estimated(self.problem(products, agents), np.asarray(start, float), steps, iterations, tolerance, self.robust)

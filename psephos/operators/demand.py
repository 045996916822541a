"""Random-coefficients logit demand by two-step GMM.

A market's utilities are delta_j + sum over r of x_jr * (sigma_r * draw_r + pi_r . demographics) over its agents. Given the
nonlinear parameters, each market's deltas come from a contraction, squared by extrapolation. Their derivatives follow from the
implicit function theorem, so that one pass over the markets gives the objective's moments and their Jacobian at several points.
The search is a quasi-Newton one: the moments are nearly linear in the parameters, and the Jacobian stands in for second
derivatives, damped as needed. All trial steps of a search are one job.

Markets are packed once into a row each, whose arrays are kept; every pass reads these and writes nothing. A task takes its markets of like
size together, and hands on its sums alone: some hundred numbers reach the driver, however many markets there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Steps of a contraction at most.
STEPS = 5000
#: Dampings that are tried at once.
DAMPINGS = (0.0, 1e-3, 1e-1, 1e1)
#: Most that a step moves a parameter p, in units of 1 + |p|; linear moments say little beyond.
FARTHEST = 1.0
#: Relative gain of the objective below which a search has settled.
SETTLED = 1e-5
FLOOR = 1e-12
#: Numbers in an array of utilities; tasks of a pass for each core at most.
CELLS, TASKS = 1 << 19, 2

_ARRAYS = ("x", "share", "lin", "z", "demo", "delta")


def halton(n: int, dims: int) -> np.ndarray:
    """The first n points (without the origin) of the Halton sequence over the first prime bases."""
    primes = [p for p in range(2, 60) if all(p % q for q in range(2, p))][:dims]
    out = np.empty((n, dims))
    for j, base in enumerate(primes):
        for i in range(n):
            f, r, k = 1.0, 0.0, i + 1
            while k:
                f /= base
                k, digit = divmod(k, base)
                r += f * digit
            out[i, j] = r
    return out


def normal_quantiles(u: np.ndarray) -> np.ndarray:
    """Standard normal quantiles by bisection on the error function."""
    low, high = np.full(u.shape, -9.0), np.full(u.shape, 9.0)
    erf = np.vectorize(math.erf)
    for _ in range(60):
        mid = (low + high) / 2
        below = 0.5 * (1 + erf(mid / math.sqrt(2))) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def probabilities(delta: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Of each product and agent; markets of as many products may be stacked in front."""
    u = delta[..., None] + mu
    top = np.maximum(u.max(axis=-2, keepdims=True), 0)
    e = np.exp(u - top)
    return e / (np.exp(-top) + e.sum(axis=-2, keepdims=True))


def contractions(log_share: np.ndarray, mu: np.ndarray, delta: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The deltas of stacked markets that give the shares, and whether the steps of each have ended; pairs of plain steps are
    extrapolated by their squared ratio (SQUAREM), and plain steps go on where an extrapolation does not come closer. A market
    that has ended leaves the stack."""
    out, done = delta.copy(), np.zeros(len(delta), bool)
    at, kept, before = np.arange(len(delta)), delta.copy(), np.full(len(delta), math.inf)

    def step(d: np.ndarray, s: np.ndarray, m: np.ndarray) -> np.ndarray:
        return s - np.log(np.maximum(probabilities(d, m).mean(axis=-1), 1e-300))

    for _ in range(STEPS // 3):
        r = step(delta, log_share, mu)
        gap = np.abs(r).max(axis=1)
        ended = gap < tolerance
        if ended.any():
            out[at[ended]], done[at[ended]] = (delta + r)[ended], True
            at, kept, before, log_share, mu, delta, r, gap = (x[~ended] for x in (at, kept, before, log_share, mu, delta, r, gap))
        if not len(at):
            return out, done
        astray = ~(gap < 1e3 * before)
        if astray.any():
            delta, r = np.where(astray[:, None], kept, delta), r.copy()
            r[astray] = step(kept[astray], log_share[astray], mu[astray])
        before = np.fmin(before, gap)
        one = delta + r
        r2 = step(one, log_share, mu)
        two, v = one + r2, r2 - r
        kept = two
        length = np.sqrt((r * r).sum(axis=1) / np.maximum((v * v).sum(axis=1), 1e-300))[:, None]
        delta = np.where(length > 1, delta + 2 * length * r + length * length * v, two)
        delta = np.where(np.isfinite(delta).all(axis=1, keepdims=True), delta, two)
    out[at] = delta
    return out, done


def contraction(log_share: np.ndarray, mu: np.ndarray, delta: np.ndarray, tolerance: float) -> tuple[np.ndarray, bool]:
    """:func:`contractions` of one market."""
    out, done = contractions(log_share[None], mu[None], delta[None], tolerance)
    return out[0], bool(done[0])


@dataclass
class Market:
    """Arrays of a market, or of stacked ones of as many products, and what the parameters make of them."""

    x: np.ndarray
    draws: np.ndarray
    demo: np.ndarray

    def taste(self, theta: np.ndarray) -> np.ndarray:
        """Agents' deviations from the mean taste: agent by column."""
        r = self.x.shape[-1]
        return self.draws * theta[:r] + self.demo @ theta[r:].reshape(r, self.demo.shape[-1]).T

    def slopes(self, q: np.ndarray) -> np.ndarray:
        """Derivatives of delta by the parameters, from those of the shares by delta and by the parameters."""
        n, r, d = q.shape[-1], self.x.shape[-1], self.demo.shape[-1]
        by_delta = q.mean(axis=-1)[..., None] * np.eye(q.shape[-2]) - q @ q.swapaxes(-1, -2) / n
        by_theta = np.empty((*q.shape[:-1], r + r * d))
        for k in range(r):
            x = self.x[..., k]
            b = q * (x[..., None] - x[..., None, :] @ q) / n
            by_theta[..., k] = b @ self.draws[:, k]
            by_theta[..., r + k * d : r + (k + 1) * d] = b @ self.demo
        return -np.linalg.solve(by_delta, by_theta)


@dataclass
class Moments:
    """Sums over all products at one point: z'delta, z'(d delta / d theta), and products whose contraction has not ended."""

    zd: np.ndarray
    slope: np.ndarray
    unsolved: int


@dataclass
class Crossed:
    """Sums over all products: z'x, z'z, z'z weighted by squared residuals, the sum of these squares, and the number of products."""

    zx: np.ndarray
    zz: np.ndarray
    meat: np.ndarray
    ss: float
    n: int


@dataclass
class Problem:
    """Markets packed into rows, and what does not depend on the nonlinear parameters."""

    linear: list[str]
    random: list[str]
    demographics: list[str]
    instruments: list[str]
    nodes: int
    tolerance: float
    fixed: dict[str, float]
    rows: DataFrame
    zx: np.ndarray = field(default_factory=lambda: np.empty(0))
    zz: np.ndarray = field(default_factory=lambda: np.empty(0))
    n: int = 0

    @property
    def width(self) -> int:
        return len(self.random) * (1 + len(self.demographics))

    @property
    def free(self) -> list[int]:
        return [k for k, name in enumerate(self.linear) if name not in self.fixed]

    def arrays(self, row: dict) -> dict[str, np.ndarray]:
        j = len(row["product"])
        shape = {"x": (j, -1), "lin": (j, -1), "z": (j, -1), "demo": (self.nodes, len(self.demographics))}
        return {n: np.frombuffer(row[n]).reshape(shape.get(n, (j,))) if n != "demo" or self.demographics else np.zeros((self.nodes, 0)) for n in _ARRAYS}


def packed(products: DataFrame, agents: DataFrame, linear: list[str], random: list[str], demographics: list[str], instruments: list[str], nodes: int) -> DataFrame:
    """A row for each market: its products and arrays, and the plain logit's deltas to start from. Agents beyond ``nodes`` go
    unused, fewer are used in turn, and a market without any has the draws alone."""
    schema = "market string, product array<bigint>, x binary, share binary, lin binary, z binary, demo binary, delta binary"

    def pack(key, p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame([], columns=["market", "product", *_ARRAYS])
        p = p.sort_values("product")
        s = np.clip(p["share"].to_numpy(float), FLOOR, 1)
        demo = np.zeros((nodes, len(demographics)))
        if len(a) and demographics:
            own = a.sort_values("agent")[demographics].to_numpy(float)
            demo = own[np.arange(nodes) % len(own)]
        arrays = {"x": p[random], "lin": p[linear], "z": p[instruments]}
        out = {n: np.ascontiguousarray(v.to_numpy(float)).tobytes() for n, v in arrays.items()}
        out |= {"share": s.tobytes(), "demo": np.ascontiguousarray(demo).tobytes(), "delta": (np.log(s) - math.log(max(1 - s.sum(), FLOOR))).tobytes()}
        return pd.DataFrame([{"market": p["market"].iloc[0], "product": p["product"].to_numpy(np.int64)} | out])

    # few bytes, but much work in each: the number of partitions is given, so that they are not taken together; and no more than
    # the cores can use, since each pass starts a task for each
    spark = products.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism))
    products, agents = products.repartition(parts, "market"), agents.repartition(parts, "market")
    return products.groupBy("market").cogroup(agents.groupBy("market")).applyInPandas(pack, schema)


def stacked(markets: Iterator[dict[str, np.ndarray]], nodes: int) -> Iterator[dict[str, np.ndarray]]:
    """Arrays of markets of as many products, taken from some hundred markets at a time; of CELLS utilities, or of one market."""
    while some := list(islice(markets, 512)):
        alike: dict[int, list[dict[str, np.ndarray]]] = {}
        for a in some:
            alike.setdefault(len(a["share"]), []).append(a)
        for j, all_ in alike.items():
            few = max(1, CELLS // (j * nodes))
            for at in range(0, len(all_), few):
                yield {name: np.stack([a[name] for a in all_[at : at + few]]) for name in _ARRAYS}


class Search:
    """Minimises the objective, pass by pass. The markets' arrays are kept as an RDD: a pass is a job of a few dozen milliseconds
    of work, less than a DataFrame's planning takes."""

    def __init__(self, problem: Problem):
        bare = Problem(**{k: v for k, v in vars(problem).items() if k != "rows"}, rows=None)  # what tasks need
        self.problem, self.bare, self.passes = problem, bare, 0
        self.markets = problem.rows.select("product", *_ARRAYS).rdd.map(bare.arrays).persist(StorageLevel.MEMORY_AND_DISK)

    def passed(self, points: list[np.ndarray], beta: np.ndarray | None = None) -> tuple[list[Moments], Crossed]:
        """One job over all markets: the moments of each point, and the crossed sums, with the residuals of the first point's
        deltas and the linear parameters ``beta`` where they are given. Each partition hands on its own sums."""
        p = self.bare
        m, k, width, n_points = len(p.instruments), len(p.linear), p.width + 1, len(points)
        draws, nodes, tolerance = normal_quantiles(halton(p.nodes, len(p.random))), p.nodes, p.tolerance
        sizes = [n_points * m * width, n_points, m * k, m * m, m * m, 2]

        def run(markets: Iterator[dict[str, np.ndarray]]) -> Iterator[np.ndarray]:
            total, unsolved = np.zeros((n_points, m, width)), np.zeros(n_points)
            zx, zz, meat, ss, n = np.zeros((m, k)), np.zeros((m, m)), np.zeros((m, m)), 0.0, 0
            for a in stacked(markets, nodes):
                market, zt = Market(a["x"], draws, a["demo"]), a["z"].swapaxes(-1, -2)
                zx, zz, n = zx + (zt @ a["lin"]).sum(axis=0), zz + (zt @ a["z"]).sum(axis=0), n + a["share"].size
                for at, theta in enumerate(points):
                    mu = a["x"] @ market.taste(theta).swapaxes(-1, -2)
                    delta, done = contractions(np.log(a["share"]), mu, a["delta"], tolerance)
                    slopes = market.slopes(probabilities(delta, mu))
                    total[at] += (zt @ np.concatenate([delta[..., None], slopes], axis=-1)).sum(axis=0)
                    unsolved[at] += a["share"].shape[1] * int((~done).sum())
                    if beta is not None and not at:
                        xi = delta - a["lin"] @ beta
                        meat, ss = meat + ((zt * xi[:, None, :] ** 2) @ a["z"]).sum(axis=0), ss + float((xi * xi).sum())
            yield np.concatenate([x.ravel() for x in (total, unsolved, zx, zz, meat, np.array([ss, n]))])

        self.passes += 1
        found = np.sum([np.zeros(sum(sizes)), *self.markets.mapPartitions(run).collect()], axis=0)
        total, unsolved, zx, zz, meat, rest = np.split(found, np.cumsum(sizes)[:-1])
        moments = [Moments(t[:, 0], t[:, 1:], int(u)) for t, u in zip(total.reshape(n_points, m, width), unsolved, strict=True)]
        return moments, Crossed(zx.reshape(m, k), zz.reshape(m, m), meat.reshape(m, m), float(rest[0]), int(rest[1]))

    def close(self) -> None:
        self.markets.unpersist()

    def value(self, m: Moments, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The objective, the linear parameters that are best with it, and z'xi."""
        p = self.problem
        beta = np.array([p.fixed.get(n, 0.0) for n in p.linear])
        zx, left = p.zx[:, p.free], m.zd - p.zx @ beta
        beta[p.free] = np.linalg.pinv(zx.T @ weight @ zx) @ (zx.T @ weight @ left)
        gap = m.zd - p.zx @ beta
        return float(gap @ weight @ gap), beta, gap

    def minimise(self, theta: np.ndarray, now: Moments, weight: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, Moments, bool]:
        """From a point and its moments: the best point found, its moments, and whether the search has settled: the undamped step moves no parameter by
        ``tolerance`` or more, or no step gains. Standard deviations are kept from going below 0."""
        p = self.problem
        for _ in range(iterations):
            value, _, gap = self.value(now, weight)
            zx = p.zx[:, p.free]
            inner = weight - weight @ zx @ np.linalg.pinv(zx.T @ weight @ zx) @ zx.T @ weight
            gradient, curve = now.slope.T @ weight @ gap, now.slope.T @ inner @ now.slope
            bound = np.arange(len(theta)) < len(p.random)
            free = np.flatnonzero(~(bound & (theta <= 0) & (gradient > 0)))
            if not len(free):
                return theta, now, True
            scale = np.diag(np.maximum(np.diag(curve)[free], 1e-300))
            points = []
            for damping in DAMPINGS:
                move = np.zeros(len(theta))
                move[free] = -np.linalg.pinv(curve[np.ix_(free, free)] + damping * scale) @ gradient[free]
                move /= max(1.0, np.max(np.abs(move) / (1 + np.abs(theta))) / FARTHEST)
                points.append(np.where(bound, np.maximum(theta + move, 0), theta + move))
            if np.abs(points[0] - theta).max() < tolerance:
                return theta, now, True
            points += [theta + 0.25 * (points[0] - theta)]
            found, _ = self.passed(points)
            values = [self.value(m, weight)[0] if not m.unsolved else math.inf for m in found]
            best = int(np.argmin(values))
            if not values[best] < value * (1 - SETTLED):
                return theta, now, True
            theta, now = points[best], found[best]
        return theta, now, False


def estimated(problem: Problem, start: np.ndarray, steps: int, iterations: int, tolerance: float, robust: bool) -> dict[str, object]:
    """Two-step estimates with robust standard errors; see :class:`psephos.operators.econ.Demand`."""
    search = Search(problem)
    try:
        theta, converged = np.asarray(start, float), True
        (now,), sums = search.passed([theta])
        problem.zx, problem.zz, problem.n = sums.zx, sums.zz, sums.n
        weight = np.linalg.pinv(problem.zz)
        for step in range(steps):
            if step:
                sums = search.passed([theta], beta)[1]
                weight = np.linalg.pinv(sums.meat if robust else problem.zz * sums.ss / problem.n)
            theta, now, done = search.minimise(theta, now, weight, iterations, tolerance)
            value, beta, _ = search.value(now, weight)
            converged &= done
        meat = search.passed([theta], beta)[1].meat
        slopes = np.column_stack([now.slope, -problem.zx[:, problem.free]])
        bread = np.linalg.pinv(slopes.T @ weight @ slopes)
        cov = bread @ slopes.T @ weight @ meat @ weight @ slopes @ bread
        errors = np.sqrt(np.maximum(np.diag(cov), 0))
    finally:
        search.close()
    r, d = len(problem.random), len(problem.demographics)
    beta_error = np.full(len(problem.linear), math.nan)
    beta_error[problem.free] = errors[problem.width :]
    return {
        "sigma": theta[:r], "pi": theta[r:].reshape(r, d), "beta": beta, "objective": value, "converged": converged, "unsolved": now.unsolved, "sigma_se": errors[:r],
        "pi_se": errors[r : problem.width].reshape(r, d), "beta_se": beta_error, "passes": search.passes, "n": problem.n,
    }

"""Learned importance weights of random features.

One distributed aggregation gives v_j = D (sum_i y_i z_j(x_i))^2; the weights are
the point p of the simplex that maximises <v, p> within an f-divergence ball
around the uniform weights, found on the driver over D numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.linalg import project_simplex
from kestrel.operators.maps import FeatureMap, RBFSampler, _width, batch_for
from kestrel.sources.features import width_of


def signed_sums(df: DataFrame, m: FeatureMap, features: str = "features", y: str = "y") -> np.ndarray:
    """sum_i y_i z(x_i): partial sums a task, added up by component; D rows reach the driver."""
    shared = df.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m, total = shared.value, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1).to_numpy() @ m.apply(_width(m, batch_for(m, batch.column(0))))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["j", "s"])

    rows = df.select(features, F.col(y).cast("double")).mapInArrow(run, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(m.width)
    out[rows.column("j").to_numpy()] = rows.column("s").to_numpy()
    return out


#: Steps in which the penalty of ADMM adapts.
ADAPT = 100


def _admm(v, lam, n, prox, max_iter, mu, tau_incr, tau_decr, eps_abs, eps_rel):
    """p on the simplex and z under the divergence; the penalty adapts in the first steps, since one that never rests need not converge."""
    penalty, z, u = 1.0, np.full(n, 1.0 / n), np.zeros(n)
    for k in range(max_iter):
        p = project_simplex(z - u + v / penalty)
        was, z = z, prox(p + u, lam / penalty)
        u = u + p - z
        primal, dual = np.linalg.norm(p - z), penalty * np.linalg.norm(z - was)
        if primal <= math.sqrt(n) * eps_abs + eps_rel * max(np.linalg.norm(p), np.linalg.norm(z)) and dual <= math.sqrt(n) * eps_abs + eps_rel * penalty * np.linalg.norm(u):
            break
        if k >= ADAPT:
            continue
        if primal > mu * dual:
            penalty, u = penalty * tau_incr, u / tau_incr
        elif dual > mu * primal:
            penalty, u = penalty / tau_decr, u * tau_decr
    return p


class Divergence:
    """``solve(v, lam)``: argmax <v, p> - lam D(p || uniform) on the simplex; ``value(p)``: D."""

    options = dict(max_iter=10000, mu=10, tau_incr=2, tau_decr=2, eps_abs=1e-4, eps_rel=1e-4)


class Chi2(Divergence):
    def solve(self, v, lam):
        scale = 2 * lam * len(v)
        return project_simplex(v, scale) / scale

    def value(self, p):
        return float((((p * len(p)) ** 2 - 1) / len(p)).sum())


class Chi2Origin(Chi2):
    def solve(self, v, lam):
        return project_simplex(v / (lam * len(v)))


class KL(Divergence):
    def solve(self, v, lam):
        e = np.exp((v - v.max()) / lam)
        return e / e.sum()

    def value(self, p):
        q = p[p > 0]
        return float((q * np.log(q * len(p))).sum())


class TV(Divergence):
    def solve(self, v, lam):
        n = len(v)

        def prox(a, t):
            d = a - 1.0 / n
            return 1.0 / n + np.sign(d) * np.maximum(np.abs(d) - t / 2, 0)

        return _admm(v, lam, n, prox, **self.options)

    def value(self, p):
        return float(0.5 * np.abs(p - 1.0 / len(p)).sum())


class ReverseKL(Divergence):
    def solve(self, v, lam):
        n = len(v)
        return _admm(v, lam, n, lambda a, t: (a + np.sqrt(a * a + 4 * t / n)) / 2, **self.options)

    def value(self, p):
        return float((-math.log(len(p)) - np.log(p + 1e-8)).sum() / len(p))


class SquaredDistance(Divergence):
    def solve(self, v, lam):
        n = len(v)
        return project_simplex(v + lam / n**2, lam / n) / (lam / n)

    def value(self, p):
        return float(0.5 * ((p - 1.0 / len(p)) ** 2).sum())


DIVERGENCES = {"chi2": Chi2, "chi2_origin": Chi2Origin, "kl": KL, "tv": TV, "reverse_kl": ReverseKL, "squared": SquaredDistance}


def best_weights(v: np.ndarray, divergence: Divergence, rho: float = 1.0, alpha: float | None = None, max_iter: int = 100, tol: float = 1e-8) -> np.ndarray:
    """The best feasible weights: double the multiplier until D < rho, bisect, keep the best feasible point.

    With ``alpha`` the multiplier is given and there is one solve.
    """
    if alpha is not None:
        return divergence.solve(v, alpha)
    best, value = np.full(len(v), 1.0 / len(v)), float(v.mean())
    low, high = 0.0, 1.0
    for _ in range(max_iter):
        p = divergence.solve(v, high)
        if divergence.value(p) < rho:
            break
        low, high = high, 2 * high
    start = high
    while True:
        if divergence.value(p) <= rho and float(v @ p) >= value:
            best, value = p, float(v @ p)
        if high - low < tol * start or max_iter <= 0:
            return best
        max_iter -= 1
        middle = (low + high) / 2
        p = divergence.solve(v, middle)
        low, high = (low, middle) if divergence.value(p) < rho else (middle, high)


class LearnedKernel(FeatureMap):
    """z(x) sqrt(D) sqrt(p) over an inner map whose weights p are learned from labels -1 and 1."""

    def __init__(self, transformer: FeatureMap | None = None, divergence="chi2", rho=1.0, alpha=None, max_iter=100, tol=1e-8, warm_start=False, seed=0, **admm):
        inner = transformer or RBFSampler(seed=seed)
        super().__init__(inner.n_components, inner.seed)
        if divergence not in DIVERGENCES:
            raise ValueError(f"unknown divergence {divergence!r}; known are {', '.join(DIVERGENCES)}")
        self.inner, self.rho, self.alpha, self.max_iter, self.tol, self.warm_start = inner, rho, alpha, max_iter, tol, warm_start
        self.divergence = DIVERGENCES[divergence]()
        self.divergence.options = {**Divergence.options, **admm}

    def fit_frame(self, df: DataFrame, features: str = "features", y: str = "y") -> LearnedKernel:
        """One job over (features, y); labels other than -1 and 1 are refused."""
        if df.where(~F.col(y).isin(-1.0, 1.0) | F.col(y).isNull()).limit(1).count():
            raise ValueError("labels must be -1 and 1")
        if not (self.warm_start and hasattr(self.inner, "d")):
            self.inner.fit(width_of(df, features))
        self.d, self.width = self.inner.d, self.inner.width
        v = self.width * signed_sums(df, self.inner, features, y) ** 2
        self.statistic = v / v.max() if v.max() > 0 else v
        self.p = best_weights(self.statistic, self.divergence, self.rho, self.alpha, self.max_iter, self.tol)
        self.size = self.width
        return self

    def fit(self, d):
        raise TypeError("the weights are learned from labels: use fit_frame")

    def apply(self, x):
        return self.inner.apply(x) * np.sqrt(self.size) * np.sqrt(self.p)

    def remove_bases(self, indices=None) -> bool:
        """Drop the columns of zero weight; the others keep their values."""
        gone = np.flatnonzero(self.p <= 0) if indices is None else np.asarray(indices)
        before = self.inner.width
        if not len(gone) or len(gone) >= before or not self.inner.remove_bases(gone):
            return False
        self.p = np.delete(self.p, gone)
        self.width = self.inner.width
        return True

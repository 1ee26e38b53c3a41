"""Doubly stochastic maps: bases are functions of (seed, basis number), never stored.

Any executor regenerates any block of bases from the counter generator, so a model
of any width travels as its seed.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType

from kestrel.functions import kernels, rng
from kestrel.operators import maps


class DoublyMap:
    """``block(x, lo, hi)`` gives the columns of bases lo to hi, unscaled."""

    columns_per_base = 1

    def __init__(self, source: maps.FeatureMap, d: int):
        self.source, self.d, self.seed = source, d, source.seed

    def block(self, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        raise NotImplementedError

    def width(self, bases: int) -> int:
        return bases * self.columns_per_base

    def apply(self, x: np.ndarray, bases: int, step: int = 1024) -> np.ndarray:
        """Scaled columns of the first ``bases`` bases."""
        parts = [self.block(x, lo, min(lo + step, bases)) for lo in range(0, bases, step)]
        return np.concatenate(parts, axis=1) / math.sqrt(self.width(bases))

    def predict(self, x: np.ndarray, coef: np.ndarray, step: int = 1024, first: int = 0) -> np.ndarray:
        """Unscaled block-wise dot product with the bases from ``first`` on; a block of bases is all that is ever held."""
        per, out = self.columns_per_base, np.zeros(len(x))
        for lo in range(0, len(coef) // per, step):
            hi = min(lo + step, len(coef) // per)
            out += self.block(x, first + lo, first + hi) @ coef[lo * per : hi * per]
        return out

    def transform(self, df: DataFrame, bases: int, features: str = "features", out: str = "z") -> DataFrame:
        return maps.map_batches(df, features, out, self, lambda m, x: m.apply(x, bases), ArrayType(DoubleType()))


class DoublyFourier(DoublyMap):
    """sqrt 2 cos(sqrt(2 g) w x + b), or interleaved cosine and sine columns without offset."""

    def __init__(self, source, d):
        super().__init__(source, d)
        self.gamma = 1.0 / d if getattr(source, "auto", False) else source.gamma
        self.offset = source.use_offset
        self.columns_per_base = 1 if self.offset else 2

    def block(self, x, lo, hi):
        p = math.sqrt(2 * self.gamma) * (x @ rng.matrix(self.seed, "w", range(lo, hi), self.d, "gaussian").T)
        if self.offset:
            return math.sqrt(2) * np.cos(p + 2 * math.pi * rng.uniforms(self.seed, "offset", [0], range(lo, hi))[0])
        return math.sqrt(2) * np.stack([np.cos(p), np.sin(p)], axis=2).reshape(len(x), -1)


class DoublySkewedChi2(DoublyMap):
    def block(self, x, lo, hi):
        c = self.source.skewedness
        if x.size and (x <= -c).any():
            raise ValueError("features must be above -skewedness")
        w = np.log(np.tan(math.pi / 2 * rng.uniforms(self.seed, "w", range(lo, hi), self.d))) / math.pi
        return math.sqrt(2) * np.cos(np.log(x + c) @ w.T + 2 * math.pi * rng.uniforms(self.seed, "offset", [0], range(lo, hi))[0])


class DoublyMaclaurin(DoublyMap):
    """sqrt(a_n / P(n)) times n independent projections; low orders are drawn like all others."""

    def __init__(self, source, d):
        super().__init__(source, d)
        if source.h01:
            warnings.warn("h01 does not apply to regenerated bases", stacklevel=3)
        gamma = 1.0 / d if source.gamma == "auto" else source.gamma
        self.a = np.array(source.coefs, float) if source.coefs is not None else kernels.maclaurin_coefficients(source.kernel, source.degree, gamma, source.bias, source.max_expansion)

    def block(self, x, lo, hi):
        orders, probability = rng.maclaurin_orders(self.seed, "order", range(lo, hi), self.source.p, self.a)
        z = np.repeat(np.sqrt(self.a[orders] / probability[orders])[None], len(x), axis=0)
        for k in range(int(orders.max(initial=0))):
            at = np.flatnonzero(orders > k)
            z[:, at] *= x @ rng.matrix(self.seed, f"w{k}", (lo + at).tolist(), self.d, self.source.distribution, self.source.p_sparse).T
        return z


class DoublyRandomKernel(DoublyMap):
    def block(self, x, lo, hi):
        w = rng.matrix(self.seed, "w", range(lo, hi), self.d, "rademacher")
        return kernels.matrix(self.source.kernel, x, w, degree=self.source.degree)


REGISTRY = {
    maps.RBFSampler: DoublyFourier,
    maps.RandomFourier: DoublyFourier,
    maps.SkewedChi2Sampler: DoublySkewedChi2,
    maps.RandomMaclaurin: DoublyMaclaurin,
    maps.RandomKernel: DoublyRandomKernel,
}


def doubly(source: maps.FeatureMap, d: int) -> DoublyMap:
    """The regenerating form of a map; five kinds have one."""
    if source is None or type(source) not in REGISTRY:
        raise ValueError(f"{type(source).__name__} has no regenerating form")
    return REGISTRY[type(source)](source, d)

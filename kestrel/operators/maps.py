"""Feature maps: rows x to z(x) with <z(x), z(y)> close to a kernel.

``fit(d)`` draws a small model from the input width, the parameters and the seed;
it needs no job.  ``apply`` maps a matrix of rows, ``transform`` a DataFrame: one
Arrow batch function over a broadcast model, without a shuffle, so it works on
batch and streaming frames alike.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kestrel.functions import kernels, rng
from kestrel.functions.linalg import circulant, fwht, next_power_of_two, pad
from kestrel.functions.sparse import Postings, is_sparse
from kestrel.sources.features import batch_matrix, batch_rows, list_column, sparse_column, width_of

#: Cells of one block of mapped rows in a task.
BLOCK_CELLS = 2_000_000
SPARSE_TYPE = StructType([StructField("size", IntegerType()), StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])


class FeatureMap:
    """Protocol of all maps; user-defined maps implement ``_draw`` and ``apply``."""

    width: int
    #: Whether ``apply`` takes compressed rows as they are; other maps get them as a matrix, in blocks by their width.
    sparse_input = False

    def __init__(self, n_components: int = 100, seed: int = 0):
        if n_components < 1:
            raise ValueError("n_components must be at least 1")
        self.n_components, self.seed = int(n_components), int(seed)

    def fit(self, d: int) -> FeatureMap:
        """Draw the model for rows of d features."""
        if d < 1:
            raise ValueError("rows need at least one feature")
        self.d = int(d)
        self.width = self.n_components
        self._draw()
        return self

    def _draw(self) -> None:
        pass

    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def remove_bases(self, indices) -> bool:
        """Drop output columns in place where the map's columns are independent; whether it did."""
        if getattr(self, "W", None) is None or self.W.shape[1] != self.width:
            return False
        keep = np.setdiff1d(np.arange(self.width), np.asarray(indices))
        self._keep(keep)
        self.width = len(keep)
        return True

    def _keep(self, keep: np.ndarray) -> None:
        self.W = self.W[:, keep]
        if getattr(self, "b", None) is not None:
            self.b = self.b[keep]

    def apply_sparse(self, x) -> tuple:
        """(rows, columns, values) of the non-zero cells of ``apply``, in order."""
        z = self.apply(x)
        rows, cols = np.nonzero(z)
        return rows, cols, z[rows, cols]

    def transform(self, df: DataFrame, features: str = "features", out: str = "z", dense_output: bool = True) -> DataFrame:
        """df with z(features) at its end, an array column or, without dense_output, a sparse struct of the non-zeros."""
        if dense_output:
            return map_batches(df, features, out, self, lambda m, x: m.apply(_width(m, x)), ArrayType(DoubleType()))
        return map_batches(df, features, out, self, lambda m, x: (len(x), m.width, *m.apply_sparse(_width(m, x))), SPARSE_TYPE)

    def fit_transform(self, df: DataFrame, features: str = "features", out: str = "z") -> DataFrame:
        return self.fit(width_of(df, features)).transform(df, features, out)


def _width(m: FeatureMap, x: np.ndarray) -> np.ndarray:
    if len(x) and x.shape[1] != m.d:
        raise ValueError(f"rows have {x.shape[1]} features, the map was fitted on {m.d}")
    return x


def batch_for(m, column):
    """A features column as the map takes it: compressed rows, or a matrix."""
    return (batch_rows if getattr(m, "sparse_input", False) else batch_matrix)(column)


def map_batches(df: DataFrame, features: str, out: str, model, function, out_type) -> DataFrame:
    """df with function(model, matrix of features) as a column at its end.

    Wide inputs and outputs are cut into blocks of BLOCK_CELLS so that a task's memory
    is bounded whatever the Arrow batch holds.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields, StructField(out, out_type)])
    at = df.columns.index(features)

    def run(batches):
        m = shared.value
        sparse = getattr(m, "sparse_input", False)
        for whole in batches:
            wide = 1
            if pa.types.is_struct(whole.column(at).type) and whole.num_rows and not sparse:
                wide = max(1, whole.column(at).field("size")[0].as_py() or 1)
            step = max(1, BLOCK_CELLS // max(wide, getattr(m, "width", 1)))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                z = function(m, batch_for(m, batch.column(at)))
                column = sparse_column(*z) if isinstance(z, tuple) else list_column(z) if z.ndim == 2 else pa.array(z)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


class _Fourier(FeatureMap):
    """Shared tail of the projections: cosines, or the projection itself for dot products."""

    def __init__(self, n_components=100, gamma=0.5, distribution="gaussian", random_fourier=True, use_offset=False, seed=0):
        super().__init__(n_components, seed)
        self.gamma, self.distribution, self.random_fourier, self.use_offset = gamma, distribution, random_fourier, use_offset

    def _stacks(self, rows: int) -> int:
        """Number of stacks of ``rows`` bases, and the legal width that goes with it."""
        stacks = -(-self.n_components // rows)
        if self.random_fourier and not self.use_offset:
            stacks = -(-stacks // 2)
            self.width = 2 * stacks * rows
        else:
            self.width = stacks * rows
        self.norm = self.width  # stays as it is when bases are removed
        self.b = 2 * math.pi * rng.uniforms(self.seed, "offset", [0], self.width)[0] if self.random_fourier and self.use_offset else None
        return stacks

    def _finish(self, p: np.ndarray) -> np.ndarray:
        if not self.random_fourier:
            return p / math.sqrt(self.norm)
        p = math.sqrt(2 * self.gamma) * p
        if self.use_offset:
            return math.sqrt(2 / self.norm) * np.cos(p + self.b)
        return math.sqrt(2 / self.norm) * np.concatenate([np.cos(p), np.sin(p)], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def apply(self, x):
        return self._finish(self.project(x))


class RandomFourier(_Fourier):
    """RBF kernel exp(-gamma |x - y|^2); gamma 'auto' is 1/d.

    Without offset the width is even, rounded down, cosines first.
    """

    sparse_input = True

    def __init__(self, n_components=100, gamma="auto", use_offset=False, seed=0, kernel="rbf"):
        if kernel != "rbf":
            raise ValueError("the kernel must be 'rbf'")
        super().__init__(n_components, gamma, "gaussian", True, use_offset, seed)
        self.auto = gamma == "auto"

    def _draw(self):
        if self.auto:
            self.gamma = 1.0 / self.d
        if self.use_offset:
            self._stacks(1)
        else:
            if self.n_components % 2:
                warnings.warn("n_components is rounded down to an even number", stacklevel=3)
            if self.n_components < 2:
                raise ValueError("n_components must be at least 2 without offset")
            self.width = self.norm = self.n_components // 2 * 2
            self.b = None
        self.W = rng.matrix(self.seed, "w", self.width if self.use_offset else self.width // 2, self.d, "gaussian").T

    def project(self, x):
        return x @ self.W


class RBFSampler(RandomFourier):
    """RandomFourier with an offset, gamma 1 unless given; the default map of all solvers."""

    def __init__(self, n_components=100, gamma=1.0, seed=0):
        super().__init__(n_components, 1.0 if gamma == "scale" else gamma, True, seed)


class OrthogonalRandomFeature(_Fourier):
    """Stacks of d x d orthogonal bases whose lengths are those of Gaussian vectors."""

    def _draw(self):
        rows = []
        for t in range(self._stacks(self.d)):
            q = np.linalg.qr(rng.matrix(self.seed, f"q{t}", self.d, self.d, self.distribution))[0]
            rows.append(rng.chi(self.seed, f"s{t}", self.d, self.d)[:, None] * q)
        self.W = np.concatenate(rows).T

    def project(self, x):
        return x @ self.W


class StructuredOrthogonalRandomFeature(_Fourier):
    """Three signed Hadamard products a stack: sqrt(n) H D3 H D2 H D1 x over padded rows."""

    def __init__(self, n_components=100, gamma=0.5, distribution="rademacher", random_fourier=True, use_offset=False, seed=0):
        super().__init__(n_components, gamma, distribution, random_fourier, use_offset, seed)

    def _draw(self):
        self.n = next_power_of_two(self.d)
        stacks = self._stacks(self.n)
        self.D = [rng.matrix(self.seed, f"d{k}", stacks, self.d if k == 1 else self.n, self.distribution) for k in (1, 2, 3)]

    def project(self, x):
        parts = []
        for d1, d2, d3 in zip(*self.D):
            y = fwht(pad(x * d1, self.n))
            parts.append(math.sqrt(self.n) * fwht(fwht(y * d2) * d3))
        return np.concatenate(parts, axis=1)


class FastFood(_Fourier):
    """Stacks of (1/sqrt n) H S G P H B x over padded rows, H unnormalised."""

    def _draw(self):
        self.n = next_power_of_two(self.d)
        stacks = self._stacks(self.n)
        self.B = rng.matrix(self.seed, "sign", stacks, self.d, "rademacher")
        self.P = np.stack([rng.permutation(self.seed, "perm", t, self.n) for t in range(stacks)])
        g = rng.matrix(self.seed, "w", stacks, self.n, self.distribution)
        s = np.stack([rng.chi(self.seed, f"s{t}", self.n, self.n) for t in range(stacks)])
        self.SG = g * s / np.sqrt((g**2).sum(axis=1, keepdims=True))

    def project(self, x):
        parts = [fwht(fwht(pad(x * b, self.n), False)[:, p] * sg, False) / math.sqrt(self.n) for b, p, sg in zip(self.B, self.P, self.SG)]
        return np.concatenate(parts, axis=1)


class SignedCirculantRandomMatrix(_Fourier):
    """Stacks of signed circulant matrices: row r is sign_r sum_c w[(r - c) mod d] x_c."""

    def _draw(self):
        stacks = self._stacks(self.d)
        self.C = rng.matrix(self.seed, "w", stacks, self.d, self.distribution)
        self.S = rng.matrix(self.seed, "sign", stacks, self.d, "rademacher")

    def project(self, x):
        return np.concatenate([s * circulant(x, w) for w, s in zip(self.C, self.S)], axis=1)


class SignedCirculantRandomKernel(FeatureMap):
    """ANOVA kernel with circulant +-1 weights: power sums of odd powers are circulant
    projections of x^t, those of even powers the plain sums of x^t."""

    def __init__(self, n_components=100, kernel="anova", degree=2, seed=0):
        super().__init__(n_components, seed)
        if kernel != "anova":
            raise ValueError("the kernel must be 'anova'")
        self.degree = degree

    def _draw(self):
        self.base = SignedCirculantRandomMatrix(self.n_components, 0.5, "rademacher", False, False, self.seed).fit(self.d)
        self.width = self.base.width

    def apply(self, x):
        sums = [None]
        for t in range(1, self.degree + 1):
            sums.append(self.base.project(x**t) if t % 2 else np.repeat((x**t).sum(axis=1, keepdims=True), self.width, axis=1))
        a = [np.ones((len(x), self.width))]
        for m in range(1, self.degree + 1):
            a.append(sum((-1) ** (t + 1) * a[m - t] * sums[t] for t in range(1, m + 1)) / m)
        return a[self.degree] / math.sqrt(self.width)


class RandomKernel(FeatureMap):
    """k(x, w_i) / sqrt(D) for random w_i: ANOVA, all-subsets, dot, pairwise or a callable k(X, W)."""

    def __init__(self, n_components=100, kernel="anova", degree=2, distribution="rademacher", p_sparse=0.0, seed=0):
        super().__init__(n_components, seed)
        self.kernel = kernel.replace("-", "_") if isinstance(kernel, str) else kernel
        if isinstance(self.kernel, str) and self.kernel not in ("anova", "anova_cython", "all_subsets", "dot", "pairwise", "pairwise_symmetric"):
            raise ValueError(f"unknown kernel {kernel!r}")
        self.degree, self.distribution, self.p_sparse = degree, distribution, p_sparse
        self.sparse_input = self.kernel in ("anova", "anova_cython", "dot")

    def _draw(self):
        self.W = rng.matrix(self.seed, "w", self.width, self.d, self.distribution, self.p_sparse).T
        self.scale = math.sqrt(self.width)

    def apply_sparse(self, x):
        """Compressed rows meet the non-zero weights alone."""
        if not is_sparse(x) or self.kernel == "dot":
            return super().apply_sparse(x)
        features, bases = np.nonzero(self.W)
        rows, cols, values = Postings(bases, features, self.W[features, bases], self.width).anova(x, self.degree)
        return rows, cols, values / self.scale

    def apply(self, x):
        if is_sparse(x) and self.kernel == "anova_cython":
            x = x.toarray()
        k = self.kernel(x, self.W.T) if callable(self.kernel) else kernels.matrix(self.kernel, x, self.W.T, degree=self.degree)
        return k / self.scale


class SubfeatureRandomKernel(RandomKernel):
    """RandomKernel whose weights have n_sub_features non-zeros each, scaled to stay unbiased.

    Only the non-zero weights are held, and only pairs of non-zeros are multiplied.
    """

    sparse_input = True

    def __init__(self, n_components=100, n_sub_features=5, kernel="anova", degree=2, distribution="rademacher", seed=0):
        super().__init__(n_components, kernel, degree, distribution, 0.0, seed)
        if self.kernel not in ("anova", "anova_cython"):
            raise ValueError("the kernel must be 'anova' or 'anova_cython'")
        if n_sub_features < degree:
            raise ValueError("n_sub_features must not be below the degree")
        self.n_sub_features = n_sub_features

    def _draw(self):
        self.weights = _sub_weights(self.seed, "sub", "w", range(self.width), self.d, self.n_sub_features, self.distribution)
        self.scale = math.sqrt(self.width) / math.sqrt(math.comb(self.d, self.degree) / math.comb(self.n_sub_features, self.degree))

    def apply(self, x):
        z = np.zeros((len(x), self.width))
        rows, cols, values = self.apply_sparse(x)
        z[rows, cols] = values
        return z

    def apply_sparse(self, x):
        rows, cols, values = self.weights.anova(x, self.degree)
        return rows, cols, values / self.scale

    def remove_bases(self, indices) -> bool:
        keep = np.setdiff1d(np.arange(self.width), np.asarray(indices))
        self.weights, self.width = self.weights.keep(keep), len(keep)
        return True


def _sub_weights(seed: int, sub: str, stream: str, rows, d: int, k: int, distribution, p_sparse: float = 0.0, factor: float = 1.0) -> Postings:
    """Weights of bases that look at k features each; a base's draws over all features are all that is ever held."""
    subsets, values = np.zeros((len(rows), k), np.int64), np.zeros((len(rows), k))
    for n, i in enumerate(rows):
        subsets[n] = rng.subsets(seed, sub, [i], d, k)[0]
        values[n] = rng.matrix(seed, stream, [i], subsets[n], distribution, p_sparse)[0] * factor
    return Postings.of(subsets, values)


class RandomMaclaurin(FeatureMap):
    """Dot-product kernels by their power series: each base draws an order n and is
    sqrt(a_n / P(n)) times the product of n random projections.

    With ``h01`` the orders 0 and 1 are exact columns [sqrt a0, sqrt a1 x] in front.
    """

    sub = None
    sparse_input = True

    def __init__(self, n_components=100, p=10, kernel="poly", degree=2, distribution="rademacher", gamma="auto", bias=0.0, coefs=None, max_expansion=50, h01=False, p_sparse=0.0, seed=0):
        super().__init__(n_components, seed)
        if kernel not in ("poly", "exp") and coefs is None:
            raise ValueError("a kernel besides 'poly' and 'exp' needs coefs")
        self.p, self.kernel, self.degree, self.distribution, self.gamma, self.bias = p, kernel, degree, distribution, gamma, bias
        self.coefs, self.max_expansion, self.h01, self.p_sparse = coefs, max_expansion, h01, p_sparse

    def _draw(self):
        gamma = 1.0 / self.d if self.gamma == "auto" else self.gamma
        a = np.array(self.coefs, float) if self.coefs is not None else kernels.maclaurin_coefficients(self.kernel, self.degree, gamma, self.bias, self.max_expansion)
        if (a < 0).any():
            raise ValueError("the coefficients must not be negative")
        self.a = a
        if self.h01 and not (a[2:] != 0).any():
            self.orders, self.scales = np.zeros(0, np.int64), np.zeros(0)
        else:
            self.orders, probability = rng.maclaurin_orders(self.seed, "order", self.n_components, self.p, a, self.h01)
            self.scales = np.sqrt(a[self.orders] / probability[self.orders])
        self.factors = [self._factor(k, np.flatnonzero(self.orders > k)) for k in range(int(self.orders.max(initial=0)))]
        self.width = len(self.orders) + (self.d + 1 if self.h01 else 0)

    def _factor(self, k: int, rows: np.ndarray):
        """Bases with a k-th factor and its weights."""
        if self.sub is not None:
            return rows, _sub_weights(self.seed, f"sub{k}", f"w{k}", rows.tolist(), self.d, self.sub, self.distribution, self.p_sparse, math.sqrt(self.d / self.sub))
        return rows, rng.matrix(self.seed, f"w{k}", rows.tolist(), self.d, self.distribution, self.p_sparse).T

    def apply(self, x):
        z = np.repeat(self.scales[None], len(x), axis=0)
        for rows, w in self.factors:
            z[:, rows] *= w.dot(x) if hasattr(w, "bases") else x @ w
        z /= math.sqrt(max(1, len(self.orders)))
        if self.h01:
            a0, a1 = self.a[0], self.a[1] if len(self.a) > 1 else 0.0
            z = np.concatenate([np.full((len(x), 1), math.sqrt(a0)), math.sqrt(a1) * (x.toarray() if is_sparse(x) else x), z], axis=1)
        return z

    def remove_bases(self, indices) -> bool:
        if self.h01:
            return False
        keep = np.setdiff1d(np.arange(self.width), np.asarray(indices))
        place = {int(old): new for new, old in enumerate(keep)}
        held = math.sqrt(max(1, len(keep)) / max(1, len(self.orders)))  # columns keep their values
        self.orders, self.scales = self.orders[keep], self.scales[keep] * held
        factors = []
        for rows, w in self.factors:
            stay = [i for i, r in enumerate(rows) if int(r) in place]
            factors.append((np.array([place[int(rows[i])] for i in stay], np.int64), w.keep(np.array(stay, np.int64)) if hasattr(w, "bases") else w[:, stay]))
        self.factors = factors
        self.width = len(keep)
        return True


class SubfeatureRandomMaclaurin(RandomMaclaurin):
    """RandomMaclaurin whose every factor looks at n_sub_features features."""

    def __init__(self, n_components=100, n_sub_features=5, **params):
        super().__init__(n_components, **params)
        self.sub = n_sub_features

    def _draw(self):
        if self.sub > self.d:
            raise ValueError("n_sub_features must not exceed the number of features")
        super()._draw()


def _sketch(x, h, s, width: int):
    """Cells h(j) += s(j) x_j of every row."""
    if is_sparse(x):
        cells = np.bincount(x.rows() * width + h[x.indices], weights=x.data * s[x.indices], minlength=len(x) * width)
        return cells.reshape(len(x), width)
    z = np.zeros((width, len(x)))
    np.add.at(z, h, (x * s).T)
    return z.T


class TensorSketch(FeatureMap):
    """Homogeneous polynomial kernel <x, y>^degree: product of count sketches in the frequency domain."""

    sparse_input = True

    def __init__(self, n_components=100, degree=2, seed=0):
        super().__init__(n_components, seed)
        if degree < 1:
            raise ValueError("the degree must be at least 1")
        self.degree = degree

    def _draw(self):
        self.H = rng.buckets(self.seed, "hash", self.degree, self.d, self.n_components)
        self.S = rng.matrix(self.seed, "sign", self.degree, self.d, "rademacher")

    def apply(self, x):
        product = 1.0
        for h, s in zip(self.H, self.S):
            product = product * np.fft.rfft(_sketch(x, h, s, self.width), axis=1)
        return np.fft.irfft(product, n=self.width, axis=1)


class CountSketch(FeatureMap):
    """Linear kernel: z[h(j)] += s(j) x_j."""

    sparse_input = True

    def _draw(self):
        self.H = rng.buckets(self.seed, "hash", 1, self.d, self.n_components)[0]
        self.S = rng.matrix(self.seed, "sign", 1, self.d, "rademacher")[0]

    def apply(self, x):
        return _sketch(x, self.H, self.S, self.width)

    def sketch_coo(self, coo: DataFrame, id_col: str) -> DataFrame:
        """(id, i, z) from (id, j, v) rows by a broadcast hash table and one aggregation."""
        spark = coo.sparkSession
        table = spark.createDataFrame([(j, int(h), float(s)) for j, (h, s) in enumerate(zip(self.H, self.S))], "j int, i int, s double")
        return coo.join(F.broadcast(table), "j").groupBy(id_col, "i").agg(F.sum(F.col("s") * F.col("v")).alias("z"))


class RandomProjection(FeatureMap):
    """Linear kernel: x W / sqrt(D); p_sparse 'auto' is 1 - 1/sqrt(d) for sparse weights."""

    sparse_input = True

    def __init__(self, n_components=100, distribution="rademacher", p_sparse="auto", seed=0):
        super().__init__(n_components, seed)
        if p_sparse != "auto" and not (isinstance(p_sparse, float) and 0.0 <= p_sparse < 1.0):
            raise ValueError("p_sparse must be 'auto' or a float in [0, 1)")
        self.distribution, self.p_sparse = distribution, p_sparse

    def _draw(self):
        p = 1.0 - 1.0 / math.sqrt(self.d) if self.p_sparse == "auto" else self.p_sparse
        self.W = rng.matrix(self.seed, "w", self.width, self.d, self.distribution, p).T
        self.scale = math.sqrt(self.width)

    def apply(self, x):
        return x @ self.W / self.scale


class SubsampledRandomHadamard(FeatureMap):
    """Linear kernel: sqrt(n / D) times D distinct rows of the Hadamard transform of signed x."""

    def __init__(self, n_components=100, distribution="rademacher", seed=0):
        super().__init__(n_components, seed)
        self.distribution = distribution

    def _draw(self):
        self.n = next_power_of_two(self.d)
        if self.n_components > self.n:
            raise ValueError("n_components must not exceed the padded number of features")
        self.D = rng.matrix(self.seed, "w", 1, self.d, self.distribution)[0]
        self.rows = rng.permutation(self.seed, "perm", 0, self.n)[: self.n_components]

    def apply(self, x):
        return math.sqrt(self.n / self.width) * fwht(pad(x * self.D, self.n))[:, self.rows]


class CompactRandomFeature(FeatureMap):
    """down(up(x)): a wide map and a projection of it, composed within one batch."""

    def __init__(self, up: FeatureMap | None = None, down: FeatureMap | str | None = None, n_components=10, n_components_up=100, degree=2, h01=False, seed=0):
        super().__init__(n_components, seed)
        self.up = up or RandomMaclaurin(n_components_up, degree=degree, h01=h01, seed=seed)
        down = SubsampledRandomHadamard(n_components, seed=seed + 1) if down == "srht" else down
        self.down = down or RandomProjection(n_components, seed=seed + 1)

    def _draw(self):
        self.up.fit(self.d)
        self.down.fit(self.up.width)
        self.width = self.down.width

    def apply(self, x):
        return self.down.apply(self.up.apply(x))

    def remove_bases(self, indices):
        done = self.down.remove_bases(indices)
        self.width = self.down.width
        return done


class MB(FeatureMap):
    """Intersection kernel on [0, 1]: unary codes on a grid of n_components // d cells a feature."""

    def __init__(self, n_components=1000, seed=0):
        super().__init__(n_components, seed)

    def _draw(self):
        self.grids = self.n_components // self.d
        if self.grids < 1:
            raise ValueError("n_components must not be below the number of features")
        self.width = self.grids * self.d

    def _checked(self, x):
        if x.size and (x.min() < 0 or x.max() > 1):
            raise ValueError("features must be in [0, 1]")
        return x

    def apply(self, x):
        code = np.clip(self.grids * self._checked(x)[:, :, None] - np.arange(self.grids), 0, 1)
        return code.reshape(len(x), -1) / math.sqrt(self.grids)

    def expression(self, features: str = "features"):
        """The same map as a Catalyst expression."""
        g = self.grids
        return F.expr(f"flatten(transform({features}, v -> transform(sequence(0, {g - 1}), k -> greatest(least({g} * v - k, 1D), 0D) / sqrt({g}D))))")


class SparseMB(MB):
    """Two cells a feature, equal to MB for linear models with differences of neighbouring weights:
    hat functions on the grid, the cell below and the cell above."""

    def cells(self, x):
        """(cell, its value, the value of the cell below) of every feature; no cell below the first."""
        g, x = self.grids, self._checked(x)
        cell = np.minimum((g * x).astype(np.int64), g - 1)
        share = g * x - cell
        return cell + g * np.arange(self.d), share, np.where(cell > 0, 1 - share, 0.0)

    def apply(self, x):
        g, z = self.grids, np.zeros((len(x), self.d, self.grids))
        x = self._checked(x)
        cell = np.minimum((g * x).astype(np.int64), g - 1)
        share = g * x - cell
        rows, cols = np.indices(x.shape)
        z[rows, cols, cell] = share
        low = cell > 0
        z[rows[low], cols[low], cell[low] - 1] = 1 - share[low]
        return z.reshape(len(x), -1)

    def sparse(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        """(id, i, z) rows of the non-zero cells, as DataFrame expressions alone."""
        g = self.grids
        cells = f"transform({features}, (v, j) -> struct(j * {g} + least(cast(floor({g} * v) as int), {g - 1}) as c, j as j, {g} * v - least(floor({g} * v), {g - 1}) as s))"
        rows = df.select(id_col, F.explode(F.expr(cells)).alias("e")).select(id_col, F.explode(F.expr(f"array(struct(e.c as i, cast(e.s as double) as z), struct(e.c - 1 as i, if(e.c > e.j * {g}, 1D - e.s, 0D) as z))")).alias("p"))
        return rows.select(id_col, "p.i", "p.z").where("z <> 0")


class AdditiveChi2Sampler(FeatureMap):
    """Additive chi-square kernel sum 2xy/(x+y) by sampling its Fourier transform; rows must not be negative.

    Layout: the constant block, then a cosine and a sine block a step, d columns each.
    """

    #: The sampling interval that goes with 1, 2 and 3 steps.
    INTERVALS = {1: 0.8, 2: 0.5, 3: 0.4}

    def __init__(self, sample_steps=2, sample_interval=None, seed=0):
        super().__init__(1, seed)
        if sample_interval is None and sample_steps not in self.INTERVALS:
            raise ValueError("sample_interval must be given for more than 3 steps")
        self.steps, self.interval = sample_steps, sample_interval or self.INTERVALS[sample_steps]

    def _draw(self):
        self.width = self.d * (2 * self.steps - 1)

    def apply(self, x):
        if x.size and x.min() < 0:
            raise ValueError("features must not be negative")
        some = x > 0
        log = self.interval * np.log(np.where(some, x, 1.0))
        blocks = [np.sqrt(x * self.interval)]
        for i in range(1, self.steps):
            size = np.where(some, np.sqrt(2 * x * self.interval / math.cosh(math.pi * i * self.interval)), 0.0)
            blocks += [size * np.cos(i * log), size * np.sin(i * log)]
        return np.concatenate(blocks, axis=1)


class SkewedChi2Sampler(FeatureMap):
    """Skewed chi-square kernel: sqrt(2/D) cos(ln(x + c) W + b); rows must be above -c."""

    def __init__(self, n_components=100, skewedness=1.0, seed=0):
        super().__init__(n_components, seed)
        self.skewedness = skewedness

    def _draw(self):
        self.W = np.log(np.tan(math.pi / 2 * rng.uniforms(self.seed, "w", self.width, self.d))).T / math.pi
        self.b = 2 * math.pi * rng.uniforms(self.seed, "offset", [0], self.width)[0]
        self.scale = math.sqrt(2 / self.width)

    def apply(self, x):
        if x.size and (x <= -self.skewedness).any():
            raise ValueError("features must be above -skewedness")
        return self.scale * np.cos(np.log(x + self.skewedness) @ self.W + self.b)

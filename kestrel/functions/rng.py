"""Counter-based random numbers: a value is a function of (seed, stream, i, j) alone.

Any executor can draw any cell of any random matrix without shared state, and the
same cell can be written as an SQL expression.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

DISTRIBUTIONS = ("rademacher", "gaussian", "normal", "uniform", "laplace", "sparse_rademacher")


#: A digest holds this many 32-bit numbers.
WORDS = 8


def uniforms(seed: int, stream: str, rows, cols) -> np.ndarray:
    """Uniform numbers in (0, 1); rows and cols are counts or index sequences.

    Cell (i, j) is word j mod 8 of the SHA-256 digest of "seed|stream|i|j div 8".
    """
    rows = range(rows) if isinstance(rows, int) else rows
    cols = np.arange(cols) if isinstance(cols, int) else np.asarray(cols, np.int64)
    blocks, back = np.unique(cols // WORDS, return_inverse=True)
    head, digest = f"{seed}|{stream}".encode(), hashlib.sha256
    raw = b"".join([digest(b"%b|%d|%d" % (head, i, b)).digest() for i in rows for b in blocks.tolist()])
    words = np.frombuffer(raw, ">u4").reshape(len(rows), len(blocks) * WORDS)
    return (words[:, back * WORDS + cols % WORDS] + 0.5) / 2.0**32


def sql_uniform(seed: int, stream: str, i: str, j: str) -> str:
    """The same number as DuckDB SQL, with SQL expressions for i and j."""
    return f"((CAST('0x' || substr(sha256('{seed}|{stream}|' || CAST({i} AS VARCHAR) || '|' || CAST(({j}) // {WORDS} AS VARCHAR)), 1 + {WORDS} * (({j}) % {WORDS}), 8) AS BIGINT) + 0.5e0) / 4294967296e0)"


def spark_uniform(seed: int, stream: str, i: str, j: str) -> str:
    """The same number as Spark SQL."""
    return f"((cast(conv(substr(sha2(concat('{seed}|{stream}|', cast({i} as string), '|', cast(({j}) div {WORDS} as string)), 256), cast(1 + {WORDS} * (({j}) % {WORDS}) as int), 8), 16, 10) as bigint) + 0.5D) / 4294967296D)"


def matrix(seed: int, stream: str, rows, cols, distribution="rademacher", p_sparse: float = 0.0) -> np.ndarray:
    """Random matrix of zero mean and unit variance; a callable gets (seed, stream, rows, cols).

    Sparse Rademacher cells are zero with probability ``p_sparse`` and else
    +-1/sqrt(1 - p_sparse).
    """
    if callable(distribution):
        return np.asarray(distribution(seed, stream, rows, cols), float)
    u = uniforms(seed, stream, rows, cols)
    if distribution == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    if distribution in ("gaussian", "normal"):
        return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * uniforms(seed, f"{stream}:2", rows, cols))
    if distribution == "uniform":
        return (2.0 * u - 1.0) * math.sqrt(3.0)
    if distribution == "laplace":
        t = u - 0.5
        return -math.sqrt(0.5) * np.sign(t) * np.log(1.0 - 2.0 * np.abs(t))
    if distribution == "sparse_rademacher":
        if not 0.0 <= p_sparse < 1.0:
            raise ValueError("p_sparse must be in [0, 1)")
        kept = uniforms(seed, f"{stream}:keep", rows, cols) >= p_sparse
        return np.where(kept, np.where(u < 0.5, -1.0, 1.0) / math.sqrt(1.0 - p_sparse), 0.0)
    raise ValueError(f"unknown distribution {distribution!r}; known are {', '.join(DISTRIBUTIONS)}")


def sql_cell(seed: int, stream: str, i: str, j: str, distribution: str = "rademacher", p_sparse: float = 0.0, uniform=sql_uniform) -> str:
    """A cell of ``matrix`` as SQL; ``uniform`` picks the dialect."""
    u = uniform(seed, stream, i, j)
    if distribution == "rademacher":
        return f"(CASE WHEN {u} < 0.5e0 THEN -1e0 ELSE 1e0 END)"
    if distribution in ("gaussian", "normal"):
        return f"(sqrt(-2e0 * ln({u})) * cos(2e0 * pi() * {uniform(seed, f'{stream}:2', i, j)}))"
    if distribution == "uniform":
        return f"((2e0 * {u} - 1e0) * sqrt(3e0))"
    if distribution == "laplace":
        return f"(-sqrt(0.5e0) * sign({u} - 0.5e0) * ln(1e0 - 2e0 * abs({u} - 0.5e0)))"
    if distribution == "sparse_rademacher":
        scale = repr(1.0 / math.sqrt(1.0 - p_sparse)) + "e0"
        return f"(CASE WHEN {uniform(seed, f'{stream}:keep', i, j)} < {p_sparse!r}e0 THEN 0e0 WHEN {u} < 0.5e0 THEN -{scale} ELSE {scale} END)"
    raise ValueError(f"unknown distribution {distribution!r}")


def buckets(seed: int, stream: str, rows, cols, n: int) -> np.ndarray:
    """Uniform integers in [0, n)."""
    return np.minimum((uniforms(seed, stream, rows, cols) * n).astype(np.int64), n - 1)


def permutation(seed: int, stream: str, i: int, n: int) -> np.ndarray:
    """A permutation of range(n): indices in order of their uniform numbers."""
    return np.lexsort((np.arange(n), uniforms(seed, stream, [i], n)[0]))


def subsets(seed: int, stream: str, rows, n: int, k: int) -> np.ndarray:
    """k distinct indices below n for each row: those of the k smallest uniform numbers, ascending."""
    if not 0 < k <= n:
        raise ValueError("the subset size must be between 1 and the number of features")
    u = uniforms(seed, stream, rows, n)
    return np.sort(np.argsort(u, axis=1, kind="stable")[:, :k], axis=1)


def categorical(seed: int, stream: str, rows, cols, weights) -> np.ndarray:
    """Draws from weights by inversion of the cumulative sums."""
    w = np.asarray(weights, float)
    if w.ndim != 1 or not len(w) or (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    return np.minimum(np.searchsorted(np.cumsum(w) / w.sum(), uniforms(seed, stream, rows, cols), side="right"), len(w) - 1)


def binomial(seed: int, stream: str, rows, cols, n: int, p: float) -> np.ndarray:
    """Binomial draws by inversion of the exact distribution."""
    pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    return categorical(seed, stream, rows, cols, pmf)


def chi(seed: int, stream: str, rows, degrees: int) -> np.ndarray:
    """Norms of ``degrees``-dimensional Gaussian vectors, one a row."""
    return np.sqrt((matrix(seed, stream, rows, degrees, "gaussian") ** 2).sum(axis=1))


def maclaurin_orders(seed: int, stream: str, rows, base: float, coefficients, skip_low: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Orders n drawn with probability proportional to base^-(n+1) where coefficient n is not zero.

    Returns the orders and the probability of every order; ``skip_low`` leaves out
    orders 0 and 1.
    """
    a = np.asarray(coefficients, float)
    w = np.where(a != 0, float(base) ** -(np.arange(len(a)) + 1.0), 0.0)
    if skip_low:
        w[:2] = 0
    if w.sum() <= 0:
        raise ValueError("no order has a coefficient")
    return categorical(seed, stream, rows, [0], w)[:, 0], w / w.sum()

"""Batched Walsh-Hadamard and circulant transforms, padding."""

from __future__ import annotations

import numpy as np


def next_power_of_two(n: int) -> int:
    """The smallest power of two that is not below n; 1 for 0."""
    if not isinstance(n, (int, np.integer)) or isinstance(n, bool):
        raise TypeError("an integer is needed")
    if n < 0:
        raise ValueError("a number of 0 or more is needed")
    return 1 << (int(n) - 1).bit_length() if n else 1


def pad(x: np.ndarray, width: int) -> np.ndarray:
    """x with zero columns up to width."""
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((x.shape[0], width - x.shape[1]))], axis=1)


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


#: Sides of the small Hadamard matrices, and cells of a block of rows that stays in a core's cache.
RADIX, BLOCK_CELLS = 16, 1 << 16


def fwht(x: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Walsh-Hadamard transform of every row in natural order, zero-padded to a power of two.

    The matrix is a Kronecker product of small ones, which are applied as matrix
    products to blocks of rows; a row costs about RADIX n log n / log RADIX.
    """
    x = np.asarray(x, float)
    one = x.ndim == 1
    x = x[None] if one else x
    n = next_power_of_two(x.shape[1])
    x, sides = pad(x, n), []
    while np.prod(sides, dtype=int) < n:
        sides.append(min(RADIX, n // int(np.prod(sides, dtype=int))))
    small = [_hadamard(s) for s in sides] or [np.ones((1, 1))]
    small[0] = small[0] / np.sqrt(n) if normalize else small[0]
    out, step = np.empty_like(x), max(1, BLOCK_CELLS // n)
    for lo in range(0, len(x), step):
        y, right = x[lo : lo + step], 1
        for h in small:
            y = y.reshape(-1, len(h)) @ h if right == 1 else np.matmul(h, y.reshape(-1, len(h), right))
            right *= len(h)
        out[lo : lo + step] = y.reshape(-1, n)
    return out[0] if one else out


def circulant(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Circular convolution of every row of x with w: row r is sum_c w[(r - c) mod d] x[c]."""
    d = len(w)
    return np.fft.irfft(np.fft.rfft(x, axis=1) * np.fft.rfft(w), n=d, axis=1)


def safe_power(x: np.ndarray, degree: int) -> np.ndarray:
    return x**degree


def elementwise_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * y


def project_simplex(v: np.ndarray, z: float = 1.0) -> np.ndarray:
    """Nearest point of {p >= 0, sum p = z}, by sorting."""
    v = np.asarray(v, float)
    u = np.sort(v)[::-1]
    theta = (np.cumsum(u) - z) / np.arange(1, len(u) + 1)
    return np.maximum(v - theta[np.flatnonzero(u > theta)[-1]], 0) if len(v) else v


def project_simplex_pivot(v: np.ndarray, z: float = 1.0, seed: int = 0) -> np.ndarray:
    """The same point in expected linear time: pivots split the candidates until the support is known."""
    v = np.asarray(v, float)
    rng, left, total, count = np.random.default_rng(seed), v, 0.0, 0
    while len(left):
        pivot = left[rng.integers(len(left))]
        high = left[left >= pivot]
        if total + high.sum() - (count + len(high)) * pivot < z:
            total, count = total + high.sum(), count + len(high)
            left = left[left < pivot]
        else:
            left = high[high > pivot]
    return np.maximum(v - (total - z) / max(count, 1), 0)

"""Exact kernels: scalar expressions on two array columns and batch forms on matrices.

``column(name, x, p, ...)`` is a Catalyst expression; ``matrix(name, X, P, ...)``
is its numpy form for blocks.  Both follow the same formulas.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.sparse import is_sparse

NAMES = ("linear", "poly", "rbf", "exp", "anova", "all_subsets", "intersection", "chi_square", "hellinger", "pairwise", "pairwise_symmetric")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, p: Column, degree: int = 1) -> Column:
    """Sum of x^degree p^degree."""
    power = (lambda v: v) if degree == 1 else (lambda v: F.pow(v, F.lit(float(degree))))
    return _sum(F.zip_with(x, p, lambda a, b: power(a * b)))


def anova(x: Column, p: Column, degree: int) -> Column:
    """Sum over all index sets of ``degree`` of the products x_j p_j.

    Degrees 1 to 3 in closed form over power sums, higher ones by the recurrence
    that takes each feature in turn.
    """
    if degree < 1:
        raise ValueError("the degree must be at least 1")
    if degree == 1:
        return dot(x, p)
    if degree == 2:
        return (F.pow(dot(x, p), F.lit(2.0)) - dot(x, p, 2)) / 2.0
    if degree == 3:
        d1 = dot(x, p)
        return (F.pow(d1, F.lit(3.0)) - 3.0 * dot(x, p, 2) * d1 + 2.0 * dot(x, p, 3)) / 6.0
    start = F.array(F.lit(1.0), *[F.lit(0.0)] * degree)
    step = lambda a, v: F.transform(a, lambda e, i: e + F.when(i > 0, v * F.get(a, i - 1)).otherwise(F.lit(0.0)))
    return F.element_at(F.aggregate(F.zip_with(x, p, lambda a, b: a * b), start, step), degree + 1)


def column(name: str, x: Column, p: Column, degree: int = 2, gamma: float = 1.0, bias: float = 0.0) -> Column:
    """The kernel of two array columns as one expression."""
    name = name.replace("-", "_")
    if name in ("linear", "dot"):
        return dot(x, p)
    if name == "poly":
        return F.pow(dot(x, p) + bias, F.lit(float(degree)))
    if name == "exp":
        return F.exp(gamma * dot(x, p))
    if name == "rbf":
        return F.exp(-gamma * _sum(F.zip_with(x, p, lambda a, b: (a - b) * (a - b))))
    if name in ("anova", "anova_cython"):
        return anova(x, p, degree)
    if name == "all_subsets":
        return F.aggregate(F.zip_with(x, p, lambda a, b: 1.0 + a * b), F.lit(1.0), lambda s, v: s * v)
    if name == "intersection":
        return _sum(F.zip_with(x, p, lambda a, b: F.least(a, b)))
    if name == "chi_square":
        return _sum(F.zip_with(x, p, lambda a, b: F.when(a + b == 0, 0.0).otherwise(2.0 * a * b / (a + b))))
    if name == "hellinger":
        return _sum(F.zip_with(x, p, lambda a, b: F.sqrt(a) * F.sqrt(b)))
    if name in ("pairwise", "pairwise_symmetric"):
        half = (F.size(x) / 2).cast("int")
        x1, x2, p1, p2 = F.slice(x, 1, half), F.slice(x, half + 1, half), F.slice(p, 1, half), F.slice(p, half + 1, half)
        plain = dot(x1, p1) * dot(x2, p2)
        value = plain if name == "pairwise" else 0.5 * (plain + dot(x1, p2) * dot(x2, p1))
        return F.when(F.size(x) % 2 == 0, value).otherwise(F.raise_error(F.lit("the pairwise kernel needs an even number of features")).cast("double"))
    raise ValueError(f"unknown kernel {name!r}; known are {', '.join(NAMES)}")


#: Kernels that ``scalars`` writes out feature by feature.
BY_FEATURE = ("linear", "dot", "poly", "exp", "rbf", "all_subsets", "intersection", "chi_square", "hellinger")

#: Of these, sums of a term a feature whose values do not repeat for alike rows, as minima do.
SUMS = ("chi_square", "hellinger")


def _if(condition: Column, yes: Column, no: Column) -> Column:
    """CASE WHEN as the function that Spark compiles to local variables."""
    return F.call_function("if", condition, yes, no)


def prepared(name: str, v: Column) -> Column:
    """One number as ``scalars`` takes it, so that what one side needs alone is computed once a row."""
    return F.sqrt(v) if name == "hellinger" else v


def side_sum(numbers: list[Column]) -> Column:
    """The sum of a row as ``quick`` takes it: not a number where it is too large for differences of sums to have the digits that ``rounded`` needs."""
    total = lambda cs: F.coalesce(sum(cs[1:], cs[0]), F.lit(0.0))
    return _if(total([F.abs(v) for v in numbers]) <= 1e4, total(numbers), F.lit(float("nan")))


def quick(name: str, x: list[Column], p: list[Column], x_sum: Column, p_sum: Column) -> Column | None:
    """``scalars`` but for its last digits, where that is quicker: smaller numbers without a branch, given each side's sum; else None."""
    if name != "intersection":
        return None
    return (x_sum + p_sum - reduce(lambda s, c: s + c, [F.abs(a - b) for a, b in zip(x, p)])) * 0.5


def rounded(c: Column, exact: Column | None = None) -> Column:
    """c to six digits where there is a row a pair: decimals, of ``exact`` if c is it but for its last digits, only next to ties of rounding and for large numbers.

    They cost thousands of other numbers' time.  c * 1e6 and the digits that decimals
    see lie less than 4e-16 of the number apart, so that c itself needs them only that
    close to a tie.
    """
    s = c * 1e6
    off = F.abs(s - F.rint(s))
    near = off + F.abs(s) * 1e-15 > 0.499999999 if exact is None else (off > 0.499) | (F.abs(s) >= 1e12)
    return _if(near, F.round(c if exact is None else exact, 6), F.rint(s) / 1e6) + F.lit(0.0)


def scalars(name: str, x: list[Column], p: list[Column], degree: int = 2, gamma: float = 1.0, bias: float = 0.0) -> Column:
    """The kernel of two rows of prepared numbers, a column each; one expression without arrays, which Spark compiles."""

    def total(term):
        return reduce(lambda s, c: s + c, [term(a, b) for a, b in zip(x, p)], F.lit(0.0))

    def dots():
        return total(lambda a, b: a * b)

    if name in ("linear", "dot", "hellinger"):
        return dots()
    if name == "poly":
        return F.pow(dots() + bias, F.lit(float(degree)))
    if name == "exp":
        return F.exp(gamma * dots())
    if name == "rbf":
        return F.exp(-gamma * total(lambda a, b: (a - b) * (a - b)))
    if name == "all_subsets":
        return reduce(lambda s, c: s * c, [1.0 + a * b for a, b in zip(x, p)], F.lit(1.0))
    if name == "intersection":
        return total(lambda a, b: _if(a < b, a, b))
    if name == "chi_square":
        return total(lambda a, b: F.when(a + b == 0, 0.0).otherwise(2.0 * a * b / (a + b)))
    raise ValueError(f"unknown kernel {name!r}; known here are {', '.join(BY_FEATURE)}")


#: Rows of one side that ``anova_matrix`` takes at once, so that its sums stay in cache.
TILE = 64


def anova_matrix(x: np.ndarray, p: np.ndarray, degree: int) -> np.ndarray:
    """ANOVA kernel by the power-sum recurrence: a_m = 1/m sum_t (-1)^(t+1) a_(m-t) D_t.  x may be compressed rows."""
    out = np.ones((len(x), len(p)))
    right = list(itertools.accumulate([p] * degree, np.multiply))
    for lo in range(0, len(x) if degree else 0, TILE):
        tile = x[lo : lo + TILE]
        left = (tile**t for t in range(1, degree + 1)) if is_sparse(tile) else itertools.accumulate([tile] * degree, np.multiply)
        sums = [a @ b.T for a, b in zip(left, right)]
        a, held = [None, sums[0]], np.empty_like(sums[0])
        for m in range(2, degree + 1):
            total = a[m - 1] * sums[0]
            for t in range(2, m):
                np.multiply(a[m - t], sums[t - 1], out=held)
                (np.add if t % 2 else np.subtract)(total, held, out=total)
            (np.add if m % 2 else np.subtract)(total, sums[m - 1], out=total)
            total /= m
            a.append(total)
        out[lo : lo + TILE] = a[degree]
    return out


def anova_by_features(x: np.ndarray, p: np.ndarray, degree: int) -> np.ndarray:
    """ANOVA kernel taking each feature in turn; stable where power sums cancel."""
    a = [np.ones((len(x), len(p))), *(np.zeros((len(x), len(p))) for _ in range(degree))]
    for j in range(x.shape[1]):
        v = np.outer(x[:, j], p[:, j])
        for t in range(degree, 0, -1):
            a[t] = a[t] + a[t - 1] * v
    return a[degree]


def matrix(name: str, x: np.ndarray, p: np.ndarray, degree: int = 2, gamma: float = 1.0, bias: float = 0.0) -> np.ndarray:
    """The kernel of all rows of x with all rows of p."""
    name = name.replace("-", "_")
    if name in ("linear", "dot"):
        return x @ p.T
    if name == "poly":
        return (x @ p.T + bias) ** degree
    if name == "exp":
        return np.exp(gamma * (x @ p.T))
    if name == "rbf":
        return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * (x @ p.T), 0))
    if name == "anova":
        return anova_matrix(x, p, degree)
    if name == "anova_cython":
        return anova_by_features(x, p, degree)
    if name == "all_subsets":
        out = np.ones((len(x), len(p)))
        for j in range(x.shape[1]):
            out *= 1 + np.outer(x[:, j], p[:, j])
        return out
    if name in ("intersection", "chi_square"):
        out = np.zeros((len(x), len(p)))
        for j in range(x.shape[1]):
            a, b = x[:, j][:, None], p[:, j][None]
            if name == "intersection":
                out += np.minimum(a, b)
            else:
                s = a + b
                out += np.where(s == 0, 0.0, 2 * a * b / np.where(s == 0, 1.0, s))
        return out
    if name == "hellinger":
        return np.sqrt(x) @ np.sqrt(p).T
    if name in ("pairwise", "pairwise_symmetric"):
        if x.shape[1] % 2:
            raise ValueError("the pairwise kernel needs an even number of features")
        h = x.shape[1] // 2
        plain = (x[:, :h] @ p[:, :h].T) * (x[:, h:] @ p[:, h:].T)
        return plain if name == "pairwise" else 0.5 * (plain + (x[:, :h] @ p[:, h:].T) * (x[:, h:] @ p[:, :h].T))
    raise ValueError(f"unknown kernel {name!r}; known are {', '.join(NAMES)}")


def maclaurin_coefficients(kernel: str, degree: int = 2, gamma: float = 1.0, bias: float = 0.0, max_expansion: int = 50) -> np.ndarray:
    """Coefficients of the power series of a dot-product kernel in <x, y>."""
    if kernel == "poly":
        return np.array([math.comb(degree, n) * bias ** (degree - n) for n in range(degree + 1)], float)
    if kernel == "exp":
        return np.array([gamma**n / math.factorial(n) for n in range(max_expansion + 1)])
    raise ValueError("a kernel besides 'poly' and 'exp' needs its coefficients")

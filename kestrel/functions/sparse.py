"""Compressed rows of a batch and products of them that cost as much as their non-zeros."""

from __future__ import annotations

import numpy as np

#: Cells of a block of gathered weights.
GATHER_CELLS = 4_000_000


def is_sparse(x) -> bool:
    """Whether x holds compressed rows; by its parts, as workers can import a class anew."""
    return hasattr(x, "indptr")


class Csr:
    """Rows of ``d`` features: non-zeros of row i are indices[indptr[i]:indptr[i + 1]] with their values in data."""

    def __init__(self, indptr, indices, data, d: int):
        self.indptr, self.indices, self.data, self.d = np.asarray(indptr, np.int64), np.asarray(indices, np.int64), np.asarray(data, float), int(d)

    def __len__(self) -> int:
        return len(self.indptr) - 1

    @property
    def shape(self):
        return len(self), self.d

    @property
    def size(self) -> int:
        return len(self.data)

    def rows(self):
        """The row of every non-zero."""
        return np.repeat(np.arange(len(self)), np.diff(self.indptr))

    def toarray(self):
        out = np.zeros(self.shape)
        np.add.at(out, (self.rows(), self.indices), self.data)
        return out

    def scale(self, s) -> Csr:
        """Features times s."""
        return Csr(self.indptr, self.indices, self.data * np.asarray(s)[self.indices], self.d)

    def __pow__(self, t) -> Csr:
        return Csr(self.indptr, self.indices, self.data**t, self.d)

    def __getitem__(self, part: slice) -> Csr:
        """A range of rows."""
        lo, hi, _ = part.indices(len(self))
        at = self.indptr[lo : max(lo, hi) + 1]
        return Csr(at - at[0], self.indices[at[0] : at[-1]], self.data[at[0] : at[-1]], self.d)

    def __matmul__(self, w):
        """The product with a matrix of d rows; a block of gathered weights is all that is held besides the result."""
        out = np.zeros((len(self), w.shape[1]))
        step = max(1, GATHER_CELLS // max(1, w.shape[1]))
        rows = self.rows()
        for lo in range(0, len(rows), step):
            part = slice(lo, lo + step)
            starts = np.flatnonzero(np.diff(rows[part], prepend=-1))
            if len(starts):  # a row that two blocks share is added up in both
                out[rows[part][starts]] += np.add.reduceat(w[self.indices[part]] * self.data[part, None], starts, axis=0)
        return out


class Postings:
    """A sparse matrix of n bases by features, as non-zeros sorted by feature."""

    def __init__(self, bases, features, values, n: int):
        order = np.argsort(features, kind="stable")
        self.bases, self.features, self.values, self.n = np.asarray(bases)[order], np.asarray(features)[order], np.asarray(values, float)[order], int(n)

    @classmethod
    def of(cls, subsets, values) -> Postings:
        """From the features of every base, one row a base, and their values."""
        n, k = subsets.shape
        return cls(np.repeat(np.arange(n), k), subsets.ravel(), values.ravel(), n)

    def keep(self, keep) -> Postings:
        """The bases of a sorted list alone, numbered anew."""
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        there = place[self.bases] >= 0
        return Postings(place[self.bases[there]], self.features[there], self.values[there], len(keep))

    def terms(self, x):
        """(row * n + base, product) of all pairs of non-zeros on one feature, sorted by the first."""
        if is_sparse(x):
            lo, hi = np.searchsorted(self.features, x.indices), np.searchsorted(self.features, x.indices, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            key, product = np.repeat(x.rows(), n) * self.n + self.bases[at], np.repeat(x.data, n) * self.values[at]
        else:
            key = (np.arange(len(x))[:, None] * self.n + self.bases).ravel()
            product = (x[:, self.features] * self.values).ravel()
        order = np.argsort(key, kind="stable")
        return key[order], product[order]

    def dot(self, x):
        """x times the transposed matrix, dense."""
        key, product = self.terms(x)
        return np.bincount(key, weights=product, minlength=len(x) * self.n).reshape(len(x), self.n)

    def anova(self, x, degree: int):
        """(rows, bases, values): the non-zero ANOVA kernels of rows and bases, by the recurrence over shared features."""
        key, product = self.terms(x)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        many = np.diff(np.append(starts, len(key)))
        a = np.zeros((degree + 1, len(starts)))
        a[0] = 1.0
        for p in range(int(many.max(initial=0))):
            some = np.flatnonzero(many > p)
            v = product[starts[some] + p]
            for t in range(degree, 0, -1):
                a[t, some] += a[t - 1, some] * v
        there = np.flatnonzero(a[degree])
        return key[starts[there]] // self.n, key[starts[there]] % self.n, a[degree, there]

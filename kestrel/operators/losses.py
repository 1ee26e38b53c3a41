"""Losses of a prediction p and a target y: value, derivative, conjugate, dual step.

Each loss has a numpy form for batches and a Column form; mu is the smoothness
that dual methods use (0: not smooth).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(p: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(0, p)) / (1 + np.exp(-np.abs(p)))


def sigmoid_column(p: Column) -> Column:
    return F.exp(F.least(F.lit(0.0), p)) / (1.0 + F.exp(-F.abs(p)))


class Squared:
    mu = 1.0

    def value(self, p, y):
        return 0.5 * (p - y) ** 2

    def dloss(self, p, y):
        return p - y

    def conjugate(self, a, y):
        return a * y + 0.5 * a * a

    def sdca_update(self, a, y, p, scale):
        return (y - a - p) / (1 + scale)

    def value_column(self, p, y):
        return 0.5 * (p - y) * (p - y)

    def dloss_column(self, p, y):
        return p - y


class Logistic:
    mu = 0.25
    CUTOFF = 18.0

    def value(self, p, y):
        z = p * y
        return np.where(z > self.CUTOFF, np.exp(-np.maximum(z, 0)), np.where(z < -self.CUTOFF, -z, np.log1p(np.exp(-np.clip(z, -self.CUTOFF, self.CUTOFF)))))

    def dloss(self, p, y):
        return -y * sigmoid(-p * y)

    def conjugate(self, a, y):
        """Entropy form; a y must lie in [-1, 0]."""
        t = -np.asarray(a * y, float)
        if (t < 0).any() or (t > 1).any():
            raise ValueError("the conjugate needs a y in [-1, 0]")
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(t > 0, t * np.log(np.where(t > 0, t, 1)), 0) + np.where(t < 1, (1 - t) * np.log(np.where(t < 1, 1 - t, 1)), 0)

    def sdca_update(self, a, y, p, scale):
        return (y * sigmoid(-p * y) - a) / np.maximum(1, 0.25 + scale)

    def value_column(self, p, y):
        z = p * y
        return F.when(z > self.CUTOFF, F.exp(-z)).when(z < -self.CUTOFF, -z).otherwise(F.log1p(F.exp(-z)))

    def dloss_column(self, p, y):
        return -y * sigmoid_column(-p * y)


class SquaredHinge:
    mu = 2.0

    def value(self, p, y):
        return np.maximum(1 - p * y, 0) ** 2

    def dloss(self, p, y):
        return -2 * y * np.maximum(1 - p * y, 0)

    def conjugate(self, a, y):
        return a * y + 0.25 * a * a

    def sdca_update(self, a, y, p, scale):
        step = (y - p - 0.5 * a) / (0.5 + scale)
        return np.where(y * (a + step) < 0, -a, step)

    def value_column(self, p, y):
        m = F.greatest(1.0 - p * y, F.lit(0.0))
        return m * m

    def dloss_column(self, p, y):
        return -2.0 * y * F.greatest(1.0 - p * y, F.lit(0.0))


class Hinge:
    mu = 0.0

    def value(self, p, y):
        return np.maximum(1 - p * y, 0)

    def dloss(self, p, y):
        return np.where(p * y < 1, -y, 0.0)

    def conjugate(self, a, y):
        return a * y

    def sdca_update(self, a, y, p, scale):
        return y * np.clip((1 - p * y) / scale + a * y, 0, 1) - a

    def value_column(self, p, y):
        return F.greatest(1.0 - p * y, F.lit(0.0))

    def dloss_column(self, p, y):
        return F.when(p * y < 1.0, -y).otherwise(F.lit(0.0))


LOSSES = {"squared": Squared(), "logistic": Logistic(), "log": Logistic(), "squared_hinge": SquaredHinge(), "hinge": Hinge()}
CLASSIFIER_LOSSES = ("squared_hinge", "logistic", "hinge", "log")
REGRESSOR_LOSSES = ("squared",)

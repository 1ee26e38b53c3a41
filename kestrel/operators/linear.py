"""Linear models on mapped features: training and serving without storing the mapped rows.

``mode`` says how an epoch runs:

* ``full_batch``: one aggregation gives the mean gradient, the driver takes the
  solver's step with it; the result does not depend on order or partitions;
* ``distributed``: every partition runs the solver's own steps on its rows from
  the broadcast state, ``step_rows`` rows a step as one matrix product, and states
  are averaged by rows;
* ``sequential``: one stream in the order of a digest of (seed, epoch, id), as a
  single machine would run it; for small data and equivalence tests.

The objective is the mean loss plus alpha/C [(1 - l1_ratio)/2 |w|^2 + l1_ratio |w|_1]
plus intercept_decay/C times half the squared intercept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kestrel.operators.doubly import doubly
from kestrel.operators.losses import CLASSIFIER_LOSSES, LOSSES, REGRESSOR_LOSSES, sigmoid_column
from kestrel.operators.maps import FeatureMap, RBFSampler, SparseMB, _width, batch_for, map_batches
from kestrel.sources.features import batch_matrix, binary_target, numeric_target, width_of
from kestrel.sources.tables import discard, materialise

#: Parts in which the rows of one id are numbered.
KEY_PARTS = 64

RATES = ("constant", "pegasos", "inv_scaling", "optimal", "original")


def learning_rate(kind: str, t: int, eta0: float, l2: float, power_t: float = 1.0, eta1: float = 1e-4) -> float:
    if kind == "constant":
        return eta0
    if kind == "pegasos":
        return 1.0 / (l2 * t)
    if kind == "inv_scaling":
        return eta0 / t**power_t
    if kind == "optimal":
        return eta0 / (1.0 + eta0 * l2 * t) ** power_t
    if kind == "original":
        return eta0 / (1.0 + eta1 * t)
    raise ValueError(f"unknown learning rate {kind!r}; known are {', '.join(RATES)}")


def soft(w, t):
    """Soft threshold, the proximal step of the L1 norm."""
    return np.sign(w) * np.maximum(np.abs(w) - t, 0)


@dataclass
class State:
    """What training carries from step to step; vectors have the map's width and one cell for the intercept."""

    w: np.ndarray
    t: int = 1
    slots: dict = field(default_factory=dict)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.w, *(np.atleast_1d(self.slots[k]) for k in sorted(self.slots))])

    def unpack(self, flat: np.ndarray, t: int) -> State:
        out, at = State(flat[: len(self.w)].copy(), t), len(self.w)
        for k in sorted(self.slots):
            n = np.size(self.slots[k])
            out.slots[k] = flat[at : at + n].copy()
            at += n
        return out


class Solver:
    """``step(state, g)`` moves the state by one gradient of the loss (intercept last)."""

    def __init__(self, p):
        self.p = p
        self.l1, self.l2 = p.alpha / p.C * p.l1_ratio, p.alpha / p.C * (1 - p.l1_ratio)
        self.decay = p.intercept_decay / p.C

    def start(self, width: int) -> State:
        return State(np.zeros(width + 1))

    def step(self, s: State, g: np.ndarray) -> None:
        raise NotImplementedError

    def coefficients(self, s: State) -> np.ndarray:
        return s.w


class SGD(Solver):
    """Proximal stochastic gradient, with a running mean from step ``average`` on."""

    def start(self, width):
        return State(np.zeros(width + 1), slots={"mean": np.zeros(width + 1)} if self.p.average else {})

    def step(self, s, g):
        eta = learning_rate(self.p.learning_rate, s.t, self.p.eta0, self.l2, self.p.power_t)
        w, b = s.w[:-1], s.w[-1]
        s.w = np.append(soft(w - eta * (g[:-1] + self.l2 * w), self.l1 * eta), b - eta * (g[-1] + self.decay * b) if self.p.fit_intercept else b)
        if self.p.average:
            n = max(1, s.t - int(self.p.average) + 1)
            s.slots["mean"] = s.slots["mean"] + (s.w - s.slots["mean"]) / n if s.t >= self.p.average else s.w.copy()
        s.t += 1

    def coefficients(self, s):
        return s.slots["mean"] if self.p.average else s.w


class AdaGrad(Solver):
    """Dual averaging: the weights are a closed form of the summed and the squared gradients."""

    def start(self, width):
        return State(np.zeros(width + 1), slots={"g": np.zeros(width + 1), "g2": np.zeros(width + 1)})

    def step(self, s, g):
        s.slots["g"] = s.slots["g"] + g
        s.slots["g2"] = s.slots["g2"] + g * g
        eta_t = self.p.eta0 * s.t
        l1 = np.append(np.full(len(g) - 1, self.l1), 0.0)
        l2 = np.append(np.full(len(g) - 1, self.l2), self.decay)
        w = -eta_t * soft(s.slots["g"] / s.t, l1) / (np.sqrt(s.slots["g2"]) + self.p.eps + l2 * eta_t)
        s.w = w if self.p.fit_intercept else np.append(w[:-1], 0.0)
        s.t += 1


class Adam(Solver):
    """Bias-corrected moments; the proximal step has lambda eta / sqrt t."""

    def start(self, width):
        return State(np.zeros(width + 1), slots={"m": np.zeros(width + 1), "v": np.zeros(width + 1)})

    def step(self, s, g):
        b1, b2 = self.p.beta1, self.p.beta2
        full = g + np.append(self.l2 * s.w[:-1], self.decay * s.w[-1])
        s.slots["m"] = b1 * s.slots["m"] + (1 - b1) * full
        s.slots["v"] = b2 * s.slots["v"] + (1 - b2) * full * full
        eta = self.p.eta0
        w = s.w - eta * (s.slots["m"] / (1 - b1**s.t)) / (np.sqrt(s.slots["v"] / (1 - b2**s.t)) + self.p.eps)
        s.w = np.append(soft(w[:-1], self.l1 * eta / math.sqrt(s.t)), w[-1] if self.p.fit_intercept else 0.0)
        s.t += 1


@dataclass
class Params:
    """Parameters of all solvers; each estimator uses those its solver knows."""

    transformer: FeatureMap | None = None
    loss: str = "squared"
    C: float = 1.0
    alpha: float = 1.0
    l1_ratio: float = 0.0
    intercept_decay: float = 0.1
    fit_intercept: bool = True
    max_iter: int = 100
    tol: float = 1e-6
    warm_start: bool = False
    seed: int = 0
    normalize: bool = False
    mode: str = "distributed"
    eta0: float = 0.01
    learning_rate: str = "optimal"
    power_t: float = 0.75
    average: int = 1
    eps: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999
    is_saga: bool = True
    batch_size: int = 10
    n_bases_sampled: int = 1
    eta1: float = 1e-4
    n_components: int = 1000
    step_rows: int | None = None

    def rows_a_step(self) -> int:
        """Rows whose mean gradient is one step: one in sequence, else 4 where nothing else is asked for."""
        return self.step_rows or (4 if self.mode == "distributed" else 1)


def validate(p: Params, losses) -> None:
    def need(ok, what):
        if not ok:
            raise ValueError(what)

    need(p.loss in losses, f"loss {p.loss!r} is not supported; supported are {', '.join(losses)}")
    need(p.C > 0, "C must be above 0")
    need(p.alpha >= 0, "alpha must not be negative")
    need(p.intercept_decay >= 0, "intercept_decay must not be negative")
    need(p.tol >= 0, "tol must not be negative")
    need(0 <= p.l1_ratio <= 1, "l1_ratio must be in [0, 1]")
    need(p.eps > 0, "eps must be above 0")
    need(p.eta0 > 0, "eta0 must be above 0")
    need(p.max_iter >= 1, "max_iter must be at least 1")
    need(0 < p.beta1 < 1 and 0 < p.beta2 < 1, "beta1 and beta2 must be in (0, 1)")
    need(p.mode in ("full_batch", "distributed", "sequential"), f"unknown mode {p.mode!r}")
    need(p.learning_rate in RATES, f"unknown learning rate {p.learning_rate!r}")
    need(p.learning_rate != "pegasos" or (p.alpha > 0 and p.l1_ratio < 1), "pegasos needs alpha > 0 and l1_ratio < 1")
    need(p.step_rows is None or p.step_rows >= 1, "step_rows must be at least 1")
    need(p.batch_size >= 1 and p.n_bases_sampled >= 1, "batch_size and n_bases_sampled must be at least 1")


@dataclass
class Scorer:
    """A map with coefficients: what serving broadcasts."""

    map: object
    coef: np.ndarray
    intercept: float
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def z(self, x):
        z = self.map.apply(_width(self.map, x))
        return z if self.mean is None else (z - self.mean) / self.std

    def margin(self, x):
        return self.z(x) @ self.coef + self.intercept


class _DoublyScorer:
    def __init__(self, base, coef, intercept):
        self.base, self.coef, self.intercept, self.width = base, coef, intercept, 1024

    def margin(self, x):
        return self.base.predict(x, self.coef) + self.intercept


class _Linear:
    """Shared training and serving; subclasses fix the solver and the task."""

    classifier = False
    solver_class = SGD
    defaults: dict = {}
    losses: tuple = REGRESSOR_LOSSES

    def __init__(self, **params):
        unknown = set(params) - set(Params.__dataclass_fields__)
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        self.p = Params(**({"loss": "squared_hinge" if self.classifier else "squared"} | self.defaults | params))
        validate(self.p, self.losses)
        #: Mean loss of every epoch, and with the penalty of the weights that the epoch starts from.
        self.history: list[float] = []
        self.objectives: list[float] = []

    def penalty(self, w: np.ndarray) -> float:
        """Penalty of weights with the intercept last."""
        p, v = self.p, w[:-1]
        smooth = p.alpha / p.C * (0.5 * (1 - p.l1_ratio) * float(v @ v) + p.l1_ratio * float(np.abs(v).sum()))
        return smooth + 0.5 * p.intercept_decay / p.C * float(w[-1] ** 2)

    # training

    def _target(self, df: DataFrame, features: str, label: str, id_col: str) -> DataFrame:
        if self.classifier:
            values = sorted(r[0] for r in df.select(label).distinct().limit(3).collect() if r[0] is not None)
            encoded = binary_target(df, label, "__y")
            self.classes_ = values
        else:
            encoded = numeric_target(df, label, "__y")
        return encoded.select(F.col(id_col).alias("__id"), F.col(features).alias("__x"), "__y")

    def _prepare(self, df: DataFrame):
        warm = self.p.warm_start and hasattr(self, "state_")
        if not warm:
            m = self.p.transformer or RBFSampler(seed=self.p.seed)
            if not hasattr(m, "d"):
                m.fit(width_of(df, "__x"))
            self.map_ = m
            self.solver_ = self.solver_class(self.p)
            self.state_ = self.solver_.start(m.width)
            self.mean_ = self.std_ = None
            if self.p.normalize:
                self.mean_, self.std_ = moments(df, m, "__x")
        return df

    def fit(self, df: DataFrame, features: str = "features", label: str = "label", id_col: str = "id"):
        """Train until max_iter epochs or a change of the coefficients below tol."""
        rows = self._stored(self._prepare(self._target(df, features, label, id_col)))
        try:
            for epoch in range(self.p.max_iter):
                before = self.solver_.coefficients(self.state_).copy()
                penalty = self.penalty(self.state_.w)
                self._epoch(rows, epoch)
                self.objectives.append(self.history[-1] + penalty)
                if np.abs(self.solver_.coefficients(self.state_) - before).sum() < self.p.tol:
                    break
        finally:
            rows.unpersist()
        return self._finish()

    def _stored(self, rows: DataFrame) -> DataFrame:
        """What the epochs read."""
        return rows.cache()

    def resume(self, d: int, t: int, flat: np.ndarray):
        """Take up training from a stored state (``state_.t`` and ``state_.pack()``) over rows of d features."""
        if self.p.normalize:
            raise ValueError("a normalised model is not resumed: its moments are those of its first rows")
        m = self.p.transformer or RBFSampler(seed=self.p.seed)
        self.map_ = m if hasattr(m, "d") else m.fit(d)
        self.solver_, self.mean_, self.std_ = self.solver_class(self.p), None, None
        self.state_ = self.solver_.start(self.map_.width).unpack(np.asarray(flat, float), t)
        self.p.warm_start = True
        return self._finish()

    def _finish(self):
        w = self.solver_.coefficients(self.state_)
        self.coef_, self.intercept_, self.t_ = w[:-1], float(w[-1]), self.state_.t
        return self

    def _scorer(self, w) -> Scorer:
        return Scorer(self.map_, w[:-1], float(w[-1]), self.mean_, self.std_)

    def _epoch(self, rows: DataFrame, epoch: int) -> None:
        if self.p.mode == "full_batch":
            g, loss = mean_gradient(rows, self._scorer(self.state_.w), self.p.loss)
            self.history.append(loss)
            self.solver_.step(self.state_, g)
            return
        if self.p.mode == "sequential":
            order = F.md5(F.concat_ws("|", F.lit(self.p.seed), F.lit(epoch), F.col("__id").cast("string")))
            rows = rows.repartition(1).sortWithinPartitions(order, "__id")
        shared = rows.sparkSession.sparkContext.broadcast((self.solver_, self.state_, self._scorer(self.state_.w), LOSSES[self.p.loss]))

        step = self.p.rows_a_step()

        def run(batches):
            solver, s, scorer, loss = shared.value
            s = State(s.w.copy(), s.t, dict(s.slots))
            n, total, g, held = 0, 0.0, np.zeros(len(s.w)), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                z, y = scorer.z(batch_for(scorer.map, batch.column(0))), batch.column(1).to_numpy()
                lo = 0
                while lo < len(y):
                    part = slice(lo, lo + step - held)
                    margin = z[part] @ s.w[:-1] + s.w[-1]
                    d = loss.dloss(margin, y[part])
                    total += float(np.sum(loss.value(margin, y[part])))
                    g[:-1] += d @ z[part]
                    g[-1] += d.sum()
                    held += len(d)
                    lo += len(d)
                    if held == step:
                        solver.step(s, g / held)
                        g, held = np.zeros(len(s.w)), 0
                n += len(y)
            if held:
                solver.step(s, g / held)
            if n:
                flat = np.concatenate([s.pack(), [total / n]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), n, np.int64))], ["j", "s", "n"])

        # weighted mean of the partitions' states, a row a state cell on the driver
        means = rows.select("__x", "__y").mapInArrow(run, "j long, s double, n long").groupBy("j").agg((F.sum("s") / F.sum("n")).alias("v"), F.sum("n").alias("n")).toArrow()
        order = np.argsort(means.column("j").to_numpy())
        flat, n = means.column("v").to_numpy()[order], int(means.column("n").to_numpy()[0])
        self.history.append(float(flat[-1]))
        self.state_ = self.state_.unpack(flat[:-1], self.state_.t + -(-n // step))

    # serving

    def decision_function(self, df: DataFrame, features: str = "features", out: str = "margin") -> DataFrame:
        """df with the margin: one fused map-and-dot batch function."""
        scorer = _DoublyScorer(self.base_, self.coef_, self.intercept_) if hasattr(self, "base_") else self._scorer(np.append(self.coef_, self.intercept_))
        return map_batches(df, features, out, scorer, lambda m, x: m.margin(x), DoubleType())

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        scored = self.decision_function(df, features, "__margin")
        low, high = self.classes_ if self.classifier else (None, None)
        value = F.when(F.col("__margin") > 0, F.lit(high)).otherwise(F.lit(low)) if self.classifier else F.col("__margin")
        return scored.withColumn(out, value).drop("__margin")

    def score(self, df: DataFrame, features: str = "features", label: str = "label") -> float:
        """Accuracy of a classifier, R^2 of a regressor."""
        predicted = self.predict(df, features, "__p")
        return accuracy(predicted, label, "__p") if self.classifier else r2(predicted, label, "__p")


def mean_gradient(rows: DataFrame, scorer, loss_name: str) -> tuple[np.ndarray, float]:
    """Mean of dloss (z, 1) and of the loss, from a partial sum a task."""
    shared = rows.sparkSession.sparkContext.broadcast((scorer, LOSSES[loss_name]))

    def run(batches):
        scorer, loss = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                z, y = scorer.z(batch_for(scorer.map, batch.column(0))), batch.column(1).to_numpy()
                p = z @ scorer.coef + scorer.intercept
                d = loss.dloss(p, y)
                part = np.concatenate([d @ z, [d.sum(), loss.value(p, y).sum(), len(y)]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["j", "s"])

    sums = rows.select("__x", "__y").mapInArrow(run, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).toArrow()
    flat = sums.column("s").to_numpy()[np.argsort(sums.column("j").to_numpy())]
    return flat[:-2] / flat[-1], float(flat[-2] / flat[-1])


def moments(df: DataFrame, m, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact mean and deviation of every mapped component; the deviation has 1e-6 added, as a divisor."""
    shared = df.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                z = m.apply(_width(m, batch_for(m, batch.column(0))))
                mean = z.mean(axis=0)
                part = (len(z), mean, ((z - mean) ** 2).sum(axis=0))
                if total is None:
                    total = part
                else:  # parallel sums of squares
                    n, k = total[0] + part[0], part[1] - total[1]
                    total = (n, total[1] + k * part[0] / n, total[2] + part[2] + k * k * total[0] * part[0] / n)
        if total is not None:
            d = len(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, total[0], np.int64)), pa.array(total[1]), pa.array(total[2])], ["j", "n", "mean", "m2"])

    parts = df.select(features).mapInArrow(run, "j long, n long, mean double, m2 double")
    sums = parts.groupBy("j").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q")).orderBy("j").toArrow()
    n, mean = sums.column("n").to_numpy(), sums.column("mean").to_numpy()
    m2 = sums.column("m2").to_numpy() + np.maximum(sums.column("q").to_numpy() - n * mean**2, 0)
    return mean, 1e-6 + np.sqrt(m2 / np.maximum(1, n - 1))


def accuracy(df: DataFrame, label: str, prediction: str) -> float:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).first()[0]


def r2(df: DataFrame, label: str, prediction: str) -> float:
    y, p = F.col(label).cast("double"), F.col(prediction)
    mean = df.agg(F.avg(y)).first()[0]
    rest, total = df.agg(F.sum((y - p) * (y - p)), F.sum((y - mean) * (y - mean))).first()
    return 1.0 - rest / total


class _Keyed(_Linear):
    """Solvers with a number a row (SAGA gradients, SDCA duals), stored beside the row.

    An epoch reads the stored rows and writes them with their new numbers; there is
    no join and no shuffle, and a row has one number whatever its id.  A warm start
    finds the numbers again by the id, a part by the row's content and the place
    within it, so rows that repeat or lack an id keep theirs too.
    """

    def _stored(self, rows):
        content = F.xxhash64("__x", "__y")
        keyed = rows.withColumn("__part", F.pmod(content, F.lit(KEY_PARTS)).cast("int"))
        keyed = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__part").orderBy(content)))
        if self.p.warm_start and hasattr(self, "rows_"):
            names = ("__id", "__part", "__n")
            known = self.rows_.select(*(F.col(c).alias(f"{c}_") for c in names), "m")
            keyed = keyed.join(known, reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names)), "left")
            keyed = keyed.select("__id", "__part", "__n", "__x", "__y", F.coalesce("m", F.lit(0.0)).alias("m"))
        else:
            keyed = keyed.select("__id", "__part", "__n", "__x", "__y", F.lit(0.0).alias("m"))
        self.rows_ = materialise(keyed, "keyed-rows")
        self.n_rows_ = self.rows_.count()
        return self.rows_

    def _epoch(self, rows, epoch):
        rows, n = self.rows_, self.n_rows_
        if not n:
            return
        spark, written = rows.sparkSession, rows
        one = self.p.mode != "distributed"
        if one:
            order = F.md5(F.concat_ws("|", F.lit(self.p.seed), F.lit(epoch), F.col("__id").cast("string")))
            rows = rows.repartition(1).sortWithinPartitions(order, "__id", "__part", "__n")
        parts = 1 if one else max(1, rows.rdd.getNumPartitions())
        shared = spark.sparkContext.broadcast((self._scorer(self.state_.w), self.state_, LOSSES[self.p.loss], n, parts, self.solver_))
        local, step = self._local, self.p.rows_a_step()

        def run(batches):
            scorer, state, loss, n, parts, solver = shared.value
            s = State(state.w.copy(), state.t, dict(state.slots))
            rows_seen, total = 0, 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                types = batch.schema.types
                z, y, m = scorer.z(batch_for(scorer.map, batch.column(3))), batch.column(4).to_numpy(), batch.column(5).to_numpy().copy()
                z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
                for lo in range(0, len(y), step):
                    some = slice(lo, lo + step)
                    total += local(solver, s, z[some], y[some], m[some], loss, n, parts)
                rows_seen += len(y)
                empty = pa.nulls(len(m), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(m), pa.nulls(len(m), pa.int64()), empty, empty], names)
            if rows_seen:
                flat = np.append(s.pack(), total / rows_seen)
                lost = [pa.nulls(len(flat), t) for t in types]
                yield pa.RecordBatch.from_arrays([*lost, pa.array(np.arange(len(flat))), pa.array(flat * rows_seen), pa.array(np.full(len(flat), float(rows_seen)))], names)

        schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields]).add("j", LongType()).add("v", DoubleType()).add("n", DoubleType())
        names = schema.names
        out = materialise(rows.mapInArrow(run, schema), "keyed-epoch")
        self.rows_ = out.where("j IS NULL").drop("j", "v", "n")
        means = out.where("j IS NOT NULL").groupBy("j").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        flat = means.column("v").to_numpy()[np.argsort(means.column("j").to_numpy())]
        self.history.append(float(flat[-1]))
        self.state_ = self.state_.unpack(flat[:-1], self.state_.t + -(-n // step))
        shared.unpersist()
        discard(written)


class SAG(Solver):
    def start(self, width):
        return State(np.zeros(width + 1), slots={"mean_g": np.zeros(width + 1)})


class _SAGA(_Keyed):
    """SAG or SAGA: steps reduced in variance by the stored gradient of each row."""

    solver_class = SAG
    defaults = dict(learning_rate="optimal", power_t=1.0, average=0)

    @staticmethod
    def _local(solver, s, z, y, m, loss, n, parts):
        p, mean = solver.p, s.slots["mean_g"]
        margin = z @ s.w
        new = loss.dloss(margin, y)
        eta = learning_rate(p.learning_rate, s.t, p.eta0, solver.l2, p.power_t)
        change = (new - m) @ z
        g = change / (len(y) if p.is_saga else n) + mean + np.append(solver.l2 * s.w[:-1], solver.decay * s.w[-1])
        w = s.w - eta * g
        s.w = np.append(soft(w[:-1], solver.l1 * eta), w[-1] if p.fit_intercept else 0.0)
        s.slots["mean_g"] = mean + change * parts / n  # averaging over partitions makes it the sum over rows by n
        m[:] = new
        s.t += 1
        return float(np.sum(loss.value(margin, y)))


class SDCASolver(Solver):
    def start(self, width):
        return State(np.zeros(width + 1), slots={"u": np.zeros(width + 1)})


class _SDCA(_Keyed):
    """Proximal dual coordinate ascent: u = sum a z / (l2 n) and w = soft(u, l1 / l2).

    The intercept is an extra feature of weight sqrt(l2 / decay) relative to it.
    """

    solver_class = SDCASolver

    def __init__(self, **params):
        super().__init__(**params)
        if self.p.alpha * (1 - self.p.l1_ratio) <= 0:
            raise ValueError("alpha (1 - l1_ratio) must be above 0")

    @staticmethod
    def _local(solver, s, z, y, m, loss, n, parts):
        l2, l1 = solver.l2, solver.l1
        scale = np.ones(z.shape[1])
        scale[-1] = math.sqrt(l2 / solver.decay) if solver.decay > 0 and solver.p.fit_intercept else 0.0
        u, v = s.slots["u"], z * scale
        margin = v @ np.append(soft(u[:-1], l1 / l2), u[-1])
        # rows that step at once, here and in other partitions, each step against a share of the rows
        step = loss.sdca_update(m, y, margin, (v * v).sum(axis=1) * parts * len(y) / (l2 * n))
        m += step / parts
        u = u + step @ v / (l2 * n)
        s.t += 1
        s.slots["u"] = u
        s.w = np.append(soft(u[:-1], l1 / l2), u[-1] * scale[-1])
        return float(np.sum(loss.value(margin, y)))


class _Doubly(_Linear):
    """Doubly stochastic gradient: each mini-batch adds bases that are regenerated from the seed.

    An epoch is one pass.  In every partition (``distributed``), or in one stream in
    the order of a digest (``sequential``), mini-batches of ``batch_size`` rows take
    a step each with new bases of their own: old coefficients shrink, the new ones are
    -eta mean(dloss z).  Partitions number their bases apart, and the model is the
    mean of theirs by rows.  A stream's last mini-batch is filled up with the rows
    before it.  ``full_batch`` makes one step an epoch, over all rows.
    """

    defaults = dict(eta0=0.1, alpha=1e-3, intercept_decay=1e-4, learning_rate="optimal", power_t=1.0, average=0)

    def fit(self, df, features="features", label="label", id_col="id"):
        rows = materialise(self._target(df, features, label, id_col), "doubly-rows")
        if not (self.p.warm_start and hasattr(self, "base_")):
            self.base_ = doubly(self.p.transformer or RBFSampler(seed=self.p.seed), width_of(rows, "__x"))
            self.coef_, self.intercept_, self.t_ = np.zeros(0), 0.0, 1
        for epoch in range(self.p.max_iter):
            before = self.coef_
            self._epoch(rows, epoch)
            if len(before) and np.abs(self.coef_[: len(before)] - before).sum() + np.abs(self.coef_[len(before) :]).sum() < self.p.tol:
                break
        discard(rows)
        return self

    def _epoch(self, rows, epoch):
        if self.p.mode == "sequential":
            order = F.md5(F.concat_ws("|", F.lit(self.p.seed), F.lit(epoch), F.col("__id").cast("string")))
            rows = rows.repartition(1).sortWithinPartitions(order, "__id")
        rows = rows.select("__x", "__y")

        def sizes(batches):
            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64())})

        # how many rows each partition has says which bases are its own; a row a partition on the driver
        held = {r.p: r.n for r in rows.mapInArrow(sizes, "p long, n long").collect()}
        n = sum(held.values())
        size = n if self.p.mode == "full_batch" else min(self.p.batch_size, n)
        if self.p.mode == "full_batch":
            return self._whole(rows, n)
        per, more, starts, at = self.base_.columns_per_base, self.p.n_bases_sampled, {}, len(self.coef_) // self.base_.columns_per_base
        for p in sorted(held):
            starts[p] = at
            at += -(-held[p] // size) * more
        p = self.p
        l1, l2, decay = p.alpha / p.C * p.l1_ratio, p.alpha / p.C * (1 - p.l1_ratio), p.intercept_decay / p.C
        shared = rows.sparkSession.sparkContext.broadcast((self.base_, self.coef_, self.intercept_, LOSSES[p.loss], starts))
        t0 = self.t_

        def run(batches):
            base, old, b, loss, starts = shared.value
            start = starts[TaskContext.get().partitionId()]
            new, t, seen, total, old = np.zeros(0), t0, 0, 0.0, old.copy()
            x, y, fresh = None, None, 0

            def step(x, y, fresh):
                nonlocal old, new, b, t, total
                lo = start + len(new) // per
                margin = base.predict(x, old) + base.predict(x, new, first=start) + b
                d = loss.dloss(margin, y)
                total += float(np.sum(loss.value(margin, y)[len(y) - fresh :]))
                eta = learning_rate(p.learning_rate, t, p.eta0, l2, p.power_t, p.eta1)
                old, new = (soft((1 - eta * l2) * c, l1 * eta) for c in (old, new))
                new = np.concatenate([new, soft(-eta * (d @ base.block(x, lo, lo + more)) / len(y), l1 * eta)])
                if p.fit_intercept:
                    b -= eta * (d.mean() + decay * b)
                t += 1

            for batch in batches:
                if not batch.num_rows:
                    continue
                bx, by = batch_matrix(batch.column(0)), batch.column(1).to_numpy()
                x, y = (bx, by) if x is None else (np.concatenate([x, bx]), np.concatenate([y, by]))
                fresh, seen = fresh + len(by), seen + len(by)
                while fresh >= size:
                    lo = len(y) - fresh
                    step(x[lo : lo + size], y[lo : lo + size], size)
                    fresh -= size
                keep = max(fresh, min(size, len(y)))
                x, y = x[len(y) - keep :], y[len(y) - keep :]
            if fresh:
                step(x[-size:], y[-size:], fresh)
            if seen:
                j = np.concatenate([np.arange(len(old)), start * per + np.arange(len(new)), [-1, -2]])
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int64)), pa.array(np.concatenate([old, new, [b, total / seen]]) * seen)], ["j", "s"])

        sums = rows.mapInArrow(run, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).toArrow()  # a row a coefficient
        flat = np.zeros(at * per + 2)
        flat[sums.column("j").to_numpy()] = sums.column("s").to_numpy() / max(1, n)
        self.coef_, self.intercept_ = flat[:-2], float(flat[-1])
        self.history.append(float(flat[-2]))
        self.t_ += max([0, *(-(-k // size) for k in held.values())]) if n else 0
        shared.unpersist()

    def _whole(self, rows: DataFrame, n: int) -> None:
        """One step with the mean gradient of all rows."""
        if not n:
            return
        p = self.p
        bases = len(self.coef_) // self.base_.columns_per_base
        l1, l2 = p.alpha / p.C * p.l1_ratio, p.alpha / p.C * (1 - p.l1_ratio)
        shared = rows.sparkSession.sparkContext.broadcast((self.base_, self.coef_, self.intercept_, LOSSES[p.loss], bases, bases + p.n_bases_sampled))

        def run(batches):
            base, coef, intercept, loss, lo, hi = shared.value
            total = None
            for batch in batches:
                if batch.num_rows:
                    x, y = batch_matrix(batch.column(0)), batch.column(1).to_numpy()
                    margin = base.predict(x, coef) + intercept
                    d = loss.dloss(margin, y)
                    one = np.concatenate([d @ base.block(x, lo, hi), [d.sum(), loss.value(margin, y).sum()]])
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["j", "s"])

        sums = rows.mapInArrow(run, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).toArrow()
        g = sums.column("s").to_numpy()[np.argsort(sums.column("j").to_numpy())] / n
        eta = learning_rate(p.learning_rate, self.t_, p.eta0, l2, p.power_t, p.eta1)
        self.coef_ = np.concatenate([soft((1 - eta * l2) * self.coef_, l1 * eta), soft(-eta * g[:-2], l1 * eta)])
        if p.fit_intercept:
            self.intercept_ -= eta * (g[-2] + p.intercept_decay / p.C * self.intercept_)
        self.history.append(float(g[-1]))
        self.t_ += 1
        shared.unpersist()


class _SparseMB(_Linear):
    """Linear model on SparseMB cells with a tri-diagonal smoothness penalty, in the primal.

    Newton steps, each solved by conjugate gradients: a product with the curvature is
    one aggregation of as many numbers as there are cells, and rows are never mapped
    wider than their two cells a feature.  The curvature between neighbouring cells,
    with the penalty a tri-diagonal matrix, is the preconditioner.  The end is the
    point where coordinate descent on the same objective ends.
    """

    defaults = dict(alpha=1.0, eps=1e-4, n_components=1000, mode="full_batch")
    losses = REGRESSOR_LOSSES

    def fit(self, df, features="features", label="label", id_col="id"):
        rows = self._target(df, features, label, id_col).cache()
        try:
            if not (self.p.warm_start and hasattr(self, "coef_")):
                self.map_ = SparseMB(self.p.n_components).fit(width_of(rows, "__x"))
                self.coef_, self.intercept_ = np.zeros(self.map_.width), 0.0
            self.mean_ = self.std_ = None
            n, alpha = self.map_.width, self.p.alpha / self.p.C
            band = np.full(n, 2 + self.p.eps), np.full(max(0, n - 1), -1.0)
            band[0][0] = band[0][-1] = 1 + self.p.eps

            def penalty(v):
                out = band[0] * v
                out[1:] += band[1] * v[:-1]
                out[:-1] += band[1] * v[1:]
                return alpha * out

            def objective(w):
                value, g, diagonal, beside = self._slope(rows, w)
                smooth = penalty(w[:-1])
                g[:-1] += smooth
                return value + 0.5 * float(w[:-1] @ smooth), g, diagonal, beside

            w = np.append(self.coef_, self.intercept_)
            value, g, diagonal, beside = objective(w)
            for _ in range(self.p.max_iter):
                if not self.p.fit_intercept:
                    g[-1] = 0.0
                precondition = _tridiagonal(diagonal[:-1] + alpha * band[0], beside + alpha * band[1])
                scaled = lambda r, c=diagonal[-1], solve=precondition: np.append(solve(r[:-1]), r[-1] / max(c, 1e-12))
                if float(g @ scaled(g)) <= 1e-3 * self.p.tol:  # what a step can still gain
                    break
                step = self._newton(rows, w, g, penalty, scaled)
                size = 1.0
                while True:
                    new = objective(w + size * step)
                    if new[0] <= value + 1e-12 or size < 1e-6:
                        break
                    size /= 2
                self.history.append(new[0])
                w, done = w + size * step, value - new[0] < self.p.tol
                value, g, diagonal, beside = new
                if done:
                    break
            self.coef_, self.intercept_ = w[:-1], float(w[-1])
            self.state_, self.solver_ = State(w), SGD(self.p)
        finally:
            rows.unpersist()
        return self

    def _newton(self, rows, w, g, penalty, precondition) -> np.ndarray:
        """The step to the minimum of the quadratic at w, by conjugate gradients."""
        exact, most = (1e-10, 2 * len(g) + 20) if self.p.loss == "squared" else (0.1, 12)  # only a quadratic is worth an exact step
        x, r = np.zeros(len(g)), -g
        z = precondition(r)
        p, rz, first = z, float(r @ z), float(r @ z)
        for _ in range(most):
            if rz <= exact**2 * first or rz <= 1e-300:
                break
            if not self.p.fit_intercept:
                p = np.append(p[:-1], 0.0)
            q = self._curved(rows, w, p)
            q[:-1] += penalty(p[:-1])
            size = rz / max(float(p @ q), 1e-300)
            x, r = x + size * p, r - size * q
            if not self.p.fit_intercept:
                r[-1] = 0.0
            z = precondition(r)
            p, rz = z + float(r @ z) / rz * p, float(r @ z)
        return x

    def _sums(self, rows, w, function, width: int) -> np.ndarray:
        """Sums over all rows of function(cells, shares, margins, targets, loss); a row a number on the driver."""
        shared = rows.sparkSession.sparkContext.broadcast((self.map_, w, LOSSES[self.p.loss]))

        def run(batches):
            m, w, loss = shared.value
            total = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    cell, share, below = m.cells(_width(m, batch_matrix(batch.column(0))))
                    margin = (w[cell] * share).sum(axis=1) + (w[cell - 1] * below).sum(axis=1) + w[-1]
                    total += function(cell, share, below, margin, batch.column(1).to_numpy(), loss)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["j", "s"])

        sums = rows.select("__x", "__y").mapInArrow(run, "j long, s double").groupBy("j").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(width)
        out[sums.column("j").to_numpy()] = sums.column("s").to_numpy()
        shared.unpersist()
        return out

    def _slope(self, rows, w):
        """Loss, its gradient, and the curvature's diagonal (intercept last) and first side diagonal."""
        n, name = self.map_.width, self.p.loss

        def function(cell, share, below, margin, y, loss):
            d, c = loss.dloss(margin, y), _curvature(name, margin, y)[:, None]
            add = lambda cells, v: np.bincount(cells.ravel(), weights=v.ravel(), minlength=n)[:n]
            g = add(cell, d[:, None] * share) + add(np.maximum(cell - 1, 0), d[:, None] * below)
            diagonal = add(cell, c * share**2) + add(np.maximum(cell - 1, 0), c * below**2)
            beside = add(np.maximum(cell - 1, 0), c * share * below)
            return np.concatenate([[loss.value(margin, y).sum()], g, [d.sum()], diagonal, [c.sum()], beside])

        flat = self._sums(rows, w, function, 3 * n + 3)
        return float(flat[0]), flat[1 : n + 2], flat[n + 2 : 2 * n + 3], flat[2 * n + 3 : 3 * n + 2]

    def _curved(self, rows, w, v):
        """The curvature of the loss times v."""
        n, name = self.map_.width, self.p.loss

        def function(cell, share, below, margin, y, loss):
            along = (v[cell] * share).sum(axis=1) + (v[cell - 1] * below).sum(axis=1) + v[-1]
            d = _curvature(name, margin, y) * along
            add = lambda cells, x: np.bincount(cells.ravel(), weights=x.ravel(), minlength=n)[:n]
            return np.append(add(cell, d[:, None] * share) + add(np.maximum(cell - 1, 0), d[:, None] * below), d.sum())

        return self._sums(rows, w, function, n + 1)


def _curvature(name: str, p, y):
    """A curvature of the loss that keeps Newton steps safe."""
    if name == "squared":
        return np.ones(len(y))
    return 2.0 * (p * y < 1) if name == "squared_hinge" else np.maximum(0.25 * np.exp(-np.abs(p) / 2), 1e-6)


def _tridiagonal(diagonal, beside):
    """A function that solves a symmetric tri-diagonal positive system, by elimination."""
    n = len(diagonal)
    lead, factor = diagonal.copy(), np.zeros(n)
    for i in range(1, n):
        factor[i] = beside[i - 1] / lead[i - 1]
        lead[i] -= factor[i] * beside[i - 1]

    def solve(r):
        x = r.copy()
        for i in range(1, n):
            x[i] -= factor[i] * x[i - 1]
        x[-1] /= lead[-1]
        for i in range(n - 2, -1, -1):
            x[i] = x[i] / lead[i] - factor[i + 1] * x[i + 1]
        return x

    return solve


class _Classifier:
    classifier = True
    losses = CLASSIFIER_LOSSES

    def predict_proba(self, df: DataFrame, features: str = "features", out: str = "probability") -> DataFrame:
        """df with the probability of the second class; for the logistic loss alone."""
        if self.p.loss not in ("logistic", "log"):
            raise ValueError("probabilities need the logistic loss")
        return self.decision_function(df, features, "__margin").withColumn(out, sigmoid_column(F.col("__margin"))).drop("__margin")


class SGDRegressor(_Linear):
    """Proximal SGD or averaged SGD."""


class SGDClassifier(_Classifier, _Linear):
    """Proximal SGD or averaged SGD."""


class AdaGradRegressor(_Linear):
    solver_class, defaults = AdaGrad, dict(eta0=0.1, average=0)


class AdaGradClassifier(_Classifier, _Linear):
    solver_class, defaults = AdaGrad, dict(eta0=0.1, average=0)


class AdamRegressor(_Linear):
    solver_class, defaults = Adam, dict(eta0=0.001, eps=1e-8, average=0)


class AdamClassifier(_Classifier, _Linear):
    solver_class, defaults = Adam, dict(eta0=0.001, eps=1e-8, average=0)


class SAGARegressor(_SAGA):
    pass


class SAGAClassifier(_Classifier, _SAGA):
    pass


class SDCARegressor(_SDCA):
    pass


class SDCAClassifier(_Classifier, _SDCA):
    pass


class DoublySGDRegressor(_Doubly):
    pass


class DoublySGDClassifier(_Classifier, _Doubly):
    pass


class SparseMBRegressor(_SparseMB):
    pass


class SparseMBClassifier(_Classifier, _SparseMB):
    losses = ("squared_hinge", "logistic")

"""Kernels by enumeration, maps by their kernels, solvers by invariants; signed data, absolute bounds."""

import itertools
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kestrel.functions import kernels, linalg, rng
from kestrel.functions.sparse import Csr, Postings
from kestrel.operators import gram, linear, lkrf, maps
from kestrel.operators.doubly import doubly
from kestrel.operators.losses import LOSSES
from kestrel.plans import catalogue
from kestrel.sources import features as feats

RNG = np.random.default_rng(0)
X = RNG.uniform(-1, 1, (60, 10))
X /= np.linalg.norm(X, axis=1, keepdims=True)
U = RNG.random((40, 10))


def frame(spark, x, y=None, parts=3):
    rows = [(i, [float(v) for v in r], float(y[i]) if y is not None else 0.0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, label double").repartition(parts)


# random numbers -------------------------------------------------------------------


def test_cells_do_not_depend_on_what_is_drawn_with_them():
    whole = rng.matrix(3, "w", 20, 6, "gaussian")
    assert np.array_equal(whole[7:9, 2:4], rng.matrix(3, "w", range(7, 9), range(2, 4), "gaussian"))


@pytest.mark.parametrize("dist", [d for d in rng.DISTRIBUTIONS])
def test_zero_mean_and_unit_variance(dist):
    w = rng.matrix(1, "t", 300, 60, dist, 0.6 if dist.startswith("sparse") else 0.0)
    assert abs(w.mean()) < 0.03 and abs(w.var() - 1) < 0.05


def test_samplers():
    assert (np.diff(rng.subsets(1, "s", 30, 9, 4)) > 0).all()
    assert sorted(rng.permutation(1, "p", 0, 33)) == list(range(33))
    drawn = rng.categorical(1, "c", 4000, [0], [1, 0, 3])[:, 0]
    assert abs((drawn == 2).mean() - 0.75) < 0.03 and not (drawn == 1).any()
    assert abs(rng.binomial(1, "b", 2000, [0], 10, 0.3).mean() - 3) < 0.15
    assert abs((rng.chi(1, "x", 400, 5) ** 2).mean() - 5) < 0.4
    for bad in (lambda: rng.matrix(1, "w", 2, 2, "no"), lambda: rng.categorical(1, "c", 1, [0], [0]), lambda: rng.subsets(1, "s", 2, 3, 4), lambda: rng.matrix(1, "w", 2, 2, "sparse_rademacher", 1.0)):
        with pytest.raises(ValueError):
            bad()
    assert rng.matrix(1, "w", 2, 3, lambda seed, stream, r, c: np.ones((r, c))).sum() == 6


# linear algebra -------------------------------------------------------------------


def test_hadamard_is_the_parity_matrix():
    h = np.array([[1 - 2 * ((r & c).bit_count() % 2) for c in range(16)] for r in range(16)])
    x = RNG.standard_normal((5, 16))
    assert np.allclose(linalg.fwht(x, False), x @ h) and np.allclose(linalg.fwht(linalg.fwht(x)), x)
    assert linalg.fwht(np.ones(5)).shape == (8,)


def test_next_power_of_two():
    assert [linalg.next_power_of_two(n) for n in (0, 1, 2, 3, 8, 9)] == [1, 1, 2, 4, 8, 16]
    with pytest.raises(ValueError):
        linalg.next_power_of_two(-1)
    with pytest.raises(TypeError):
        linalg.next_power_of_two(1.5)


def test_circulant_is_the_naive_matrix():
    w, x = RNG.standard_normal(7), RNG.standard_normal((4, 7))
    naive = np.array([[w[(r - c) % 7] for c in range(7)] for r in range(7)])
    assert np.allclose(linalg.circulant(x, w), x @ naive.T)


def test_simplex_projections_agree():
    for _ in range(200):
        v, z = RNG.standard_normal(int(RNG.integers(1, 30))), float(RNG.uniform(0.1, 3))
        p = linalg.project_simplex(v, z)
        assert abs(p.sum() - z) < 1e-9 and (p >= 0).all() and np.allclose(p, linalg.project_simplex_pivot(v, z))


# exact kernels --------------------------------------------------------------------


def brute_anova(x, p, m):
    return sum(math.prod(x[j] * p[j] for j in s) for s in itertools.combinations(range(len(x)), m))


@pytest.mark.parametrize("degree", [1, 2, 3, 4, 5])
def test_anova_by_enumeration(spark, degree):
    x, p = RNG.uniform(-1, 1, (6, 8)), RNG.uniform(-1, 1, (5, 8))
    want = np.array([[brute_anova(a, b, degree) for b in p] for a in x])
    assert np.allclose(kernels.anova_matrix(x, p, degree), want) and np.allclose(kernels.anova_by_features(x, p, degree), want)
    rows = [(a.tolist(), b.tolist(), float(w)) for a, ws in zip(x, want) for b, w in zip(p, ws)]
    df = spark.createDataFrame(rows, "x array<double>, p array<double>, w double")
    assert df.agg(F.max(F.abs(kernels.column("anova", F.col("x"), F.col("p"), degree=degree) - F.col("w")))).first()[0] < 1e-10


@pytest.mark.parametrize("name", kernels.NAMES)
def test_columns_match_matrices(spark, name):
    x = np.abs(X[:8]) if name in ("chi_square", "hellinger") else X[:8]
    k = kernels.matrix(name, x, x, degree=3, gamma=0.7, bias=0.2)
    rows = [(a.tolist(), b.tolist(), float(k[i, j])) for i, a in enumerate(x) for j, b in enumerate(x)]
    df = spark.createDataFrame(rows, "x array<double>, p array<double>, w double")
    e = kernels.column(name, F.col("x"), F.col("p"), degree=3, gamma=0.7, bias=0.2)
    assert df.agg(F.max(F.abs(e - F.col("w")))).first()[0] < 1e-10


def test_all_subsets_and_zero_chi_square():
    x, p = U[0][:5], U[1][:5]
    want = sum(math.prod(x[j] * p[j] for j in s) for m in range(6) for s in itertools.combinations(range(5), m))
    assert np.isclose(kernels.matrix("all-subsets", x[None], p[None])[0, 0], want)
    assert kernels.matrix("chi_square", np.zeros((1, 3)), np.zeros((1, 3)))[0, 0] == 0
    with pytest.raises(ValueError):
        kernels.matrix("pairwise", U[:1, :3], U[:1, :3])
    with pytest.raises(ValueError):
        kernels.matrix("nope", U, U)


def test_gram_alignment_and_error(spark):
    y = np.where(X[:, 0] > 0, 1.0, -1.0)
    df = frame(spark, X, y)
    k = {(r.i, r.j): r.k for r in gram.gram(df, df.where("id < 7"), "id", "rbf", gamma=0.5).collect()}
    exact = kernels.matrix("rbf", X, X, gamma=0.5)
    assert len(k) == 7 * 60 and all(abs(v - exact[a]) < 1e-12 for a, v in k.items())
    got = gram.kernel_alignment(df, "id", "features", "label", "rbf", gamma=0.5).first()[0]
    assert np.isclose(got, y @ exact @ y / (np.linalg.norm(exact) * 60))
    m = maps.RandomFourier(32, 0.5, seed=1).fit(10)
    z = m.apply(X)
    e = np.abs(exact - z @ z.T)[np.triu_indices(60)]
    for loss, v in (("l1", e), ("l2", e**2)):
        row = gram.approximation_error(m.transform(df), "id", "features", "z", "rbf", loss, gamma=0.5).first()
        assert np.allclose([row.mean_loss, row.total_loss, row.max_loss], [v.mean(), v.sum(), v.max()])
    with pytest.raises(ValueError):
        gram.approximation_error(df, "id", "features", "features", "rbf", "l3")


def test_sparse_gram(spark):
    x = np.where(RNG.random((12, 9)) < 0.3, RNG.standard_normal((12, 9)), 0)
    coo = feats.to_coo(frame(spark, x), "id")
    got = {(r.i, r.j): r.k for r in gram.sparse_gram(coo, coo, "id").collect()}
    want = x @ x.T
    assert all(abs(got.get((i, j), 0.0) - want[i, j]) < 1e-12 for i in range(12) for j in range(12))


# maps -----------------------------------------------------------------------------


def error(m, exact, x=X):
    z = m.fit(x.shape[1]).apply(x)
    assert z.shape == (len(x), m.width)
    d = z @ z.T - exact
    return np.abs(d).mean(), np.abs(d).max()


@pytest.mark.parametrize("offset", [False, True])
@pytest.mark.parametrize("kind", [maps.RandomFourier, maps.OrthogonalRandomFeature, maps.StructuredOrthogonalRandomFeature, maps.FastFood, maps.SignedCirculantRandomMatrix])
def test_rbf_maps(kind, offset):
    mean, most = error(kind(2048, gamma=0.8, use_offset=offset, seed=4), kernels.matrix("rbf", X, X, gamma=0.8))
    assert mean < 0.04 and most < 0.15


@pytest.mark.parametrize("kind", [maps.OrthogonalRandomFeature, maps.StructuredOrthogonalRandomFeature, maps.FastFood, maps.SignedCirculantRandomMatrix])
def test_dot_product_maps(kind):
    mean, most = error(kind(2048, random_fourier=False, seed=4), X @ X.T)
    assert mean < 0.04 and most < 0.25


@pytest.mark.parametrize("make", [
    lambda: maps.RandomProjection(3000, seed=2), lambda: maps.RandomProjection(3000, "sparse_rademacher", seed=2), lambda: maps.RandomProjection(3000, "gaussian", seed=2),
    lambda: maps.CountSketch(4000, 2), lambda: maps.SubsampledRandomHadamard(16, seed=2), lambda: maps.RandomKernel(3000, "dot", seed=2),
])
def test_linear_maps(make):
    mean, most = error(make(), X @ X.T)
    assert mean < 0.04 and most < 0.2


def correlation(m, exact, x=X):
    z = m.fit(x.shape[1]).apply(x)
    return np.corrcoef((z @ z.T).ravel(), exact.ravel())[0, 1]


@pytest.mark.parametrize("degree", [2, 3])
@pytest.mark.parametrize("make", [
    lambda d: maps.RandomKernel(6000, "anova", d, seed=5), lambda d: maps.RandomKernel(6000, "anova_cython", d, "laplace", seed=5),
    lambda d: maps.SubfeatureRandomKernel(12000, 6, degree=d, seed=5), lambda d: maps.SignedCirculantRandomKernel(6000, degree=d, seed=5),
])
def test_anova_maps(make, degree):
    assert correlation(make(degree), kernels.matrix("anova", X, X, degree=degree)) > 0.85


def test_all_subsets_map():
    assert correlation(maps.RandomKernel(8000, "all-subsets", seed=5), kernels.matrix("all_subsets", X, X)) > 0.95


@pytest.mark.parametrize("bias", [0.0, 0.3])
@pytest.mark.parametrize("h01", [False, True])
@pytest.mark.parametrize("sub", [False, True])
def test_polynomial_maclaurin(sub, h01, bias):
    kind = maps.SubfeatureRandomMaclaurin if sub else maps.RandomMaclaurin
    m = kind(12000, **({"n_sub_features": 6} if sub else {}), degree=2, bias=bias, h01=h01, p=2, seed=6)
    exact = kernels.matrix("poly", X, X, degree=2, bias=bias)
    mean, _ = error(m, exact)
    assert mean < 0.05 and correlation(m, exact) > 0.93


def test_exponential_maclaurin_and_own_coefficients():
    exact = kernels.matrix("exp", X, X, gamma=0.9)
    for m in (maps.RandomMaclaurin(12000, kernel="exp", gamma=0.9, p=2, seed=6), maps.RandomMaclaurin(12000, kernel="mine", coefs=[0.9**n / math.factorial(n) for n in range(12)], p=2, seed=6)):
        assert error(m, exact)[0] < 0.05
    with pytest.raises(ValueError):
        maps.RandomMaclaurin(5, kernel="mine")


@pytest.mark.parametrize("degree", [2, 3])
def test_tensor_sketch(degree):
    mean, _ = error(maps.TensorSketch(4096, degree, 3), kernels.matrix("poly", X, X, degree=degree))
    assert mean < 0.03


def test_compact_is_down_of_up():
    for down in (None, "srht"):
        m = maps.CompactRandomFeature(down=down, n_components=32, n_components_up=64, seed=2).fit(10)
        assert np.allclose(m.apply(X), m.down.apply(m.up.apply(X))) and m.width == 32


def test_intersection_codes():
    exact = kernels.matrix("intersection", U, U)
    assert error(maps.MB(2000), exact, U)[1] < 0.06
    mb, sparse = maps.MB(80).fit(10), maps.SparseMB(80).fit(10)
    w = RNG.standard_normal((10, 8))
    cells = np.cumsum(w, axis=1) / math.sqrt(8)  # a weight of a cell is the sum of the unary weights below
    assert np.allclose(mb.apply(U) @ w.ravel(), sparse.apply(U) @ cells.ravel())
    edge = np.array([[0.0, 1.0]])
    assert np.allclose(maps.SparseMB(8).fit(2).apply(edge), [[0, 0, 0, 0, 0, 0, 0, 1]])
    for bad in (lambda: maps.MB(3).fit(4), lambda: maps.MB(40).fit(10).apply(U + 1)):
        with pytest.raises(ValueError):
            bad()


def test_chi_square_maps():
    exact = kernels.matrix("chi_square", U, U)
    mean, _ = error(maps.AdditiveChi2Sampler(3), exact, U)
    assert mean < 0.04 * exact.mean()
    c = 0.5
    exact = np.exp(np.array([[0.5 * (np.log(2) * 2 + np.log(a + c) + np.log(b + c) - 2 * np.log(a + b + 2 * c)).sum() for b in U] for a in U]))
    assert error(maps.SkewedChi2Sampler(4000, c, 1), exact, U)[0] < 0.03
    with pytest.raises(ValueError):
        maps.AdditiveChi2Sampler(2).fit(10).apply(-U)
    with pytest.raises(ValueError):
        maps.AdditiveChi2Sampler(4)


def test_widths():
    assert maps.RandomFourier(8, use_offset=True).fit(3).width == 8
    with pytest.warns(UserWarning):
        assert maps.RandomFourier(9).fit(3).width == 8
    assert maps.OrthogonalRandomFeature(10).fit(4).width == 16
    assert maps.OrthogonalRandomFeature(10, use_offset=True).fit(4).width == 12
    assert maps.FastFood(10).fit(5).width == 16 and maps.StructuredOrthogonalRandomFeature(10, use_offset=True).fit(5).width == 16
    assert maps.MB(25).fit(4).width == 24
    with pytest.raises(ValueError):
        maps.SubsampledRandomHadamard(20).fit(10)
    with pytest.raises(ValueError):
        maps.RandomProjection(4, p_sparse=1)


def test_remove_bases_keeps_the_other_columns():
    for m in (maps.RandomFourier(12, use_offset=True, seed=1), maps.RandomKernel(12, seed=1), maps.RandomProjection(12, seed=1), maps.RandomMaclaurin(12, bias=0.5, seed=1), maps.RandomFourier(12, seed=1)):
        before = m.fit(10).apply(X)
        done = m.remove_bases([0, 5])
        after = m.apply(X)
        assert done == (type(m) is not maps.RandomFourier or m.use_offset)
        assert np.allclose(after, np.delete(before, [0, 5], axis=1) if done else before)


def test_transform_dense_sparse_and_batches_agree(spark):
    m = maps.TensorSketch(16, 2, 1).fit(10)
    df = frame(spark, X)
    dense = {r.id: r.z for r in m.transform(df).collect()}
    sparse = {r.id: r.z for r in m.transform(feats.to_sparse(df, "id")).collect()}
    z = m.apply(X)
    assert all(np.allclose(dense[i], z[i]) and np.allclose(sparse[i], z[i]) for i in range(60))
    assert m.transform(df.limit(0)).count() == 0


def test_bad_rows_fail(spark):
    m = maps.CountSketch(4).fit(2)
    for row in ([1.0, None], [1.0, float("nan")], [1.0], None, [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="features|fitted"):
            m.transform(spark.createDataFrame([(1, row)], "id long, features array<double>")).collect()
    with pytest.raises(Exception, match="finite"):
        feats.to_features(spark.createDataFrame([(1, None)], "id long, a double"), "id", ["a"]).collect()


# doubly stochastic ----------------------------------------------------------------


@pytest.mark.parametrize("source", [maps.RBFSampler(24, 0.5, 3), maps.SkewedChi2Sampler(24, 0.5, 3), maps.RandomMaclaurin(24, degree=3, bias=0.5, seed=3), maps.RandomKernel(24, seed=3)])
def test_regenerated_bases_are_the_stored_ones(source):
    base = doubly(source, 10)
    assert np.allclose(base.apply(U, 24, step=7), source.fit(10).apply(U))
    coef = RNG.standard_normal(24)
    assert np.allclose(base.predict(U, coef, step=5), base.block(U, 0, 24) @ coef)
    with pytest.raises(ValueError):
        doubly(maps.CountSketch(4), 3)


# learned weights ------------------------------------------------------------------


@pytest.mark.parametrize("divergence", list(lkrf.DIVERGENCES))
def test_learned_weights(spark, divergence):
    y = np.where(np.sin(4 * X[:, 0]) > 0, 1.0, -1.0)
    df = frame(spark, X, y)
    m = lkrf.LearnedKernel(maps.RandomFourier(48, 2.0, True, 3), divergence, rho=1.0 if divergence != "squared" else 0.01).fit_frame(df, y="label")
    inner = maps.RandomFourier(48, 2.0, True, 3).fit(10).apply(X)
    v = (y @ inner) ** 2
    assert np.allclose(m.statistic, v / v.max())
    assert (m.p >= -1e-9).all() and abs(m.p.sum() - 1) < 1e-6
    assert m.statistic @ m.p >= m.statistic.mean() - 1e-9
    before = m.apply(X)
    if m.remove_bases():
        assert m.width == (before != 0).any(axis=0).sum()
        assert np.allclose(m.apply(X), before[:, (before != 0).any(axis=0)])


def test_more_freedom_aligns_better(spark):
    df = frame(spark, X, np.where(X[:, 0] > 0, 1.0, -1.0))
    gains = []
    for rho in (0.01, 0.1, 1.0, 10.0):
        m = lkrf.LearnedKernel(maps.RandomFourier(32, 1.0, True, 3), "kl", rho=rho).fit_frame(df, y="label")
        assert m.divergence.value(m.p) <= rho + 1e-6
        gains.append(float(m.statistic @ m.p))
    assert gains == sorted(gains)
    with pytest.raises(ValueError):
        lkrf.LearnedKernel().fit_frame(frame(spark, X, np.arange(60)), y="label")


# losses and solvers ---------------------------------------------------------------


@pytest.mark.parametrize("name", ["squared", "logistic", "squared_hinge", "hinge"])
def test_losses(spark, name):
    loss = LOSSES[name]
    p, y = RNG.uniform(-3, 3, 50), np.where(RNG.random(50) < 0.5, 1.0, -1.0)
    h = 1e-6
    smooth = np.abs(p * y - 1) > 1e-3
    assert np.allclose(((loss.value(p + h, y) - loss.value(p - h, y)) / (2 * h))[smooth], loss.dloss(p, y)[smooth], atol=1e-4)
    g = loss.dloss(p, y)  # at the gradient the conjugate meets p g - L(p)
    keep = smooth & ((g != 0) | (name == "squared"))
    assert np.allclose(loss.conjugate(g, y)[keep], (p * g - loss.value(p, y))[keep], atol=1e-6)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist(), loss.value(p, y).tolist(), g.tolist())), "p double, y double, v double, g double")
    worst = df.agg(F.max(F.abs(loss.value_column(F.col("p"), F.col("y")) - F.col("v"))), F.max(F.abs(loss.dloss_column(F.col("p"), F.col("y")) - F.col("g")))).first()
    assert max(worst) < 1e-9


N = 160
XS = RNG.uniform(-1, 1, (N, 5))
MAP = lambda: maps.RandomFourier(24, 0.5, True, 9)
ZS = MAP().fit(5).apply(XS)
TARGET = ZS @ RNG.uniform(-1, 1, 24)
LABELS = np.where(TARGET > np.median(TARGET), 1.0, -1.0)
FAST = dict(alpha=1e-5, max_iter=12, tol=0.0)


@pytest.mark.parametrize("kind,extra", [
    (linear.SGDClassifier, dict(eta0=1.0, learning_rate="constant", average=0)), (linear.AdaGradClassifier, dict(eta0=1.0)), (linear.AdamClassifier, dict(eta0=0.2)),
    (linear.SAGAClassifier, dict(eta0=0.5, learning_rate="constant", max_iter=25)), (linear.SDCAClassifier, dict()),
])
@pytest.mark.parametrize("mode", ["sequential", "distributed"])
def test_classifiers_fit(spark, kind, extra, mode):
    df = frame(spark, XS, LABELS)
    model = kind(transformer=MAP(), loss="logistic" if kind is not linear.SDCAClassifier else "squared_hinge", mode=mode, **FAST | extra).fit(df)
    assert model.score(df) >= 0.9
    assert set(r.prediction for r in model.predict(df).select("prediction").distinct().collect()) <= {-1.0, 1.0}


@pytest.mark.parametrize("kind,extra", [(linear.SGDRegressor, dict(eta0=0.5, learning_rate="constant", average=0)), (linear.AdaGradRegressor, dict(eta0=1.0)), (linear.SAGARegressor, dict(eta0=0.3, learning_rate="constant")), (linear.SDCARegressor, dict())])
def test_regressors_fit(spark, kind, extra):
    df = frame(spark, XS, TARGET)
    assert kind(transformer=MAP(), mode="sequential", **FAST | extra | dict(max_iter=25)).fit(df).score(df) > 0.9


def test_penalties(spark):
    df = frame(spark, XS, LABELS)
    norms = [np.linalg.norm(linear.SGDClassifier(transformer=MAP(), mode="full_batch", alpha=a, eta0=0.5, average=0, max_iter=10, tol=0.0).fit(df).coef_) for a in (1e-4, 0.1, 1.0)]
    assert norms == sorted(norms, reverse=True)
    assert not linear.SGDClassifier(transformer=MAP(), mode="full_batch", alpha=100.0, l1_ratio=1.0, learning_rate="constant", average=0, max_iter=3).fit(df).coef_.any()


def test_sequential_order_and_partitions(spark):
    make = lambda: linear.SGDClassifier(transformer=MAP(), loss="logistic", mode="sequential", eta0=0.1, max_iter=2, tol=0.0)
    a, b = make().fit(frame(spark, XS, LABELS, 2)), make().fit(frame(spark, XS, LABELS, 7))
    assert np.allclose(a.coef_, b.coef_, atol=1e-9)
    sparse = feats.to_sparse(frame(spark, XS, LABELS), "id").join(frame(spark, XS, LABELS).select("id", "label"), "id")
    assert np.allclose(a.coef_, make().fit(sparse).coef_, atol=1e-9)


def test_warm_start_continues(spark):
    df = frame(spark, XS, LABELS)
    one = linear.AdamClassifier(transformer=MAP(), loss="logistic", mode="full_batch", max_iter=6, tol=0.0).fit(df)
    two = linear.AdamClassifier(transformer=MAP(), loss="logistic", mode="full_batch", max_iter=3, tol=0.0, warm_start=True)
    two.fit(df).fit(df)
    assert np.allclose(one.coef_, two.coef_) and one.t_ == two.t_ == 7


def test_doubly_sgd(spark):
    df = frame(spark, XS, LABELS)
    make = lambda mode: linear.DoublySGDClassifier(transformer=maps.RBFSampler(10, 0.5, 2), loss="logistic", mode=mode, batch_size=40, n_bases_sampled=16, eta0=1.0, max_iter=3, tol=0.0)
    model = make("sequential").fit(df)
    assert len(model.coef_) == 3 * 4 * 16 and model.score(df) > 0.7
    apart = make("distributed").fit(df.repartition(3))  # at least as many steps: a partition's last mini-batch may be a part of one
    assert len(apart.coef_) >= 3 * 4 * 16 and apart.score(df) > 0.7
    assert len(make("full_batch").fit(df).coef_) == 3 * 16
    a, b = (sorted((r.id, r.margin) for r in model.decision_function(df).select("id", "margin").collect()) for _ in range(2))
    assert a == b


def test_sparse_mb_estimators(spark):
    x = (XS + 1) / 2
    y = np.sin(4 * x[:, 0]) + x[:, 1] ** 2
    df = frame(spark, x, y)
    model = linear.SparseMBRegressor(n_components=60, alpha=1e-3, max_iter=10).fit(df)
    assert model.score(df) > 0.95
    labels = frame(spark, x, np.where(y > np.median(y), 1.0, -1.0))
    for loss in ("squared_hinge", "logistic"):
        assert linear.SparseMBClassifier(n_components=60, alpha=1e-2, loss=loss, max_iter=10).fit(labels).score(labels) > 0.9
    with pytest.raises(ValueError):
        linear.SparseMBClassifier(loss="hinge")


def test_normalised_features(spark):
    df = frame(spark, XS, LABELS)
    mean, std = linear.moments(df, MAP().fit(5), "features")
    assert np.allclose(mean, ZS.mean(axis=0)) and np.allclose(std, 1e-6 + ZS.std(axis=0, ddof=1))
    assert linear.SGDClassifier(transformer=MAP(), normalize=True, mode="full_batch", loss="logistic", eta0=1.0, learning_rate="constant", alpha=1e-5, average=0, max_iter=30, tol=0.0).fit(df).score(df) > 0.85


@pytest.mark.parametrize("bad", [dict(C=0), dict(alpha=-1), dict(loss="squared"), dict(l1_ratio=2), dict(eta0=0), dict(eps=0), dict(tol=-1), dict(mode="x"), dict(learning_rate="x"), dict(learning_rate="pegasos", alpha=0), dict(beta1=1.0)])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        linear.SGDClassifier(**bad)
    with pytest.raises(TypeError):
        linear.SGDClassifier(nothing=1)


def test_labels_are_checked(spark):
    with pytest.raises(TypeError):
        linear.SGDClassifier().fit(frame(spark, XS, np.arange(N)))
    with pytest.raises(ValueError):
        linear.SGDClassifier(loss="hinge").predict_proba(None)
    with pytest.raises(ValueError):
        linear.SDCAClassifier(alpha=0)


def test_model_round_trip(spark, tmp_path):
    from kestrel.sources.tables import load_weights, save_weights

    save_weights(spark, str(tmp_path / "m"), np.arange(3.0), 0.5, seed=4)
    coef, intercept, facts = load_weights(spark, str(tmp_path / "m"))
    assert coef.tolist() == [0, 1, 2] and intercept == 0.5 and facts == {"seed": 4}


# stored numbers of rows, sparse rows, grids ---------------------------------------


@pytest.mark.parametrize("kind,loss", [(linear.SAGAClassifier, "logistic"), (linear.SDCAClassifier, "squared_hinge")])
@pytest.mark.parametrize("mode", ["sequential", "distributed"])
def test_rows_keep_one_number_whatever_their_ids(spark, kind, loss, mode):
    data = [(None if i % 4 == 0 else i % 7, XS[i % 20].tolist(), float(LABELS[i % 20])) for i in range(60)]  # ids repeat, rows repeat
    df = spark.createDataFrame(data, "id long, features array<double>, label double")
    model = kind(transformer=MAP(), loss=loss, mode=mode, alpha=0.01, max_iter=4, tol=0.0, warm_start=True).fit(df)
    assert model.rows_.count() == 60
    before = sorted(r.m for r in model.rows_.collect())
    model.p.max_iter = 1
    model.fit(df.repartition(2))  # a warm start finds the numbers again
    after = sorted(r.m for r in model.rows_.collect())
    assert model.rows_.count() == 60 and np.abs(np.array(before) - after).max() < 0.5 and any(before)


def test_sequential_saga_against_a_loop(spark):
    z = np.concatenate([ZS, np.ones((N, 1))], axis=1)
    import hashlib

    w, mean, m, t = np.zeros(25), np.zeros(25), np.zeros(N), 1
    for e in range(3):
        for i in sorted(range(N), key=lambda i: (hashlib.md5(f"0|{e}|{i}".encode()).hexdigest(), i)):
            g = float(LOSSES["logistic"].dloss(z[i] @ w, LABELS[i]))
            eta = linear.learning_rate("optimal", t, 0.1, 0.01, 1.0)
            step = (g - m[i]) * z[i]
            w = w - eta * (step + mean + np.append(0.01 * w[:-1], 0.1 * w[-1]))
            mean, m[i], t = mean + step / N, g, t + 1
    model = linear.SAGAClassifier(transformer=MAP(), loss="logistic", mode="sequential", alpha=0.01, eta0=0.1, max_iter=3, tol=0.0).fit(frame(spark, XS, LABELS))
    assert np.allclose(np.append(model.coef_, model.intercept_), w)


@pytest.mark.parametrize("intercept", [True, False])
def test_grid_model_is_the_minimum(spark, intercept):
    x = (XS + 1) / 2
    y = np.sin(4 * x[:, 0]) + x[:, 1] ** 2
    model = linear.SparseMBRegressor(n_components=40, alpha=0.3, fit_intercept=intercept, max_iter=5).fit(frame(spark, x, y))
    z = np.concatenate([maps.SparseMB(40).fit(5).apply(x), np.ones((N, 1))], axis=1)
    h = (2 + model.p.eps) * np.eye(40) - np.eye(40, k=1) - np.eye(40, k=-1)
    h[0, 0] = h[-1, -1] = 1 + model.p.eps
    a = z.T @ z
    a[:40, :40] += 0.3 * h
    n = 41 if intercept else 40
    want = np.append(np.linalg.solve(a[:n, :n], (z.T @ y)[:n]), [] if intercept else [0.0])
    assert np.allclose(np.append(model.coef_, model.intercept_), want, atol=1e-5)


def test_sparse_rows_give_what_dense_rows_give(spark):
    x = np.where(RNG.random((40, 12)) < 0.6, 0.0, RNG.integers(-3, 4, (40, 12)).astype(float))
    x[3] = 0.0
    df = frame(spark, x)
    sparse = feats.to_sparse(df, "id")
    for m in (maps.RandomProjection(8), maps.RandomFourier(8, 0.5, True), maps.CountSketch(6), maps.TensorSketch(8, 2), maps.RandomKernel(8, distribution="sparse_rademacher", p_sparse=0.7), maps.RandomKernel(8, "anova_cython", 3), maps.SubfeatureRandomKernel(8, 5), maps.RandomMaclaurin(8, degree=3, bias=0.5, h01=True), maps.SubfeatureRandomMaclaurin(8, 4, degree=2), maps.FastFood(16)):
        m.fit(12)
        want = m.apply(x)
        dense = {r.id: r.z for r in m.transform(sparse).select("id", "z").collect()}
        out = {r.id: r.z for r in m.transform(sparse, dense_output=False).select("id", "z").collect()}
        for i in range(40):
            cells = np.zeros(m.width)
            cells[out[i]["indices"]] = out[i]["values"]
            assert np.allclose(dense[i], want[i]) and np.allclose(cells, want[i]) and out[i]["size"] == m.width and 0.0 not in out[i]["values"]
    one, two = (linear.SGDClassifier(transformer=maps.RandomFourier(8, 0.5, True), mode="full_batch", max_iter=3, average=0).fit(d.withColumn("label", (F.col("id") % 2).cast("double"))) for d in (df, sparse))
    assert np.allclose(one.coef_, two.coef_)


def test_a_million_features_stay_sparse():
    rng = np.random.default_rng(5)
    d, n = 1_000_000, 200
    indices = np.sort(rng.integers(0, d, (n, 30)), axis=1)
    x = Csr(np.arange(n + 1) * 30, indices.ravel(), rng.standard_normal(n * 30), d)
    w = Postings(np.repeat(np.arange(50), 40), np.concatenate([rng.choice(indices.ravel(), 50 * 20), rng.integers(0, d, 50 * 20)]), rng.standard_normal(2000), 50)
    rows, bases, values = w.anova(x, 2)
    assert len(rows) and (values != 0).all()
    for r, b, v in list(zip(rows, bases, values))[:20]:
        mine = dict(zip(x.indices[x.indptr[r] : x.indptr[r + 1]].tolist(), x.data[x.indptr[r] : x.indptr[r + 1]]))
        terms = [mine[j] * q for j, q in zip(w.features[w.bases == b].tolist(), w.values[w.bases == b]) if j in mine]
        assert np.isclose(v, (sum(terms) ** 2 - sum(t * t for t in terms)) / 2)


def test_sparse_rows_are_checked(spark):
    for cells in ((3, [0, 5], [1.0, 1.0]), (3, [0], [float("nan")]), (3, [0, 1], [1.0]), (3, [0], [None])):
        with pytest.raises(Exception, match="sparse|finite"):
            maps.CountSketch(4).fit(3).transform(spark.createDataFrame([(1, cells)], f"id long, features {feats.SPARSE}")).collect()


def test_divergences_against_closed_forms():
    rng = np.random.default_rng(6)
    for _ in range(20):
        v = rng.random(16) ** 3
        v /= v.max()
        for kind, want in ((lkrf.ReverseKL(), None), (lkrf.TV(), np.where(v == 1, 1 - (v >= 0.7).sum() / 16 + 1 / 16, np.where(v < 0.7, 0.0, 1 / 16)))):
            kind.options = {**lkrf.Divergence.options, "eps_abs": 1e-10, "eps_rel": 1e-10}
            p = kind.solve(v, 0.3)
            if want is None:  # p = (a / n) / (m - v), and the sum is one
                lo, hi = 1.0, 2.0
                for _ in range(60):
                    lo, hi = ((lo + hi) / 2, hi) if (0.3 / 16 / ((lo + hi) / 2 - v)).sum() > 1 else (lo, (lo + hi) / 2)
                want = 0.3 / 16 / (hi - v)
            assert np.allclose(p, want, atol=1e-6)


def test_libsvm_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("+1 1:0.5 3:2  # first\n\n-1\n-1 2:1e-3 4:-4\n")
    got = feats.read_libsvm(spark, str(tmp_path), 4).orderBy("id").collect()
    assert [(r.label, r.features["size"], r.features["indices"], r.features["values"]) for r in got] == [(1.0, 4, [0, 2], [0.5, 2.0]), (-1.0, 4, [], []), (-1.0, 4, [1, 3], [0.001, -4.0])]
    with pytest.raises(Exception, match="indices must be"):
        feats.read_libsvm(spark, str(tmp_path), 3).collect()
    fitted = linear.SGDClassifier(transformer=maps.RandomFourier(8, 0.5, True), mode="full_batch", max_iter=2).fit(feats.read_libsvm(spark, str(tmp_path), 4))
    assert len(fitted.coef_) == 8


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from kestrel.sources.tables import shared_path

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_path(bare, "x")


@pytest.mark.parametrize("kernel,params", [("linear", {}), ("poly", {"degree": 3, "bias": 0.5}), ("exp", {"gamma": 0.7}), ("rbf", {"gamma": 0.5}), ("all_subsets", {}), ("intersection", {}), ("chi-square", {}), ("hellinger", {})])
def test_narrow_gram_is_compiled(spark, kernel, params):
    """Rows of few features meet in compiled code on all cores, with the numbers of the matrix form."""
    rng_ = np.random.default_rng(3)
    x = np.abs(rng_.standard_normal((60, 4))) * (rng_.random((60, 4)) > 0.3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").coalesce(1)
    found = gram.gram(df, df.where("id % 20 = 0"), "id", kernel, **params)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "aggregate(" not in plan and "zip_with" not in plan
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {(r.i, r.j): r.k for r in found.collect()}
    want = kernels.matrix(kernel, x[::20], x, **params)
    assert len(got) == want.size
    assert all(np.isclose(got[20 * i, j], want[i, j], rtol=1e-12, atol=1e-12) for i in range(3) for j in range(60))


def test_narrow_gram_refuses_what_is_no_number(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, float("nan")])], "id long, features array<double>")
    with pytest.raises(Exception, match="finite"):
        gram.gram(df, df.where("id = 0"), "id", "linear").collect()
    df, empty = df.where("id = 0"), df.where("id > 5")
    assert gram.gram(df, empty, "id", "linear").count() == 0
    assert gram.gram(empty, df.where("id = 0"), "id", "linear").count() == 0


def test_pairs_are_rounded_as_by_spark(spark):
    """The quick rounding of rows a pair gives the very numbers of round()."""
    x = np.concatenate([np.random.default_rng(5).standard_normal(2000) * 10.0 ** np.arange(-8, 12).repeat(100), (np.arange(-500, 500) + 0.5) / 1e6, np.arange(-50, 50) * 1e-6, [0.0, -0.0, 1e13, -1e300, 1e-320, np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").select(catalogue._r(F.col("v")).alias("a"), catalogue._r_pair(F.col("v")).alias("b"))
    assert df.where("NOT (a <=> b)").count() == 0


@pytest.mark.parametrize("query", ["kernel_chi2", "kernel_intersection", "kernel_anova4_native"])
def test_many_pairs_leave_the_column_form(spark, query, monkeypatch):
    """Higher-order functions over arrays are not compiled; beyond COLUMN_PAIRS pairs the query does without, with equal results."""
    sf = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, catalogue.QUERIES[query](spark, sf).collect()))
    want = rows()
    monkeypatch.setattr(gram, "COLUMN_PAIRS", 10)
    assert "zip_with" not in catalogue.QUERIES[query](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert rows() == want


@pytest.mark.parametrize("degree,most", [(1, 4096), (2, 4096), (3, 4096), (2, 5)])
def test_sparse_totals_are_summed_in_the_task(spark, degree, most, monkeypatch):
    """A row a query, summed before it leaves the task; the pairs are those of the Gram operator."""
    monkeypatch.setattr(gram, "SUMMED_FEATURES", most)
    monkeypatch.setattr(gram, "SUMMED_BLOCK", 16)
    rng_ = np.random.default_rng(4)
    x = np.where(rng_.random((70, 12)) < 0.2, rng_.integers(-3, 4, (70, 12)), 0).astype(float)
    df = feats.to_sparse(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>"), "id")
    q = df.where("id % 7 = 0")
    want = gram.sparse_anova_gram(df, q, "id", degree).groupBy("i").agg(F.count("*").alias("n_rows"), F.sum("k").alias("total"))
    got = gram.sparse_anova_totals(df, q, "id", degree)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("query", ["kernel_sparse_linear", "kernel_anova_sparse"])
def test_sparse_queries_split_words_once(spark, query, monkeypatch):
    """No row a pair is made, and the texts are read once."""
    made = []
    totals = gram.sparse_anova_totals
    monkeypatch.setattr(gram, "sparse_anova_totals", lambda rows, *a: made.append(rows) or totals(rows, *a))
    catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert made and "documents.parquet" not in made[0]._jdf.queryExecution().executedPlan().toString()


def test_narrow_intersection_rounds_its_ties_by_the_exact_sum(spark):
    """The form without branches gives, rounded, what the exact kernel gives, ties of the seventh digit and large numbers included."""
    rng_ = np.random.default_rng(4)
    cells = np.concatenate([rng_.integers(0, 2001, (60, 4)) * 5e-7, rng_.random((40, 4)), np.full((1, 4), 1e9 + 0.1), np.zeros((1, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(cells)], "id long, features array<double>").cache()
    found = gram.gram(df, df, "id", "intersection", to_six=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan.split("Join Cross")[0]
    assert "abs((q0" in pairs and "least(" not in plan
    a, b = df.select(F.col("id").alias("i"), F.col("features").alias("p")), df.select(F.col("id").alias("j"), F.col("features").alias("x"))
    want = a.crossJoin(b).select("i", "j", F.round(kernels.column("intersection", F.col("p"), F.col("x")), 6).alias("k"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_anova_matrix_works_in_tiles():
    """Besides the result and powers of the rows it holds sums of a few rows alone, whatever the block."""
    import tracemalloc

    rng_ = np.random.default_rng(5)
    x, p = rng_.standard_normal((5 * 64 + 7, 6)), rng_.standard_normal((500, 6))
    for degree in (1, 2, 3, 4, 5):
        tracemalloc.start()
        got = kernels.anova_matrix(x, p, degree)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(got, kernels.anova_by_features(x, p, degree), atol=1e-9)
        assert degree < 4 or peak < 6 * got.nbytes


def test_anova_matrix_takes_compressed_rows():
    """Compressed rows, more than a tile of them and rows without non-zeros included, give what the same rows as a matrix give."""
    rng_ = np.random.default_rng(8)
    x, p = np.where(rng_.random((2 * kernels.TILE + 5, 12)) < 0.6, 0.0, rng_.standard_normal((2 * kernels.TILE + 5, 12))), rng_.standard_normal((9, 12))
    x[3] = x[kernels.TILE] = 0.0
    rows, cols = np.nonzero(x)
    sparse = Csr(np.concatenate([[0], np.cumsum((x != 0).sum(1))]), cols, x[rows, cols], 12)
    assert np.array_equal(sparse[60:70].toarray(), x[60:70]) and sparse[5:5].shape == (0, 12)
    for degree in (1, 2, 3, 4):
        assert np.allclose(kernels.anova_matrix(sparse, p, degree), kernels.anova_by_features(x, p, degree), atol=1e-9)


def test_pairs_need_decimals_next_to_ties_alone(spark, monkeypatch):
    """Of rows a pair only those within the error of a double of a tie go the slow way, and all are rounded as by round()."""
    rng_ = np.random.default_rng(6)
    ties = (np.unique(rng_.integers(0, 10.0 ** np.arange(1, 15).repeat(200))) + 0.5) / 1e6
    beside = np.concatenate([f for d in (np.inf, -np.inf) for f in (np.nextafter(ties, d), np.nextafter(np.nextafter(ties, d), d))])
    plain = rng_.random(20000) * 16
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    every = np.concatenate([ties, beside, (np.arange(2000) + 0.4995) / 1e6, (np.arange(2000) + 0.5005) / 1e6, plain])
    every = frame(np.concatenate([every, -every])).select(catalogue._r(F.col("v")).alias("a"), kernels.rounded(F.col("v")).alias("b"))
    assert every.where("NOT (a <=> b)").count() == 0
    with monkeypatch.context() as m:
        m.setattr(kernels.F, "round", lambda c, digits: F.lit(-1.0))
        slow = lambda x: frame(x).select(kernels.rounded(F.col("v")).alias("b")).where("b = -1").count()
        assert slow(plain) == 0 and slow(ties) == len(ties)


@pytest.mark.parametrize("kernel", ["hellinger", "all_subsets", "intersection"])
def test_narrow_pairs_are_not_copied(spark, kernel, monkeypatch):
    """Pairs are looked up by number, without a join that copies each; all are there, of repeated and null ids too, as from the nested loop of many rows."""
    x = np.random.default_rng(7).random((130, 4))
    df = spark.createDataFrame([(None if i % 50 == 3 else i // 2, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(7)
    q = df.where("id IS NULL OR id % 5 = 0").coalesce(3)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    rows = lambda f: sorted(map(str, f.collect()))
    found = gram.gram(df, q, "id", kernel, to_six=True)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    a, b = q.select(F.col("id").alias("i"), F.col("features").alias("p")), df.select(F.col("id").alias("j"), F.col("features").alias("x"))
    want = a.crossJoin(b).select("i", "j", F.round(kernels.column(kernel, F.col("p"), F.col("x")), 6).alias("k"))
    assert found.count() == q.count() * 130 and rows(found) == rows(want)
    monkeypatch.setattr(gram, "BROADCAST_BYTES", 129 * 5 * 8)
    many = gram.gram(df, q, "id", kernel, to_six=True)
    assert "NestedLoop" in plan(many) and rows(many) == rows(want)


@pytest.mark.parametrize("kernel", ["all_subsets", "chi_square", "intersection", "hellinger"])
def test_numbered_pairs_come_in_strips_of_queries(spark, kernel, monkeypatch):
    """Rows a pair leave in strips of a few queries, so that written ids repeat nearby; all pairs are there, of a last, narrower strip too."""
    monkeypatch.setattr(gram, "STRIP", 8, raising=False)
    x = np.random.default_rng(9).random((60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    for n in (3, 32, 37):
        found = gram.gram(df, df.where(f"id < {n}"), "id", kernel, to_six=True).collect()
        want = np.round(kernels.matrix(kernel, x[:n], x), 6)
        assert sorted((r.i, r.j) for r in found) == [(i, j) for i in range(n) for j in range(60)]
        assert all(abs(r.k - want[r.i, r.j]) <= 1.01e-6 for r in found)
        assert all(len({r.i for r in found[lo : lo + 32]}) <= 16 for lo in range(len(found)))


@pytest.mark.parametrize("kernel", ["intersection", "chi_square", "hellinger"])
def test_numbered_pairs_meet_alike_rows_in_turn(spark, kernel, monkeypatch):
    """Rows and queries are numbered by their features, not by ids; a task has a limited number of pairs; none is lost or doubled."""
    monkeypatch.setattr(gram, "STRIP", 8)
    monkeypatch.setattr(gram, "TASK_PAIRS", 50, raising=False)
    rng_ = np.random.default_rng(10)
    x = rng_.integers(0, 4, (60, 3)) / 4.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(5)
    found = gram.gram(df, df.where("id % 3 = 0"), "id", kernel, to_six=True)
    assert found.rdd.getNumPartitions() >= 60 * 20 / 50
    got, want = found.collect(), kernels.matrix(kernel, x, x)
    assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(0, 60, 3) for j in range(60)]
    assert all(abs(r.k - want[r.i, r.j]) <= 5.1e-7 for r in got)
    for lo, width in ((0, 8), (8 * 60, 8), (16 * 60, 4)):
        strip = got[lo : lo + width * 60]
        rows, queries = [tuple(x[r.j]) for r in strip[::width]], [tuple(x[r.i]) for r in strip[:width]]
        assert rows == sorted(rows) and len(rows) == 60 and queries == sorted(queries)


def test_written_intersections_repeat_nearby(spark, tmp_path):
    """Copies of rows but for one number, as of a table grown with new keys: their equal kernels lie side by side in the written files."""
    base = np.random.default_rng(11).random((50, 3))
    cells = [(i, [*base[i % 50].tolist(), i * 18 % 97 / 97]) for i in range(3000)]
    df = spark.createDataFrame(cells, "id long, features array<double>")
    gram.gram(df, df.where("id % 10 = 0"), "id", "intersection", to_six=True).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 900_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * 900_000


@pytest.mark.parametrize("kernel", ["chi_square", "hellinger"])
def test_copies_of_bases_meet_base_by_base(spark, kernel, monkeypatch, tmp_path):
    """Rows alike but for one feature, as of a table grown with new keys: a query meets all copies of a row in turn; all pairs are there, of repeated and null ids too."""
    for name, value in (("COPIED_PAIRS", 1), ("COPIES", 16), ("BASE_TASK_PAIRS", 20_000)):
        monkeypatch.setattr(gram, name, value, raising=False)
    base = np.random.default_rng(12).random((20, 3))
    cells = [(None if i % 350 == 7 else i % 590, [*base[i % 20, :2].tolist(), i * 18 % 97 / 97, float(base[i % 20, 2])]) for i in range(600)]
    df = spark.createDataFrame([*cells, (601, [0.0] * 4), (602, [-0.0, 0.0, 0.5, 0.0])], "id long, features array<double>").repartition(5).cache()
    q = df.where("id IS NULL OR id % 4 = 0").cache()
    gram.gram(df, q, "id", kernel, to_six=True).write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    a, b = q.select(F.col("id").alias("i"), F.col("features").alias("p")), df.select(F.col("id").alias("j"), F.col("features").alias("x"))
    want = a.crossJoin(b).select("i", "j", F.round(kernels.column(kernel, F.col("p"), F.col("x")), 6).alias("k"))
    assert found.count() == q.count() * 602 and found.exceptAll(want).count() == 0
    turns = files = 0
    for path in (tmp_path / "out").glob("*.parquet"):
        i = np.array([-1 if v is None else v for v in pq.read_table(path)["i"].to_pylist()])
        turns, files = turns + 1 + np.count_nonzero(np.diff(i)), files + 1
    assert turns <= q.count() * 22 + files and files >= q.count() * 602 / 20_000


def test_copies_of_one_large_base_are_numbered_pairs(spark, monkeypatch):
    """Where one pair of bases would be more than a task's work, pairs are dealt by their numbers, and all are there."""
    for name, value in (("COPIED_PAIRS", 1), ("COPIES", 16), ("TASK_PAIRS", 1000)):
        monkeypatch.setattr(gram, name, value, raising=False)
    df = spark.createDataFrame([(i, [0.25, 0.5 if i < 190 else i / 200, i * 18 % 97 / 97]) for i in range(200)], "id long, features array<double>")
    found = gram.gram(df, df.where("id % 4 = 0"), "id", "hellinger", to_six=True)
    assert "x_copies" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.i, r.j) for r in found.collect()) == [(i, j) for i in range(0, 200, 4) for j in range(200)]

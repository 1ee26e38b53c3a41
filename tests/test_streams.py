"""Streams give what batches give, restarts included."""

import numpy as np

from kestrel.operators import linear, maps
from kestrel.streaming import streams

RNG = np.random.default_rng(1)
X = RNG.uniform(-1, 1, (90, 4))
Y = np.where(X[:, 0] * X[:, 1] > 0, 1.0, -1.0)


def rows(spark, lo, hi):
    data = [(i, X[i].tolist(), float(Y[i])) for i in range(lo, hi)]
    return spark.createDataFrame(data, "id long, features array<double>, label double").coalesce(1)


def make():
    return linear.AdamClassifier(transformer=maps.RandomFourier(16, 1.0, True, 2), loss="logistic", mode="full_batch", eta0=0.2, max_iter=3, tol=0.0, warm_start=True)


def test_mapped_stream_is_the_mapped_table(spark, tmp_path):
    m = maps.FastFood(16, seed=1).fit(4)
    for k in range(3):
        rows(spark, 30 * k, 30 * k + 30).write.mode("append").parquet(f"{tmp_path}/in")
    streams.run_to_table(streams.transform_stream(streams.file_stream(spark, f"{tmp_path}/in"), m), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.id: r.z for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 90 and all(np.allclose(got[i], z) for i, z in enumerate(m.apply(X)))


def test_fit_continues_after_a_restart(spark, tmp_path):
    want = make()
    for k in range(3):
        want.fit(rows(spark, 30 * k, 30 * k + 30))
    rows(spark, 0, 30).write.parquet(f"{tmp_path}/in")
    first = streams.fit_stream(streams.file_stream(spark, f"{tmp_path}/in"), make(), f"{tmp_path}/check")
    for k in (1, 2):
        rows(spark, 30 * k, 30 * k + 30).write.mode("append").parquet(f"{tmp_path}/in")
        second = streams.fit_stream(streams.file_stream(spark, f"{tmp_path}/in"), make(), f"{tmp_path}/check")
    assert first.t_ == 4 and second.t_ == want.t_ == 10 and np.allclose(second.coef_, want.coef_)
    again = streams.fit_stream(streams.file_stream(spark, f"{tmp_path}/in"), make(), f"{tmp_path}/check")
    assert np.allclose(again.coef_, want.coef_) and again.t_ == 10

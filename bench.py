"""Headline queries timed at one scale; prints one JSON line.

Times are of a full write to the no-op sink, the best of two runs after a small
warm-up; ``rates`` has rows a second of the transforms over wide vectors.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(run) -> float:
    began = time.time()
    out = run()
    if hasattr(out, "write"):
        out.write.format("noop").mode("overwrite").save()
    return time.time() - began


def transforms() -> dict[str, float]:
    """Microseconds a row of the Walsh-Hadamard transform itself, on one core without Spark."""
    import numpy as np

    from kestrel.functions.linalg import fwht

    out = {}
    for bits, rows in ((10, 4096), (20, 8)):
        x = np.random.default_rng(1).standard_normal((rows, 1 << bits))
        out[f"hadamard_2^{bits}"] = round(min(timed(lambda x=x: fwht(x) is None) for _ in range(3)) / rows * 1e6, 2)
    return out


def main() -> None:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "/tmp/kestrel-bench")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kestrel.operators import linear, maps
    from kestrel.plans import catalogue as c

    emb = c.emb(spark, SF_DIR).repartition(int(CPUS)).cache()
    lines = c.lines4(spark, SF_DIR)
    n_emb, n_lines = emb.count(), lines.count()
    wide = spark.range(1 << 14).select("id", F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda j: F.sin(F.col("id") * 0.37 + j * 0.11)).alias("features")).repartition(int(CPUS))

    def norm(m, df):
        """Mapped rows used in full, one number a row leaving the task."""
        return maps.map_batches(df, "features", "s", m, lambda k, x: (k.apply(x) ** 2).sum(axis=1), maps.DoubleType()).select("id", "s")

    train = lines.select("id", "features", F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("label"))
    # fitted beforehand: a fit draws a model of fixed size, a transform is what grows with the rows
    offset = dict(use_offset=True, seed=1)
    on64 = {k: m.fit(64) for k, m in {
        "fourier_emb_1024": maps.RandomFourier(1024, 0.5, True, 1), "fastfood_emb_1024": maps.FastFood(1024, 0.5, **offset),
        "structured_orthogonal_emb_1024": maps.StructuredOrthogonalRandomFeature(1024, 0.5, **offset),
        "circulant_emb_1024": maps.SignedCirculantRandomMatrix(1024, 0.5, **offset), "tensor_sketch_emb_1024": maps.TensorSketch(1024, 2, 1),
    }.items()}
    widths = (256, 1024, 4096)
    shapes = {"fourier": lambda: maps.RandomFourier(8192, 0.001, True, 1), "fastfood": lambda: maps.FastFood(8192, 0.001, **offset), "structured": lambda: maps.StructuredOrthogonalRandomFeature(8192, 0.001, **offset), "circulant": lambda: maps.SignedCirculantRandomMatrix(8192, 0.001, **offset)}
    on_wide = {f"{k}_wide_d{d}_8192": (make().fit(d), d) for k, make in shapes.items() for d in widths}
    cut = {d: wide.select("id", F.slice("features", 1, d).alias("features")).cache() for d in widths}
    for df in cut.values():
        df.count()
    wide = cut[1024]
    lines = lines.cache()
    lines.count()
    on4, had = maps.RandomFourier(256, 0.5, True, 1).fit(4), c._Hadamard(1024).fit(1024)
    queries = {k: (lambda m=m: m.transform(emb)) for k, m in on64.items()}
    queries |= {k: (lambda m=m, d=d: norm(m, cut[d])) for k, (m, d) in on_wide.items()}
    queries |= {
        "fourier_lineitem_256": lambda: norm(on4, lines),
        "hadamard_wide_d1024": lambda: maps.map_batches(wide, "features", "s", had, lambda k, x: k.apply(x).sum(axis=1), maps.DoubleType()).select("id", "s"),
        "gram_rbf": lambda: c.QUERIES["kernel_rbf"](spark, SF_DIR),
        "approximation_error": lambda: c.QUERIES["rbf_approximation_error"](spark, SF_DIR),
        "learned_weights_kl": lambda: c.QUERIES["lkrf_kl"](spark, SF_DIR),
        "mb_native": lambda: c.QUERIES["map_mb_native"](spark, SF_DIR),
        "full_batch_epoch_lineitem_256": lambda: linear.SGDClassifier(transformer=maps.RandomFourier(256, 0.5, True, 1), mode="full_batch", loss="logistic", max_iter=1, average=0).fit(train) and None,
        "distributed_epoch_lineitem_256": lambda: linear.SGDClassifier(transformer=maps.RandomFourier(256, 0.5, True, 1), loss="logistic", max_iter=1, average=0).fit(train) and None,
        "saga_epoch_lineitem_256": lambda: linear.SAGAClassifier(transformer=maps.RandomFourier(256, 0.5, True, 1), loss="logistic", max_iter=1).fit(train) and None,
        "predict_lineitem_256": lambda: c.QUERIES["lineitem_fourier_margin"](spark, SF_DIR),
    }
    try:
        from kestrel.llm.registry import QUERIES as corpus

        queries |= {k: (lambda f=f: f(spark, SF_DIR)) for k, f in corpus.items()}
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("kestrel.llm"):
            raise
    seconds = {}
    for name, run in queries.items():
        seconds[name] = round(min(timed(run) for _ in range(2)), 3)
    rows = {"emb": n_emb, "lineitem": n_lines, "wide": 1 << 14}
    rates = {k: round(n / seconds[q]) for k, q, n in (("fourier_lineitem_256", "fourier_lineitem_256", n_lines), ("hadamard_wide_d1024", "hadamard_wide_d1024", 1 << 14), ("fastfood_wide_d1024_8192", "fastfood_wide_d1024_8192", 1 << 14))}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS), "rows": rows, "rows_per_second": rates, "microseconds_a_row_and_core": transforms()}))
    spark.stop()


if __name__ == "__main__":
    main()

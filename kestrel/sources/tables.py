"""Tables and models on disk: readers, writers, materialised intermediate results."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where a small file gives fewer splits than there are cores; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the cluster's shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, in one of our own, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kestrel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kestrel/{label}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_weights(spark: SparkSession, path: str, coef: np.ndarray, intercept: float, **facts) -> None:
    """Store a linear model as a one-row Parquet table."""
    row = [(coef.tolist(), float(intercept), json.dumps(facts, sort_keys=True))]
    spark.createDataFrame(row, "coef array<double>, intercept double, facts string").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> tuple[np.ndarray, float, dict]:
    row = spark.read.parquet(path).first()
    return np.array(row.coef), row.intercept, json.loads(row.facts)

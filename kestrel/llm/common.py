"""Shared helpers: the cluster's shared folder, materialised tables, worker caches."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of few rows and bytes keep very long texts from meeting in one batch.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Rows up to which a table of one number a row is broadcast, about 16 MB.
SMALL = 1 << 18


def tune(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset one of our own, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kestrel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/kestrel/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that open scopes have written, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Delete what is materialised inside, once it ends, but tables of the labels that a lazy result still reads."""
    _scopes.append([])
    try:
        yield
    finally:
        made = _scopes.pop()
        kept = [p for p in made if p.rpartition("/")[2].rpartition("-")[0] in keep]
        if _scopes:
            _scopes[-1].extend(kept)
        for path in set(made) - set(kept):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame) -> DataFrame:
    """A written table of one number a row: to be broadcast if its counted rows are at most SMALL, else dealt by key."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("shuffle_hash")


def worker_cache(key, make):
    """A value made once for each Python worker process, whatever task asks for it."""
    module = sys.modules.setdefault("_kestrel_worker_cache", types.ModuleType("_kestrel_worker_cache"))
    cache = module.__dict__.setdefault("values", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]


def table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A table; ``dealt`` over all cores where a small file gives fewer splits than there are cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if dealt and rows.rdd.getNumPartitions() < cores else rows


def lower_ascii(col):
    """Lower-case A-Z alone; the quick way for texts that are all ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, lower))


def drop_intermediates(spark: SparkSession) -> bool:
    """Delete all intermediate tables in the shared folder, once no result built on them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/kestrel")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Feature frames: (id, features) rows, sparse structs, coordinate form, validation.

Frames have no row order, so every one carries an id column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.sparse import Csr

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"


def to_features(df: DataFrame, id_col: str, cols: list[str], out: str = "features") -> DataFrame:
    """(id, features) from numeric columns; a null in any of them fails the query."""
    return checked(df.select(F.col(id_col), F.array(*(F.col(c).cast("double") for c in cols)).alias(out)), out, len(cols))


def from_array(df: DataFrame, id_col: str, col: str, out: str = "features") -> DataFrame:
    """(id, features) from an array column of any numeric type."""
    return df.select(F.col(id_col), F.col(col).cast("array<double>").alias(out))


def read_libsvm(spark: SparkSession, path: str, width: int, id_col: str = "id") -> DataFrame:
    """(id, label, features) from text lines ``label index:value ...`` with indices from 1, as sparse structs.

    Ids number the lines apart, without meaning beyond that; blank lines and what
    follows a # are left out; a line that does not parse, or an index beyond the
    width, fails the query.
    """
    line = F.btrim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(F.col("line"), r"\s+")
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, ":"))
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias(id_col), line.alias("line")).where("line <> ''")
    rows = rows.select(id_col, F.element_at(parts, 1).cast("double").alias("label"), pairs.alias("pairs"))
    indices = F.transform("pairs", lambda p: F.element_at(p, 1).cast("int") - 1)
    values = F.transform("pairs", lambda p: F.element_at(p, 2).cast("double"))
    bad = F.exists("pairs", lambda p: ~F.element_at(p, 1).cast("int").between(1, width))
    cells = F.when(~bad, F.struct(F.lit(width).alias("size"), indices.alias("indices"), values.alias("values")).cast(SPARSE))
    message = F.lit(f"indices must be from 1 to {width}")
    return rows.select(id_col, "label", F.coalesce(cells, F.raise_error(message).cast(SPARSE)).alias("features"))


def valid(features: Column, width: int | None = None) -> Column:
    """Whether a features array is finite, without nulls and of the width."""
    bad = F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return features.isNotNull() & ~bad & (F.size(features) == width if width is not None else F.lit(True))


def checked(df: DataFrame, col: str = "features", width: int | None = None) -> DataFrame:
    """df, failing at run time on a row whose features are not valid."""
    message = f"{col} must be finite numbers" + (f", {width} of them" if width is not None else "")
    return df.withColumn(col, F.when(valid(F.col(col), width), F.col(col)).otherwise(F.raise_error(F.lit(message)).cast("array<double>")))


def width_of(df: DataFrame, col: str = "features") -> int:
    """Number of features, from the first row; an empty frame has none to learn from."""
    first = df.select(col).first()
    if first is None or first[0] is None:
        raise ValueError("a first row with features is needed")
    return first[0]["size"] if dict(df.dtypes)[col].startswith("struct") else len(first[0])


def row(df: DataFrame, id_col: str, value) -> DataFrame:
    return df.where(F.col(id_col) == value)


def feature(df: DataFrame, id_col: str, j: int, col: str = "features") -> DataFrame:
    return df.select(id_col, F.element_at(col, j + 1).alias("value"))


def to_coo(df: DataFrame, id_col: str, col: str = "features") -> DataFrame:
    """(id, j, v) rows of the non-zero entries of dense arrays or sparse structs."""
    if dict(df.dtypes)[col].startswith("struct"):
        pairs = df.select(id_col, F.explode(F.arrays_zip(F.col(f"{col}.indices").alias("j"), F.col(f"{col}.values").alias("v"))).alias("e"))
        return pairs.select(id_col, F.col("e.j").alias("j"), F.col("e.v").alias("v")).where("v <> 0")
    return df.select(id_col, F.posexplode(col).alias("j", "v")).where("v <> 0")


def to_sparse(df: DataFrame, id_col: str, col: str = "features", out: str = "features") -> DataFrame:
    """Dense arrays as sparse structs."""
    pairs = F.filter(F.transform(F.col(col), lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda e: e["v"] != 0)
    return df.select(id_col, F.struct(F.size(col).alias("size"), F.transform(pairs, lambda e: e["j"]).alias("indices"), F.transform(pairs, lambda e: e["v"]).alias("values")).cast(SPARSE).alias(out))


def to_dense(df: DataFrame, id_col: str, col: str = "features", out: str = "features") -> DataFrame:
    """Sparse structs as dense arrays."""
    s = F.col(col)
    entries = F.map_from_arrays(s["indices"], s["values"])
    cells = F.transform(F.sequence(F.lit(0), s["size"] - 1), lambda j: F.coalesce(F.try_element_at(entries, j), F.lit(0.0)))
    return df.select(id_col, F.when(s["size"] > 0, cells).otherwise(F.array().cast("array<double>")).alias(out))


def from_coo(df: DataFrame, id_col: str, width: int, out: str = "features") -> DataFrame:
    """Sparse structs from (id, j, v) rows, one an id, features in order."""
    cells = F.sort_array(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))))
    rows = df.groupBy(id_col).agg(cells.alias("__c"))
    return rows.select(id_col, F.struct(F.lit(width).alias("size"), F.col("__c.j").alias("indices"), F.col("__c.v").alias("values")).cast(SPARSE).alias(out))


def batch_rows(column: pa.Array) -> Csr | np.ndarray:
    """A sparse struct column as compressed rows, any other as a matrix."""
    if not pa.types.is_struct(column.type):
        return batch_matrix(column)
    size, indices, values = (column.field(k) for k in ("size", "indices", "values"))
    if column.null_count or size.null_count or indices.null_count or values.null_count:
        raise ValueError("features must not be null")
    sizes = size.to_numpy()
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("features must have one width")
    many = pa.compute.list_value_length(indices).to_numpy()
    j, v = indices.flatten(), values.flatten()
    if j.null_count or v.null_count or (pa.compute.list_value_length(values).to_numpy() != many).any():
        raise ValueError("sparse features need a number for every index")
    x = Csr(np.concatenate([[0], np.cumsum(many)]), j.to_numpy(), v.to_numpy().astype(float, copy=False), int(sizes[0]) if len(sizes) else 0)
    if not np.isfinite(x.data).all():
        raise ValueError("features must be finite numbers")
    if len(x.indices) and (x.indices.min() < 0 or x.indices.max() >= x.d):
        raise ValueError("sparse features must lie within their width")
    return x


def batch_matrix(column: pa.Array) -> np.ndarray:
    """A list column of one width, or a sparse struct column, as a matrix."""
    if pa.types.is_struct(column.type):
        return batch_rows(column).toarray()
    n = len(column)
    if column.null_count:
        raise ValueError("features must not be null")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("features must be finite numbers")
    x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    if n and (len(x) % n or (np.diff(column.offsets.to_numpy()) != len(x) // n).any()):
        raise ValueError("features must have one width")
    x = x.reshape(n, -1) if n else np.zeros((0, 0))
    if not np.isfinite(x).all():
        raise ValueError("features must be finite numbers")
    return x


def list_column(z: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1] if z.size else np.zeros(len(z) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(z, float).ravel()))


def sparse_column(n: int, width: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> pa.Array:
    """n sparse structs from non-zeros sorted by row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))
    parts = [pa.array(np.full(n, width, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(cols.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(values.astype(float)))]
    return pa.StructArray.from_arrays(parts, ["size", "indices", "values"])


def binary_target(df: DataFrame, label_col: str, out: str = "y") -> DataFrame:
    """df with labels of exactly two values encoded as -1 and 1 in their order; fails on others."""
    values = [r[0] for r in df.select(label_col).distinct().limit(3).collect()]
    if len(values) != 2 or None in values:
        raise TypeError("a classifier needs exactly two label values")
    low, high = sorted(values)
    return df.withColumn(out, F.when(F.col(label_col) == high, 1.0).otherwise(-1.0))


def numeric_target(df: DataFrame, label_col: str, out: str = "y") -> DataFrame:
    """df with the target as double; a null fails the query."""
    y = F.col(label_col).cast("double")
    return df.withColumn(out, F.when(y.isNotNull() & ~F.isnan(y), y).otherwise(F.raise_error(F.lit("the target must be a number")).cast("double")))

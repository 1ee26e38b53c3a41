"""Gram operators: kernels of a query set with all rows, alignment, approximation error.

Rows are packed into blocks, one matrix a row, so that a task multiplies matrices
and never sees a row-by-row product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import kernels
from kestrel.functions.sparse import Csr, Postings
from kestrel.sources.features import batch_matrix, batch_rows, checked, from_coo
from kestrel.sources.tables import materialise

BLOCK = 512
#: A query set of at most this many bytes is broadcast; a larger one meets the rows block by block.  Narrow rows of at most as many are broadcast too.
BROADCAST_BYTES = 64 << 20
#: Rows of at most this many features meet as plain columns in compiled code, wider ones as matrices.
NARROW = 16
#: Pairs up to which a query of the column form keeps to it; higher-order functions over arrays are not compiled.
COLUMN_PAIRS = 1 << 20
#: Tasks a core that rows are dealt to before they meet the queries, whatever the files they lie in.
DEALT = 4
#: Queries of a strip of numbered pairs: a row meets so many in turn, so that written pairs repeat ids at short distances.
STRIP = 256
#: Numbered pairs of a task at most: written, a file's ids of rows, one a strip's width of pairs, stay within a Parquet dictionary (1 MB, 131,072 ids).
TASK_PAIRS = STRIP * 100_000
#: Pairs from which on copies are looked for, and pairs a pair of bases, on average, from which on pairs are dealt by bases.
COPIED_PAIRS, COPIES = 1 << 27, 256
#: Pairs of a task dealt by bases, so that a written file's kernels and ids stay within Parquet dictionaries, tasks at most, and pairs of bases of a strip.
BASE_TASK_PAIRS, BASE_TASKS, BASE_STRIP = 864_000, 1 << 17, 16
#: Rows of a sparse block of which only sums leave the task, and features at most that two such blocks meet on as matrices.
SUMMED_BLOCK, SUMMED_FEATURES = 2048, 4096


def blocks(df: DataFrame, id_col: str, features: str = "features", size: int = BLOCK) -> DataFrame:
    """(ids, d, cells): up to ``size`` rows in one binary matrix."""

    def pack(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                batch = whole.slice(lo, size)
                x = batch_matrix(batch.column(1))
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    "d": pa.array([x.shape[1]], pa.int32()),
                    "cells": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
                })

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features).alias("x")).mapInArrow(pack, "ids array<long>, d int, cells binary")


def _met(rows: DataFrame, queries: DataFrame, on=None) -> DataFrame:
    """Every block of rows with every block of queries (that ``on`` lets through); queries are broadcast if they are small."""
    q = materialise(queries, "query-blocks")
    size = q.agg(F.coalesce(F.sum(F.octet_length("q_cells")), F.lit(0))).first()[0]
    q = F.broadcast(q) if size <= BROADCAST_BYTES else q
    return rows.crossJoin(q) if on is None else rows.join(q, on)


def _dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a row of df is much work here, and a file of one row group is read by one task."""
    return df.repartition(DEALT * df.sparkSession.sparkContext.defaultParallelism)


def block_pairs(rows: DataFrame, queries: DataFrame, id_col: str, features: str = "features") -> DataFrame:
    """Every block of rows with every block of queries; few, large rows."""
    q = blocks(queries, id_col, features).select(F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    return _met(_dealt(blocks(rows, id_col, features)), q)


def sparse_blocks(df: DataFrame, id_col: str, features: str = "features", size: int = BLOCK) -> DataFrame:
    """(ids, d, cells): up to ``size`` sparse rows in one binary; counts, then indices, then values."""

    def pack(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                batch = whole.slice(lo, size)
                x = batch_rows(batch.column(1))
                cells = np.concatenate([np.diff(x.indptr).astype("<i8"), x.indices.astype("<i8"), x.data.astype("<f8").view("<i8")]).tobytes()
                yield pa.RecordBatch.from_pydict({"ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), "d": pa.array([x.d], pa.int32()), "cells": pa.array([cells], pa.binary())})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features).alias("x")).mapInArrow(pack, "ids array<long>, d int, cells binary")


def _unpack(cells: bytes, n: int, d: int) -> Csr:
    flat = np.frombuffer(cells, "<i8")
    k = (len(flat) - n) // 2
    return Csr(np.concatenate([[0], np.cumsum(flat[:n])]), flat[n : n + k], flat[n + k :].view("<f8"), d)


def gram(rows: DataFrame, queries: DataFrame, id_col: str, kernel, features: str = "features", to_six: bool = False, **params) -> DataFrame:
    """(i, j, k): kernel of query i with row j, rounded to six digits on request; kernel is a name or a callable on matrices."""
    if not callable(kernel) and (name := kernel.replace("-", "_")) in kernels.BY_FEATURE and (found := _narrow(queries, features)):
        return _narrow_gram(rows, queries, id_col, name, *found, features, to_six, **params)

    def compute(batches):
        for batch in batches:
            ids, d, cells, q_ids, q_cells = (c.to_pylist() for c in batch.columns)
            for i, w, c, qi, qc in zip(ids, d, cells, q_ids, q_cells):
                x, q = np.frombuffer(c).reshape(-1, w), np.frombuffer(qc).reshape(-1, w)
                k = kernel(q, x) if callable(kernel) else kernels.matrix(kernel, q, x, **params)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, len(i))), pa.array(np.tile(i, len(qi))), pa.array(k.ravel())], ["i", "j", "k"])

    found = block_pairs(rows, queries, id_col, features).mapInArrow(compute, "i long, j long, k double")
    return found.select("i", "j", kernels.rounded(F.col("k")).alias("k")) if to_six else found


def _narrow(queries: DataFrame, features: str) -> tuple[int, int] | None:
    """The width and number of queries that are dense, narrow and few enough to be broadcast as columns; else None."""
    if not dict(queries.dtypes)[features].startswith("array"):
        return None
    found = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("width")).first()
    width = found.width or 0
    return (width, found.n) if 0 < width <= NARROW and found.n * (width + 1) * 8 <= BROADCAST_BYTES else None


def _paired(x: DataFrame, q: DataFrame, n: int, n_queries: int) -> DataFrame:
    """All n rows of x with all rows of q, by numbers of pairs that both are looked up by.

    A nested-loop join copies each pair that it gives out, as it forms all pairs of a
    row before the first leaves; a hash join on unique keys gives out a pair at a time.
    """

    def numbered(df, name):  # alike rows are neighbours, so that equal kernels are, which written pairs then repeat at short distances
        key, *numbers = df.columns
        return F.broadcast(df.withColumn(name, F.row_number().over(Window.orderBy(*numbers, key)).cast("long") - 1))

    def value(sql):
        return F.coalesce(F.expr(sql), F.lit(0))  # none is null: no test a pair

    # a strip of queries meets all rows before the next does; the last strip is as wide as what is left
    spark, whole = x.sparkSession, n_queries // STRIP
    tasks = max(DEALT * spark.sparkContext.defaultParallelism, -(-n * n_queries // TASK_PAIRS))
    pairs = spark.range(n * n_queries, numPartitions=tasks)
    pairs = pairs.select("id", value(f"id div {max(1, n * STRIP)}L").alias("strip"))
    pairs = pairs.select("strip", (F.col("id") - F.col("strip") * (n * STRIP)).alias("at"))
    in_row = value(f"if(strip < {whole}L, at div {STRIP}L, at div {max(1, n_queries % STRIP)}L)")
    pairs = pairs.select("strip", "at", in_row.alias("x_at"))
    wide = F.expr(f"if(strip < {whole}L, {STRIP}L, {n_queries % STRIP}L)")
    pairs = pairs.select("x_at", (F.col("strip") * STRIP + F.col("at") - F.col("x_at") * wide).alias("q_at"))
    return pairs.join(numbered(x, "x_at"), "x_at").join(numbered(q, "q_at"), "q_at")


def _varied(x: DataFrame, q: DataFrame, n_pairs: int, width: int) -> int | None:
    """The feature but for which rows and queries are copies of few bases; else None."""
    if width < 2 or n_pairs < COPIED_PAIRS:
        return None

    def bases(df, letter):
        return df.agg(*(F.approx_count_distinct(F.xxhash64(*(f"{letter}{s}" for s in range(width) if s != t))) for t in range(width))).first()

    found = [a * b for a, b in zip(bases(x, "x"), bases(q, "q"))]
    t = min(range(width), key=found.__getitem__)
    return t if found[t] * COPIES <= n_pairs else None


def _paired_by_bases(x: DataFrame, q: DataFrame, kernel: str, n_pairs: int, width: int, varied: int, **params) -> DataFrame | None:
    """All rows of x with all rows of q, both copies of few bases but for one feature, in an order in which written pairs take little disk.

    The kernel is that of two bases and a term of the varied feature.  Pairs of bases
    are sorted by theirs: a query meets the copies of one base, then those of a base
    whose kernels are the same to six digits, so that these sequences repeat, and so
    do those of the ids from query to query.  A pair of bases is met in one task: None
    where one alone may be more than a task's pairs.
    """
    others = [t for t in range(width) if t != varied]

    def bases(df, letter, key):
        alike = [f"{letter}{t}" for t in others]
        held = df.groupBy(*alike).agg(F.array_sort(F.collect_list(F.struct(key, f"{letter}{varied}"))).alias(f"{letter}_copies"))
        return materialise(held.withColumn(f"{letter}_base", F.row_number().over(Window.orderBy(*alike)) - 1), "bases")

    spark, xb, qb = x.sparkSession, bases(x, "x", "j"), bases(q, "q", "i")
    if math.prod(b.agg(F.coalesce(F.max(F.size(c)), F.lit(0))).first()[0] for b, c in ((xb, "x_copies"), (qb, "q_copies"))) > TASK_PAIRS:
        return None
    tasks = max(DEALT * spark.sparkContext.defaultParallelism, min(BASE_TASKS, -(-n_pairs // BASE_TASK_PAIRS)))
    near = kernels.scalars(kernel, [F.col(f"q{t}") for t in others], [F.col(f"x{t}") for t in others], **params)
    pairs = _dealt(qb.drop("q_copies")).crossJoin(F.broadcast(xb.drop("x_copies"))).select("q_base", "x_base", near.alias("near"))
    order = ["near", "q_base", "x_base"]  # ties of the kernel too are dealt over tasks
    pairs = pairs.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    pairs = pairs.withColumn("strip", F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}L) div {BASE_STRIP}L"))  # its low bits count a task's rows
    met = pairs.join(F.broadcast(qb), "q_base").select("strip", *order, *(f"q{t}" for t in others), F.explode("q_copies").alias("copy"))
    met = met.select("strip", *order, *(f"q{t}" for t in others), "copy.*").sortWithinPartitions("strip", f"q{varied}", *order)
    met = met.withColumn("x_base", F.expr("x_base + shiftrightunsigned(monotonically_increasing_id(), 63)"))  # plus 0: a join's plan drops a sort that it sees below
    met = met.join(F.broadcast(xb), "x_base").select("i", *(f"q{t}" for t in range(width)), *(f"x{t}" for t in others), F.explode("x_copies").alias("copy"))
    return met.select("i", *(f"q{t}" for t in range(width)), *(f"x{t}" for t in others), "copy.*")


def _narrow_gram(rows: DataFrame, queries: DataFrame, id_col: str, kernel: str, width: int, n_queries: int, features: str, to_six: bool, **params) -> DataFrame:
    """gram of rows of few features: a column a feature, pair by pair in compiled code, without a worker process."""

    def cells(df, key, letter):  # dealt after this, as Spark would compute a row's numbers again for every pair
        valid = checked(df.select(F.col(id_col).cast("long").alias(key), F.col(features).cast("array<double>").alias("x")), "x", width)
        numbers = [F.element_at("x", t + 1) for t in range(width)]  # none is null here, which the plan learns by coalesce: no test a pair
        out = [F.coalesce(kernels.prepared(kernel, v), F.lit(0.0)).alias(f"{letter}{t}") for t, v in enumerate(numbers)]
        return valid.select(key, *out, kernels.side_sum(numbers).alias(f"{letter}_sum"))

    left, right, n = cells(rows, "j", "x"), cells(queries, "i", "q"), rows.count()
    few = n * (width + 1) * 8 <= BROADCAST_BYTES
    varied = _varied(left, right, n * n_queries, width) if few and to_six and kernel in kernels.SUMS else None
    met = None if varied is None else _paired_by_bases(left, right, kernel, n * n_queries, width, varied, **params)
    if met is None:
        met = _paired(left, right, n, n_queries) if few else _dealt(left).crossJoin(F.broadcast(right))
    q, x = [F.col(f"q{t}") for t in range(width)], [F.col(f"x{t}") for t in range(width)]
    k = kernels.scalars(kernel, q, x, **params)
    if not to_six:
        return met.select("i", "j", k.alias("k"))
    if (near := kernels.quick(kernel, q, x, F.col("q_sum"), F.col("x_sum"))) is None:
        return met.select("i", "j", k.alias("k")).select("i", "j", kernels.rounded(F.col("k")).alias("k"))
    met = met.select("i", "j", *q, *x, near.alias("near"))
    return met.select("i", "j", kernels.rounded(F.col("near"), k).alias("k"))


def sparse_anova_gram(rows: DataFrame, queries: DataFrame, id_col: str, degree: int, features: str = "features") -> DataFrame:
    """(i, j, k): the non-zero ANOVA kernels of sparse query i with sparse row j, at the cost of their shared non-zeros."""

    def compute(batches):
        for batch in batches:
            for ids, d, cells, q_ids, q_cells in zip(*(c.to_pylist() for c in batch.columns)):
                x, q = _unpack(cells, len(ids), d), _unpack(q_cells, len(q_ids), d)
                j, i, k = Postings(q.rows(), q.indices, q.data, len(q)).anova(x, degree)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q_ids)[i], pa.int64()), pa.array(np.array(ids)[j], pa.int64()), pa.array(k)], ["i", "j", "k"])

    q = sparse_blocks(queries, id_col, features).select(F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    return _met(sparse_blocks(rows, id_col, features), q).mapInArrow(compute, "i long, j long, k double")


def _anova_block(q: Csr, x: Csr, degree: int) -> np.ndarray:
    """The ANOVA kernels of all rows of q with all rows of x, over the features that both have; zero where fewer than ``degree`` are shared."""
    shared = np.intersect1d(q.indices, x.indices)
    if len(shared) > SUMMED_FEATURES:
        out = np.zeros((len(q), len(x)))
        j, i, k = Postings(q.rows(), q.indices, q.data, len(q)).anova(x, degree)
        out[i, j] = k
        return out

    def dense(rows):
        at = np.minimum(np.searchsorted(shared, rows.indices), max(0, len(shared) - 1))
        there = shared[at] == rows.indices if len(shared) else np.zeros(rows.size, bool)
        out = np.zeros((len(rows), len(shared)))
        np.add.at(out, (rows.rows()[there], at[there]), rows.data[there])
        return out

    a, b = dense(q), dense(x)
    if degree == 1:
        return a @ b.T
    if degree > 2:  # power sums of higher degrees cancel
        return kernels.anova_by_features(a, b, degree)
    k = a @ b.T
    k *= k
    k -= (a * a) @ (b * b).T
    k *= 0.5
    k[((a != 0).astype(np.float32) @ (b != 0).astype(np.float32).T) < degree] = 0.0
    return k


def sparse_anova_totals(rows: DataFrame, queries: DataFrame, id_col: str, degree: int, features: str = "features") -> DataFrame:
    """(i, n_rows, total): how many rows have a non-zero ANOVA kernel with sparse query i, and the sum of these kernels.

    The same pairs as in ``sparse_anova_gram``, summed where they are computed, so
    that a row a query and block leaves the task; queries without such a row have none.
    """

    def compute(batches):
        for batch in batches:
            for ids, d, cells, q_ids, q_cells in zip(*(c.to_pylist() for c in batch.columns)):
                k = _anova_block(_unpack(q_cells, len(q_ids), d), _unpack(cells, len(ids), d), degree)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(np.count_nonzero(k, axis=1)), pa.array(k.sum(axis=1))], ["i", "n_rows", "total"])

    q = sparse_blocks(queries, id_col, features, SUMMED_BLOCK).select(F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    part = _met(_dealt(sparse_blocks(rows, id_col, features, SUMMED_BLOCK)), q).mapInArrow(compute, "i long, n_rows long, total double")
    return part.groupBy("i").agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total")).where("n_rows > 0")


def sparse_gram(rows_coo: DataFrame, queries_coo: DataFrame, id_col: str) -> DataFrame:
    """(i, j, k): linear Gram of coordinate rows, packed first, so that a frequent feature is no join key; zero results have no row."""
    width = 1 + max(c.agg(F.max("j")).first()[0] or 0 for c in (rows_coo, queries_coo))
    return sparse_anova_gram(from_coo(rows_coo, id_col, width), from_coo(queries_coo, id_col, width), id_col, 1)


def _pair_sums(df: DataFrame, id_col: str, columns: list[str], function, names: list[str]) -> DataFrame:
    """Sums over all pairs of rows with i <= j of function(rows of both blocks, mask); one partial row a pair of blocks."""
    packed = df.select(F.col(id_col).cast("long").alias("id"), F.concat(*columns).alias("x"))
    width = len(df.select(columns[0]).first()[0])
    packed = materialise(blocks(packed.repartitionByRange("id").sortWithinPartitions("id"), "id", "x"), "row-blocks")
    q = packed.select(F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    pairs = _met(packed, q, F.array_min("q_ids") <= F.array_max("ids"))  # blocks of which all pairs are in the other order do not meet

    def compute(batches):
        for batch in batches:
            ids, d, cells, q_ids, q_cells = (c.to_pylist() for c in batch.columns)
            for i, w, c, qi, qc in zip(ids, d, cells, q_ids, q_cells):
                mask = np.array(qi)[:, None] <= np.array(i)[None]
                if mask.any():
                    x, y = np.frombuffer(qc).reshape(-1, w), np.frombuffer(c).reshape(-1, w)
                    values = function(x, y, width, mask)
                    yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in values], names)

    return pairs.mapInArrow(compute, ", ".join(f"{n} double" for n in names))


def approximation_error(df: DataFrame, id_col: str, features: str, z: str, kernel, loss: str = "l1", **params) -> DataFrame:
    """One row: mean, total and largest loss of <z_i, z_j> against the exact kernel over pairs i <= j.

    ``loss`` is l1 (absolute error) or l2 (its square); ids must be unique.
    """
    if loss not in ("l1", "l2"):
        raise ValueError(f"loss {loss!r} is neither 'l1' nor 'l2'")

    def errors(x, y, d, mask):
        exact = kernel(x[:, :d], y[:, :d]) if callable(kernel) else kernels.matrix(kernel, x[:, :d], y[:, :d], **params)
        e = np.abs(exact - x[:, d:] @ y[:, d:].T)[mask]
        e = e if loss == "l1" else e * e
        return e.sum(), e.max(), len(e)

    sums = _pair_sums(df, id_col, [features, z], errors, ["total", "largest", "pairs"])
    return sums.agg((F.sum("total") / F.sum("pairs")).alias("mean_loss"), F.sum("total").alias("total_loss"), F.max("largest").alias("max_loss"))


def kernel_alignment(df: DataFrame, id_col: str, features: str, y: str, kernel, scaling: bool = True, **params) -> DataFrame:
    """One row: y'Ky / (|K|_F n), or y'Ky without scaling, over all pairs of rows."""

    def sums(x, t, d, mask):
        k = kernel(x[:, :d], t[:, :d]) if callable(kernel) else kernels.matrix(kernel, x[:, :d], t[:, :d], **params)
        twice = np.where(mask, 2.0, 0.0)
        same = np.isclose(x[:, -1][:, None], t[:, -1][None], atol=0)  # the last column is the row's number
        twice[same] = 1.0
        return (twice * k * x[:, d][:, None] * t[:, d][None]).sum(), (twice * k * k).sum()

    keyed = df.select(id_col, F.col(features).alias("x"), F.array(F.col(y).cast("double"), F.col(id_col).cast("double")).alias("t"))
    total = _pair_sums(keyed, id_col, ["x", "t"], sums, ["yky", "kk"])
    n = df.count()
    a = F.sum("yky")
    return total.agg((a / (F.sqrt(F.sum("kk")) * F.lit(n)) if scaling else a).alias("alignment"))

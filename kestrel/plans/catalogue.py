"""Queries over the test tables and the SQL that states the same results.

Every query runs over whole tables.  Gram queries take the rows whose id is
divisible by 20 as the query set, against all rows.  Floating results are rounded
to six decimals on both sides; models are regenerated in SQL from the seed, but for
orthogonal weights, which are injected as parameters.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import kernels, linalg, rng
from kestrel.operators import gram as gram_ops
from kestrel.operators import linear, lkrf, maps
from kestrel.operators.doubly import doubly
from kestrel.operators.losses import LOSSES, sigmoid_column
from kestrel.sources.features import binary_target, feature, from_array, from_coo, numeric_target, row, to_coo, to_dense, to_sparse, valid
from kestrel.sources.tables import materialise, read, spread

QUERIES: dict = {}
ORACLES: dict = {}
SEED = 11


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


_r_pair = kernels.rounded


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# fixtures ---------------------------------------------------------------------


def emb(spark, sf) -> DataFrame:
    """All embeddings as doubles."""
    return from_array(read(spark, sf, "embeddings"), "vec_id", "embedding").withColumnRenamed("vec_id", "id")


def emb_bin(spark, sf) -> DataFrame:
    """Embeddings with labels below 5 as 1 and others as -1."""
    t = read(spark, sf, "embeddings")
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"))


def unit(spark, sf) -> DataFrame:
    """Parts as four numbers in [0, 1]."""
    p = read(spark, sf, "part")
    cells = (F.col("p_size") / 50.0, F.col("p_retailprice") / 2200.0, F.pmod("p_partkey", F.lit(97)) / 97.0, F.char_length("p_type") / 32.0)
    return p.select(F.col("p_partkey").alias("id"), F.array(*(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)) for c in cells)).alias("features"))


def tokens(spark, sf) -> DataFrame:
    """Word counts of documents, hashed to 64 cells: (id, j, v)."""
    words = spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w")).where("w <> ''")
    j = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long") % 64
    return words.select("id", j.cast("int").alias("j")).groupBy("id", "j").agg(F.count("*").cast("double").alias("v"))


def events(df: DataFrame) -> DataFrame:
    """Events as one-hot type and scaled value; works on a stream as well."""
    kinds = [(F.col("event_type") == k).cast("double") for k in ("click", "purchase", "view")]
    return df.select(F.col("event_id").alias("id"), F.array(*(F.coalesce(k, F.lit(0.0)) for k in kinds), F.col("value") / 500.0).alias("features"))


EMB = "(SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
UNIT = """(SELECT p_partkey AS id, list_transform([p_size / 50.0e0, p_retailprice / 2200e0, (p_partkey % 97) / 97e0, length(p_type) / 32e0], lambda v: least(greatest(CAST(v AS DOUBLE), 0e0), 1e0)) AS x FROM part)"""


#: Features of an embedding.
D = 64
BIN = "(SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CASE WHEN label < 5 THEN 1e0 ELSE -1e0 END AS y FROM embeddings)"


# SQL building blocks ----------------------------------------------------------


def _cells(stream: str, rows: str, d: int, dist: str = "rademacher", p: float = 0.0, seed: int = SEED) -> str:
    """(i, w): rows of a random matrix as lists."""
    return f"(SELECT i, list(w ORDER BY j) AS w FROM (SELECT i, j, {rng.sql_cell(seed, stream, 'i', 'j', dist, p)} AS w FROM range(0, {rows}) a(i), range(0, {d}) b(j)) GROUP BY i)"


def _one(stream: str, d: int, dist: str = "rademacher", row: int = 0, seed: int = SEED) -> str:
    """One row of a random matrix as a scalar list."""
    return f"(SELECT list({rng.sql_cell(seed, stream, str(row), 'j', dist)} ORDER BY j) FROM range(0, {d}) b(j))"


def _project(source: str, weights: str) -> str:
    return f"(SELECT id, i, list_dot_product(x, w) AS p FROM {source} s, {weights} m)"


def _fourier(projection: str, width: int, gamma: float, offset: bool, seed: int = SEED) -> str:
    s = repr(math.sqrt(2 * gamma)) + "e0"
    if offset:
        u = rng.sql_uniform(seed, "offset", "0", "i")
        return f"(SELECT id, i, sqrt(2e0 / {width}) * cos({s} * p + 2e0 * pi() * {u}) AS z FROM {projection} q)"
    return f"(SELECT id, i, sqrt(2e0 / {width}) * cos({s} * p) AS z FROM {projection} q UNION ALL SELECT id, i + {width // 2}, sqrt(2e0 / {width}) * sin({s} * p) FROM {projection} q)"


def _mul(a: str, b: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda c: {a}[c] * {b}[c])"


def _had(v: str, n: int) -> str:
    return f"list_transform(range(0, {n}), lambda r: list_sum(list_transform(range(0, {n}), lambda c: {v}[c + 1] * (1 - 2 * (bit_count(CAST(r & c AS BIGINT)) % 2)))))"


def _values(m: np.ndarray) -> str:
    rows = ", ".join(f"({i}, [{', '.join(repr(float(v)) + 'e0' if 'e' not in repr(float(v)) else repr(float(v)) for v in row)}])" for i, row in enumerate(m))
    return f"(SELECT * FROM (VALUES {rows}) t(i, w))"


def _out(inner: str) -> str:
    return f"SELECT id, CAST(i AS BIGINT) AS i, round(z, 6) + 0.0 AS z FROM {inner} o"


def _long(df: DataFrame, z: str = "z") -> DataFrame:
    return df.select("id", F.posexplode(z).alias("i", "z")).select("id", F.col("i").cast("long").alias("i"), _r(F.col("z")).alias("z"))


def _map(name: str, make, fixture, d: int, sql: str | None) -> None:
    _add(name, lambda spark, sf: _long(make().fit(d).transform(fixture(spark, sf))), _out(sql) if sql else None)


# exact kernels ------------------------------------------------------------------


def _kernel(name: str, kernel: str, fixture, source: str, expression: str, native: bool = False, **params) -> None:
    def query(spark, sf):
        df = fixture(spark, sf)
        chosen = df.where(F.col("id") % 20 == 0)
        if native and df.count() * chosen.count() <= gram_ops.COLUMN_PAIRS:  # the column form, pair by pair over arrays
            q = chosen.select(F.col("id").alias("i"), F.col("features").alias("q"))
            found = df.select(F.col("id").alias("j"), "features").join(F.broadcast(q), F.lit(True)).select("i", "j", kernels.column(kernel, F.col("q"), F.col("features"), **params).alias("k"))
            return found.select("i", "j", kernels.rounded(F.col("k")).alias("k"))
        return gram_ops.gram(df, chosen, "id", kernel, to_six=True, **params)

    sql = f"SELECT a.id AS i, b.id AS j, round({expression}, 6) + 0.0 AS k FROM {source} a, {source} b WHERE a.id % 20 = 0"
    _add(f"kernel_{name}", query, sql)


_DOT = "list_dot_product(a.x, b.x)"
_pow = lambda n: f"list_dot_product(list_transform(a.x, lambda v: v ** {n}), list_transform(b.x, lambda v: v ** {n}))"
_zip = lambda body: f"list_sum(list_transform(range(1, len(a.x) + 1), lambda t: {body}))"
_kernel("linear", "linear", emb, EMB, _DOT)
_kernel("poly", "poly", emb, EMB, f"({_DOT} + 0.5e0) ** 3", degree=3, bias=0.5)
_kernel("exp", "exp", emb, EMB, f"exp(0.7e0 * {_DOT})", gamma=0.7)
_kernel("rbf", "rbf", emb, EMB, f"exp(-0.5e0 * {_zip('(a.x[t] - b.x[t]) ** 2')})", gamma=0.5)
_A2 = f"(({_DOT}) ** 2 - {_pow(2)}) / 2"
_A3 = f"(({_DOT}) ** 3 - 3 * {_pow(2)} * {_DOT} + 2 * {_pow(3)}) / 6"
_A4 = f"(({_DOT}) ** 4 - 6 * {_pow(2)} * ({_DOT}) ** 2 + 3 * ({_pow(2)}) ** 2 + 8 * {_pow(3)} * {_DOT} - 6 * {_pow(4)}) / 24"
_kernel("anova2", "anova", emb, EMB, _A2, degree=2)
_kernel("anova3", "anova", emb, EMB, _A3, degree=3)
_kernel("anova4_dp", "anova_cython", emb, EMB, _A4, degree=4)
_kernel("anova4_recurrence", "anova", emb, EMB, _A4, degree=4)
_kernel("anova4_native", "anova", emb, EMB, _A4, native=True, degree=4)
_ALL = "list_product(list_transform(range(1, len(a.x) + 1), lambda t: 1 + a.x[t] * b.x[t]))"
_kernel("all_subsets", "all_subsets", unit, UNIT, _ALL)
_kernel("intersection", "intersection", unit, UNIT, _zip("least(a.x[t], b.x[t])"), native=True)
_kernel("chi2", "chi_square", unit, UNIT, _zip("CASE WHEN a.x[t] + b.x[t] = 0 THEN 0e0 ELSE 2 * a.x[t] * b.x[t] / (a.x[t] + b.x[t]) END"), native=True)
_kernel("hellinger", "hellinger", unit, UNIT, _zip("sqrt(a.x[t]) * sqrt(b.x[t])"))
_half = lambda x, y: f"list_dot_product(a.x[{x}], b.x[{y}])"
_kernel("pairwise", "pairwise", emb, EMB, f"{_half('1:32', '1:32')} * {_half('33:64', '33:64')}")
_kernel("pairwise_sym", "pairwise_symmetric", emb, EMB, f"0.5e0 * ({_half('1:32', '1:32')} * {_half('33:64', '33:64')} + {_half('1:32', '33:64')} * {_half('33:64', '1:32')})")


def _sparse_linear(spark, sf):
    return _totals(sparse_tokens(spark, sf), 1)


def _totals(rows: DataFrame, degree: int) -> DataFrame:
    rows = materialise(rows, "sparse-rows")  # words are split and hashed once
    k = gram_ops.sparse_anova_totals(rows, rows.where(F.col("id") % 20 == 0), "id", degree)
    return k.select("i", "n_rows", _r(F.col("total")).alias("total"))


_TOK = "(SELECT id, j, CAST(count(*) AS DOUBLE) AS v FROM (SELECT doc_id AS id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS j FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents) WHERE w <> '') GROUP BY id, j)"
_add("kernel_sparse_linear", _sparse_linear, f"SELECT i, count(*) AS n_rows, round(sum(k), 6) + 0.0 AS total FROM (SELECT a.id AS i, b.id AS p, sum(a.v * b.v) AS k FROM {_TOK} a JOIN {_TOK} b ON a.j = b.j WHERE a.id % 20 = 0 GROUP BY a.id, b.id) WHERE k <> 0 GROUP BY i")


def _alignment(spark, sf, scaling=True):
    df = gram_ops.kernel_alignment(emb_bin(spark, sf), "id", "features", "y", "rbf", scaling, gamma=0.5)
    return df.select(_r(F.col("alignment"), 4).alias("alignment"))


_K2 = "SELECT a.y * b.y AS yy, exp(-0.5e0 * list_sum(list_transform(range(1, 65), lambda t: (a.x[t] - b.x[t]) ** 2))) AS k FROM v a, v b"
_V = "WITH v AS (SELECT list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, CASE WHEN label < 5 THEN 1e0 ELSE -1e0 END AS y FROM embeddings)"
_add("kernel_alignment", _alignment, f"{_V} SELECT round(sum(yy * k) / (sqrt(sum(k * k)) * (SELECT count(*) FROM v)), 4) + 0.0 AS alignment FROM ({_K2})")
_add("kernel_alignment_unscaled", lambda s, sf: _alignment(s, sf, False), f"{_V} SELECT round(sum(yy * k), 4) + 0.0 AS alignment FROM ({_K2})")

# samplers -----------------------------------------------------------------------


def _sampler(dist: str, p: float = 0.0) -> None:
    def query(spark, sf):
        """A random matrix as a distributed table, one row a (part, column) cell, drawn by each task itself."""
        rows = read(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j"))
        cell = F.expr(rng.sql_cell(SEED, "s", "i", "j", dist, p, rng.spark_uniform).replace("e0", "D"))
        return rows.select("i", "j", _r(cell).alias("w"))

    _add(f"sampler_{dist}", query, f"SELECT p_partkey AS i, CAST(j AS BIGINT) AS j, round({rng.sql_cell(SEED, 's', 'p_partkey', 'j', dist, p)}, 6) + 0.0 AS w FROM part, range(0, 8) t(j)")


for _d in ("rademacher", "gaussian", "laplace", "uniform"):
    _sampler(_d)
_sampler("sparse_rademacher", 0.75)


def _batch_sampler(spark, sf):
    """The batch generator's own cells, to be held against the SQL ones."""
    cells = rng.matrix(SEED, "s", 40, 8, "gaussian")
    return spark.createDataFrame([(i, j, float(cells[i, j])) for i in range(40) for j in range(8)], "i long, j long, w double").select("i", "j", _r(F.col("w")).alias("w"))


_add("sampler_batch", _batch_sampler, f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round({rng.sql_cell(SEED, 's', 'i', 'j', 'gaussian')}, 6) + 0.0 AS w FROM range(0, 40) a(i), range(0, 8) b(j)")


def _subfeatures(spark, sf):
    found = rng.subsets(SEED, "sub", 50, 12, 4)
    return spark.createDataFrame([(i, int(j)) for i in range(50) for j in found[i]], "i long, j long")


def _sub_sql(stream: str, rows: str, d: int, k: int, seed: int = SEED) -> str:
    return f"(SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {rng.sql_uniform(seed, stream, 'i', 'j')}) AS n FROM range(0, {rows}) a(i), range(0, {d}) b(j)) WHERE n <= {k})"


_add("sampler_subfeatures", _subfeatures, f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM {_sub_sql('sub', '50', 12, 4)}")


def _categorical(spark, sf):
    drawn = rng.categorical(SEED, "cat", 200, [0], [1, 2, 3, 4])[:, 0]
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(drawn)], "i long, x long")


_U_CAT = rng.sql_uniform(SEED, "cat", "i", "0")
_add("sampler_categorical", _categorical, f"SELECT CAST(i AS BIGINT) AS i, CAST(CASE WHEN u < 0.1e0 THEN 0 WHEN u < 0.3e0 THEN 1 WHEN u < 0.6e0 THEN 2 ELSE 3 END AS BIGINT) AS x FROM (SELECT i, {_U_CAT} AS u FROM range(0, 200) a(i))")


def _binomial(spark, sf):
    drawn = rng.binomial(SEED, "bin", 200, [0], 6, 0.3)[:, 0]
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(drawn)], "i long, x long")


_PMF = "(SELECT k, sum(m) OVER (ORDER BY k) AS c FROM (SELECT k, factorial(6) / (factorial(k) * factorial(6 - k)) * (0.3e0 ** k) * (0.7e0 ** (6 - k)) AS m FROM (SELECT CAST(range AS INTEGER) AS k FROM range(0, 7))))"
_add("sampler_binomial", _binomial, f"SELECT CAST(i AS BIGINT) AS i, CAST(least(6, count(*) FILTER (c <= u)) AS BIGINT) AS x FROM (SELECT i, {rng.sql_uniform(SEED, 'bin', 'i', '0')} AS u FROM range(0, 200) a(i)), {_PMF} GROUP BY i")


def _permutation(spark, sf):
    return spark.createDataFrame([(i, n, int(j)) for i in range(5) for n, j in enumerate(rng.permutation(SEED, "perm", i, 16))], "i long, n long, j long")


_add("sampler_permutation", _permutation, f"SELECT CAST(i AS BIGINT) AS i, row_number() OVER (PARTITION BY i ORDER BY {rng.sql_uniform(SEED, 'perm', 'i', 'j')}) - 1 AS n, CAST(j AS BIGINT) AS j FROM range(0, 5) a(i), range(0, 16) b(j)")

# transforms ---------------------------------------------------------------------


class _Hadamard(maps.FeatureMap):
    def apply(self, x):
        return maps.fwht(x)


_map("hadamard_transform", lambda: _Hadamard(64), emb, 64, f"(SELECT id, unnest(range(0, 64)) AS i, unnest({_had('x', 64)}) / 8e0 AS z FROM {EMB})")

# feature maps -------------------------------------------------------------------

_G = _cells("w", "16", 64, "gaussian")
_map("map_random_fourier_offset", lambda: maps.RandomFourier(16, 0.5, True, SEED), emb, 64, _fourier(_project(EMB, _G), 16, 0.5, True))
_map("map_random_fourier_cossin", lambda: maps.RandomFourier(16, "auto", False, SEED), emb, 64, _fourier(_project(EMB, _cells("w", "8", 64, "gaussian")), 16, 1 / 64, False))
_map("map_rbf_sampler", lambda: maps.RBFSampler(16, 1.0, SEED), emb, 64, _fourier(_project(EMB, _G), 16, 1.0, True))
_ORF = maps.OrthogonalRandomFeature(64, 0.5, use_offset=True, seed=SEED)
_map("map_orthogonal", lambda: maps.OrthogonalRandomFeature(64, 0.5, use_offset=True, seed=SEED), emb, D, _fourier(_project(EMB, _values(_ORF.fit(D).W.T)), 64, 0.5, True))
_SORF1 = f"(SELECT id, t, {_mul('x', 'w', D)} AS v FROM {EMB} s, (SELECT i AS t, w FROM {_cells('d1', '2', D)}) m)"
_SORF2 = f"(SELECT id, q.t, {_mul('v', 'w', D)} AS v FROM (SELECT id, t, {_had('v', D)} AS v FROM {_SORF1}) q JOIN (SELECT i AS t, w FROM {_cells('d2', '2', D)}) m ON q.t = m.t)"
_SORF3 = f"(SELECT id, q.t, {_mul('v', 'w', D)} AS v FROM (SELECT id, t, {_had('v', D)} AS v FROM {_SORF2}) q JOIN (SELECT i AS t, w FROM {_cells('d3', '2', D)}) m ON q.t = m.t)"
_SORF = f"(SELECT id, t * {D} + c AS i, p / {D}e0 AS p FROM (SELECT id, t, unnest(range(0, {D})) AS c, unnest({_had('v', D)}) AS p FROM {_SORF3}))"
_map("map_structured_orthogonal", lambda: maps.StructuredOrthogonalRandomFeature(128, 0.5, use_offset=True, seed=SEED), emb, D, _fourier(_SORF, 128, 0.5, True))
_FFSG = f"""(SELECT t, list(g * s / f ORDER BY c) AS sg FROM (SELECT t, c, {rng.sql_cell(SEED, 'w', 't', 'c', 'gaussian')} AS g,
  sqrt(sum(({rng.sql_cell(SEED, 'w', 't', 'c', 'gaussian')}) ** 2) OVER (PARTITION BY t)) AS f FROM range(0, 2) a(t), range(0, {D}) b(c)) q
  JOIN (SELECT 0 AS t2, i AS c2, sqrt(list_sum(list_transform(w, lambda g: g * g))) AS s FROM {_cells('s0', '64', D, 'gaussian')} UNION ALL SELECT 1, i, sqrt(list_sum(list_transform(w, lambda g: g * g))) FROM {_cells('s1', '64', D, 'gaussian')}) r ON t = t2 AND c = c2 GROUP BY t)"""
_FFP = f"(SELECT t, list(j ORDER BY u) AS perm FROM (SELECT t, j, {rng.sql_uniform(SEED, 'perm', 't', 'j')} AS u FROM range(0, 2) a(t), range(0, {D}) b(j)) GROUP BY t)"
_FF1 = f"(SELECT id, t, {_had('v', D)} AS v FROM (SELECT id, t, {_mul('x', 'w', D)} AS v FROM {EMB} s, (SELECT i AS t, w FROM {_cells('sign', '2', D)}) m))"
_FF2 = f"(SELECT id, a.t, list_transform(range(1, {D + 1}), lambda c: v[perm[c] + 1] * sg[c]) AS v FROM {_FF1} a JOIN {_FFP} b ON a.t = b.t JOIN {_FFSG} g ON a.t = g.t)"
_FF = f"(SELECT id, t * {D} + c AS i, p / sqrt({D}e0) AS p FROM (SELECT id, t, unnest(range(0, {D})) AS c, unnest({_had('v', D)}) AS p FROM {_FF2}))"
_map("map_fastfood", lambda: maps.FastFood(128, 0.5, use_offset=True, seed=SEED), emb, D, _fourier(_FF, 128, 0.5, True))
_CIRC_CELL = f"list_sum(list_transform(range(0, {D}), lambda c: w[1 + (r - c + {D}) % {D}] * x[c + 1]))"
_CIRC = lambda dist, source=EMB: f"(SELECT id, t * {D} + r AS i, sg[r + 1] * {_CIRC_CELL} AS p FROM {source} s, (SELECT i AS t, w FROM {_cells('w', '2', D, dist)}) m JOIN (SELECT i AS t2, w AS sg FROM {_cells('sign', '2', D)}) n ON t = t2, range(0, {D}) e(r))"
_map("map_circulant", lambda: maps.SignedCirculantRandomMatrix(128, 0.5, use_offset=True, seed=SEED), emb, D, _fourier(_CIRC("gaussian"), 128, 0.5, True))
_map("map_circulant_dot", lambda: maps.SignedCirculantRandomMatrix(128, random_fourier=False, seed=SEED), emb, D, f"(SELECT id, i, p / sqrt(128e0) AS z FROM {_CIRC('gaussian')})")
_CUBE = "(SELECT id, list_transform(x, lambda v: v * v * v) AS x FROM " + EMB + ")"
_D2 = f"(SELECT id, list_sum(list_transform(x, lambda v: v * v)) AS d2 FROM {EMB})"
_map(
    "map_circulant_kernel", lambda: maps.SignedCirculantRandomKernel(128, degree=3, seed=SEED), emb, D,
    f"(SELECT a.id, a.i, (a.p ** 3 - 3 * d2 * a.p + 2 * b.p) / 6 / sqrt(128e0) AS z FROM {_CIRC('rademacher')} a JOIN {_CIRC('rademacher', _CUBE)} b ON a.id = b.id AND a.i = b.i JOIN {_D2} d ON a.id = d.id)",
)
_W64 = _cells("w", "16", D)
_RK2 = "((list_dot_product(x, w)) ** 2 - list_dot_product(list_transform(x, lambda v: v * v), list_transform(w, lambda v: v * v))) / 2"
_map("map_random_kernel_anova", lambda: maps.RandomKernel(16, seed=SEED), emb, D, f"(SELECT id, i, {_RK2} / 4e0 AS z FROM {EMB} s, {_W64} m)")
_map("map_random_kernel_all_subsets", lambda: maps.RandomKernel(16, "all-subsets", seed=SEED), emb, D, f"(SELECT id, i, list_product(list_transform(range(1, {D + 1}), lambda t: 1 + x[t] * w[t])) / 4e0 AS z FROM {EMB} s, {_W64} m)")
_SUBW = f"(SELECT c.i, list(CASE WHEN s.j IS NULL THEN 0e0 ELSE w END ORDER BY c.j) AS w FROM (SELECT i, j, {rng.sql_cell(SEED, 'w', 'i', 'j')} AS w FROM range(0, 16) a(i), range(0, {D}) b(j)) c LEFT JOIN {_sub_sql('sub', '16', D, 5)} s ON c.i = s.i AND c.j = s.j GROUP BY c.i)"
_map("map_subfeature_kernel", lambda: maps.SubfeatureRandomKernel(16, 5, seed=SEED), emb, D, f"(SELECT id, i, {_RK2} / 4e0 * sqrt(2016e0 / 10e0) AS z FROM {EMB} s, {_SUBW} m)")


def _orders(u: str, coefs, base: float = 10.0, skip: bool = False) -> tuple[str, str]:
    """SQL of a drawn order and of its scale, from the coefficients."""
    a = np.array(coefs, float)
    w = np.where(a != 0, base ** -(np.arange(len(a)) + 1.0), 0)
    if skip:
        w[:2] = 0
    c, p = np.cumsum(w) / w.sum(), w / w.sum()
    lit = lambda v: f"CAST('{float(v)!r}' AS DOUBLE)"
    used = [n for n in range(len(a)) if w[n] > 0]
    order = "CASE " + " ".join(f"WHEN {u} < {lit(c[n])} THEN {n}" for n in used[:-1]) + f" ELSE {used[-1]} END" if len(used) > 1 else str(used[0])
    scale = "CASE n " + " ".join(f"WHEN {n} THEN {lit(math.sqrt(a[n] / p[n]))}" for n in used) + " END"
    return order, scale


def _maclaurin(coefs, most: int, source: str = EMB, rows: int = 16, sub: int | None = None, skip: bool = False, seed: int = SEED, dist: str = "rademacher", p: float = 0.0) -> str:
    order, scale = _orders(rng.sql_uniform(seed, "order", "i", "0"), coefs, skip=skip)
    product = "1e0"
    joins = ""
    for k in range(most):
        product += f" * CASE WHEN n > {k} THEN list_dot_product(x, w{k}.w) ELSE 1e0 END"
        cells = _cells(f"w{k}", str(rows), D, dist, p, seed)
        if sub:
            cells = f"(SELECT c.i, list(CASE WHEN s.j IS NULL THEN 0e0 ELSE w * sqrt({D}e0 / {sub}) END ORDER BY c.j) AS w FROM (SELECT i, j, {rng.sql_cell(seed, f'w{k}', 'i', 'j', dist, p)} AS w FROM range(0, {rows}) a(i), range(0, {D}) b(j)) c LEFT JOIN {_sub_sql(f'sub{k}', str(rows), D, sub, seed)} s ON c.i = s.i AND c.j = s.j GROUP BY c.i)"
        joins += f" JOIN {cells} w{k} ON w{k}.i = o.i"
    return f"(SELECT id, o.i, ({scale}) * {product} / sqrt({rows}e0) AS z FROM {source} s, (SELECT i, {order} AS n FROM range(0, {rows}) r(i)) o{joins})"


_POLY = kernels.maclaurin_coefficients("poly", 3, bias=0.5)
_EXP = kernels.maclaurin_coefficients("exp", gamma=1 / D, max_expansion=6)
_map("map_maclaurin_poly", lambda: maps.RandomMaclaurin(16, degree=3, bias=0.5, seed=SEED), emb, D, _maclaurin(_POLY, 3))
_map("map_maclaurin_exp", lambda: maps.RandomMaclaurin(16, kernel="exp", max_expansion=6, seed=SEED), emb, D, _maclaurin(_EXP, 6))
_H01 = f"(SELECT id, 0 AS i, sqrt({float(_POLY[0])!r}e0) AS z FROM {EMB} UNION ALL SELECT id, unnest(range(1, {D + 1})), unnest(x) * sqrt({float(_POLY[1])!r}e0) FROM {EMB} UNION ALL SELECT id, i + {D + 1}, z FROM {_maclaurin(_POLY, 3, skip=True)})"
_map("map_maclaurin_h01", lambda: maps.RandomMaclaurin(16, degree=3, bias=0.5, h01=True, seed=SEED), emb, D, _H01)
_map("map_subfeature_maclaurin", lambda: maps.SubfeatureRandomMaclaurin(16, 5, degree=3, bias=0.5, seed=SEED), emb, D, _maclaurin(_POLY, 3, sub=5))
_BUCKET = lambda row, n: f"least(CAST(floor({rng.sql_uniform(SEED, 'hash', str(row), 'j')} * {n}) AS BIGINT), {n - 1})"
_HASH = lambda row, d, n: f"(SELECT j, {_BUCKET(row, n)} AS h, {rng.sql_cell(SEED, 'sign', str(row), 'j')} AS s FROM range(0, {d}) b(j))"
_XJ = lambda source: f"(SELECT id, unnest(range(0, len(x))) AS j, unnest(x) AS v FROM {source})"
_TS = f"(SELECT a.id, (h1.h + h2.h) % 16 AS i, sum(h1.s * h2.s * a.v * b.v) AS z FROM {_XJ(EMB)} a JOIN {_XJ(EMB)} b ON a.id = b.id JOIN {_HASH(0, D, 16)} h1 ON a.j = h1.j JOIN {_HASH(1, D, 16)} h2 ON b.j = h2.j GROUP BY a.id, (h1.h + h2.h) % 16)"
_FILL = lambda inner, source, n: f"(SELECT e.id, e.i, coalesce(z, 0e0) AS z FROM (SELECT id, unnest(range(0, {n})) AS i FROM {source}) e LEFT JOIN {inner} f ON e.id = f.id AND e.i = f.i)"
_map("map_tensor_sketch2", lambda: maps.TensorSketch(16, 2, SEED), emb, D, _FILL(_TS, EMB, 16))
_CS = f"(SELECT id, h AS i, sum(s * v) AS z FROM {_XJ(EMB)} a JOIN {_HASH(0, 64, 16)} h ON a.j = h.j GROUP BY id, h)"
_map("map_count_sketch", lambda: maps.CountSketch(16, SEED), emb, 64, _FILL(_CS, EMB, 16))


def _sketch_tokens(spark, sf):
    z = maps.CountSketch(16, SEED).fit(64).sketch_coo(tokens(spark, sf), "id")
    return z.select("id", F.col("i").cast("long").alias("i"), _r(F.col("z")).alias("z"))


_add("map_count_sketch_sparse", _sketch_tokens, _out(f"(SELECT id, h AS i, sum(s * v) AS z FROM {_TOK} a JOIN {_HASH(0, 64, 16)} h ON a.j = h.j GROUP BY id, h)"))
_map("map_random_projection", lambda: maps.RandomProjection(16, seed=SEED), emb, 64, f"(SELECT id, i, p / 4e0 AS z FROM {_project(EMB, _cells('w', '16', 64))})")
_map("map_sparse_random_projection", lambda: maps.RandomProjection(16, "sparse_rademacher", seed=SEED), emb, 64, f"(SELECT id, i, p / 4e0 AS z FROM {_project(EMB, _cells('w', '16', 64, 'sparse_rademacher', 1 - 1 / 8))})")


def sparse_tokens(spark, sf) -> DataFrame:
    """The word counts as sparse structs."""
    return from_coo(tokens(spark, sf), "id", 64)


_TOKX = f"(SELECT id, list(v ORDER BY j) AS x FROM (SELECT e.id, e.j, coalesce(v, 0e0) AS v FROM (SELECT id, j FROM (SELECT DISTINCT id FROM {_TOK}) a, range(0, 64) r(j)) e LEFT JOIN {_TOK} t ON e.id = t.id AND e.j = t.j) GROUP BY id)"


def _sparse_map(name: str, make, sql: str) -> None:
    """Sparse rows in, the non-zero cells of sparse rows out."""

    def query(spark, sf):
        z = make().fit(64).transform(sparse_tokens(spark, sf), dense_output=False)
        cells = z.select("id", F.explode(F.arrays_zip(F.col("z.indices").alias("i"), F.col("z.values").alias("v"))).alias("e"))
        return cells.select("id", F.col("e.i").cast("long").alias("i"), _r(F.col("e.v")).alias("z")).where("z <> 0")  # sums that cancel need not be zero to the last bit

    _add(name, query, _out(f"(SELECT * FROM {sql} WHERE round(z, 6) <> 0)"))


_WS = _cells("w", "16", 64, "sparse_rademacher", 0.75)
_sparse_map("map_random_kernel_sparse", lambda: maps.RandomKernel(16, distribution="sparse_rademacher", p_sparse=0.75, seed=SEED), f"(SELECT id, i, {_RK2} / 4e0 AS z FROM {_TOKX} s, {_WS} m)")
_sparse_map("map_subfeature_kernel_sparse", lambda: maps.SubfeatureRandomKernel(16, 5, seed=SEED), f"(SELECT id, i, {_RK2} / 4e0 * sqrt(2016e0 / 10e0) AS z FROM {_TOKX} s, {_SUBW} m)")
_sparse_map("map_maclaurin_sparse", lambda: maps.RandomMaclaurin(16, degree=2, distribution="sparse_rademacher", p_sparse=0.75, seed=SEED), _maclaurin(kernels.maclaurin_coefficients("poly", 2), 2, _TOKX, dist="sparse_rademacher", p=0.75))
_sparse_map("map_subfeature_maclaurin_sparse", lambda: maps.SubfeatureRandomMaclaurin(16, 5, degree=2, seed=SEED), _maclaurin(kernels.maclaurin_coefficients("poly", 2), 2, _TOKX, sub=5))


def _anova_sparse(spark, sf):
    return _totals(sparse_tokens(spark, sf), 2)


_add("kernel_anova_sparse", _anova_sparse, f"SELECT i, count(*) AS n_rows, round(sum(k), 6) + 0.0 AS total FROM (SELECT i, (d * d - q) / 2 AS k FROM (SELECT a.id AS i, b.id AS p, sum(a.v * b.v) AS d, sum(a.v * a.v * b.v * b.v) AS q FROM {_TOK} a JOIN {_TOK} b ON a.j = b.j WHERE a.id % 20 = 0 GROUP BY a.id, b.id)) WHERE k <> 0 GROUP BY i")


def _sparse_input(spark, sf):
    """The same map on sparse structs."""
    m = maps.RandomProjection(16, seed=SEED).fit(64)
    return _long(m.transform(to_sparse(emb(spark, sf), "id")).select("id", "z"))


_add("map_sparse_input", _sparse_input, _out(f"(SELECT id, i, p / 4e0 AS z FROM {_project(EMB, _cells('w', '16', 64))})"))
_SRHT_ROWS = f"(SELECT n, j FROM (SELECT j, row_number() OVER (ORDER BY {rng.sql_uniform(SEED, 'perm', '0', 'j')}) - 1 AS n FROM range(0, 64) b(j)) WHERE n < 16)"
_map(
    "map_srht", lambda: maps.SubsampledRandomHadamard(16, seed=SEED), emb, 64,
    f"(SELECT id, n AS i, 2e0 * list_sum(list_transform(range(0, 64), lambda c: x[c + 1] * w[c + 1] * (1 - 2 * (bit_count(CAST(j & c AS BIGINT)) % 2)))) / 8e0 AS z FROM {EMB} s, (SELECT {_one('w', 64)} AS w) m, {_SRHT_ROWS} r)",
)
_UP = f"(SELECT id, list(z ORDER BY i) AS x FROM {_maclaurin([0, 0, 1.0], 2, rows=20)} GROUP BY id)"
_map("map_compact", lambda: maps.CompactRandomFeature(n_components=8, n_components_up=20, seed=SEED), emb, D, f"(SELECT id, i, p / sqrt(8e0) AS z FROM {_project(_UP, _cells('w', '8', 20, seed=SEED + 1))})")
_UP_ROWS = f"(SELECT n, j FROM (SELECT j, row_number() OVER (ORDER BY {rng.sql_uniform(SEED + 1, 'perm', '0', 'j')}) - 1 AS n FROM range(0, 32) b(j)) WHERE n < 8)"
_map(
    "map_compact_srht", lambda: maps.CompactRandomFeature(down="srht", n_components=8, n_components_up=20, seed=SEED), emb, D,
    f"(SELECT id, n AS i, list_sum(list_transform(range(0, 20), lambda c: x[c + 1] * w[c + 1] * (1 - 2 * (bit_count(CAST(j & c AS BIGINT)) % 2)))) / sqrt(8e0) AS z FROM {_UP} s, (SELECT {_one('w', 20, seed=SEED + 1)} AS w) m, {_UP_ROWS} r)",
)
_UNIT_EXP = f"(SELECT id, list_transform(x, lambda v: exp(-v)) AS x FROM {UNIT})"
_TS3 = f"(SELECT a.id, (h1.h + h2.h + h3.h) % 16 AS i, sum(h1.s * h2.s * h3.s * a.v * b.v * c.v) AS z FROM {_XJ(_UNIT_EXP)} a JOIN {_XJ(_UNIT_EXP)} b ON a.id = b.id JOIN {_XJ(_UNIT_EXP)} c ON a.id = c.id JOIN {_HASH(0, 4, 16)} h1 ON a.j = h1.j JOIN {_HASH(1, 4, 16)} h2 ON b.j = h2.j JOIN {_HASH(2, 4, 16)} h3 ON c.j = h3.j GROUP BY a.id, (h1.h + h2.h + h3.h) % 16)"


def unit_exp(spark, sf) -> DataFrame:
    """exp(-v) of the parts' numbers: products of plain fractions can be ties of rounding."""
    return unit(spark, sf).select("id", F.transform("features", lambda v: F.exp(-v)).alias("features"))


_map("map_tensor_sketch3", lambda: maps.TensorSketch(16, 3, SEED), unit_exp, 4, _FILL(_TS3, UNIT, 16))
_MB = f"(SELECT id, j * 8 + k AS i, greatest(least(8e0 * v - k, 1e0), 0e0) / sqrt(8e0) AS z FROM {_XJ(UNIT)} a, range(0, 8) g(k))"
_map("map_mb", lambda: maps.MB(32), unit, 4, _MB)


def _mb_native(spark, sf):
    return _long(unit(spark, sf).withColumn("z", maps.MB(32).fit(4).expression()))


_add("map_mb_native", _mb_native, _out(_MB))
_SMB = f"(SELECT id, j * 8 + k AS i, CASE WHEN k = c THEN 8e0 * v - c WHEN k = c - 1 THEN 1e0 - (8e0 * v - c) ELSE 0e0 END AS z FROM (SELECT *, least(CAST(floor(8e0 * v) AS BIGINT), 7) AS c FROM {_XJ(UNIT)}) a, range(0, 8) g(k))"
_map("map_sparse_mb", lambda: maps.SparseMB(32), unit, 4, _SMB)


def _smb_native(spark, sf):
    return maps.SparseMB(32).fit(4).sparse(unit(spark, sf), "id").select("id", F.col("i").cast("long").alias("i"), _r(F.col("z")).alias("z"))


_add("map_sparse_mb_native", _smb_native, _out(f"(SELECT * FROM {_SMB} WHERE z <> 0)"))
_CHI = lambda f, k: f"(SELECT id, j + 4 * {k} AS i, CASE WHEN v > 0 THEN sqrt(2 * v * 0.5e0 / cosh(pi() * 0.5e0)) * {f}(0.5e0 * ln(v)) ELSE 0e0 END AS z FROM {_XJ(UNIT)})"
_map("map_additive_chi2", lambda: maps.AdditiveChi2Sampler(2), unit, 4, f"(SELECT id, j AS i, sqrt(v * 0.5e0) AS z FROM {_XJ(UNIT)} UNION ALL SELECT * FROM {_CHI('cos', 1)} UNION ALL SELECT * FROM {_CHI('sin', 2)})")
_STEP = lambda f, k, n: f"(SELECT id, j + 4 * {k} AS i, CASE WHEN v > 0 THEN sqrt(2 * v * 0.4e0 / cosh(pi() * {n} * 0.4e0)) * {f}({n} * 0.4e0 * ln(v)) ELSE 0e0 END AS z FROM {_XJ(UNIT)})"
_map("map_additive_chi2_3", lambda: maps.AdditiveChi2Sampler(3), unit, 4, f"(SELECT id, j AS i, sqrt(v * 0.4e0) AS z FROM {_XJ(UNIT)} UNION ALL SELECT * FROM {_STEP('cos', 1, 1)} UNION ALL SELECT * FROM {_STEP('sin', 2, 1)} UNION ALL SELECT * FROM {_STEP('cos', 3, 2)} UNION ALL SELECT * FROM {_STEP('sin', 4, 2)})")
_map("map_additive_chi2_1", lambda: maps.AdditiveChi2Sampler(1), unit, 4, f"(SELECT id, j AS i, sqrt(v * 0.8e0) AS z FROM {_XJ(UNIT)})")
_SKW = f"(SELECT i, list(w ORDER BY j) AS w FROM (SELECT i, j, ln(tan(pi() / 2e0 * {rng.sql_uniform(SEED, 'w', 'i', 'j')})) / pi() AS w FROM range(0, 16) a(i), range(0, 4) b(j)) GROUP BY i)"
_map("map_skewed_chi2", lambda: maps.SkewedChi2Sampler(16, 0.5, SEED), unit, 4, f"(SELECT id, i, sqrt(2e0 / 16) * cos(list_dot_product(list_transform(x, lambda v: ln(v + 0.5e0)), w) + 2e0 * pi() * {rng.sql_uniform(SEED, 'offset', '0', 'i')}) AS z FROM {UNIT} s, {_SKW} m)")


class _Doubly(maps.FeatureMap):
    def __init__(self, source, bases):
        super().__init__(bases)
        self.source = source

    def _draw(self):
        self.base = doubly(self.source, self.d)
        self.width = self.base.width(self.n_components)

    def apply(self, x):
        return self.base.apply(x, self.n_components, step=5)


_PAIRS = f"(SELECT id, 2 * i AS i, sqrt(2e0) * cos(p) / sqrt(16e0) AS z FROM {_project(EMB, _cells('w', '8', 64, 'gaussian'))} UNION ALL SELECT id, 2 * i + 1, sqrt(2e0) * sin(p) / sqrt(16e0) FROM {_project(EMB, _cells('w', '8', 64, 'gaussian'))})"
_map("doubly_map_fourier", lambda: _Doubly(maps.RBFSampler(16, 0.5, SEED), 16), emb, 64, _fourier(_project(EMB, _G), 16, 0.5, True))
_map("doubly_map_fourier_cossin", lambda: _Doubly(maps.RandomFourier(16, 0.5, False, SEED), 8), emb, 64, _PAIRS)
_map("doubly_map_random_kernel", lambda: _Doubly(maps.RandomKernel(16, seed=SEED), 16), emb, D, f"(SELECT id, i, {_RK2} / 4e0 AS z FROM {EMB} s, {_W64} m)")
_map("doubly_map_maclaurin", lambda: _Doubly(maps.RandomMaclaurin(16, degree=3, bias=0.5, seed=SEED), 16), emb, D, _maclaurin(_POLY, 3))
_map("doubly_map_skewed_chi2", lambda: _Doubly(maps.SkewedChi2Sampler(16, 0.5, SEED), 16), unit, 4, f"(SELECT id, i, sqrt(2e0 / 16) * cos(list_dot_product(list_transform(x, lambda v: ln(v + 0.5e0)), w) + 2e0 * pi() * {rng.sql_uniform(SEED, 'offset', '0', 'i')}) AS z FROM {UNIT} s, {_SKW} m)")

# approximation error ------------------------------------------------------------


def _error(spark, sf, loss="l1"):
    m = maps.RandomFourier(16, 0.5, True, SEED).fit(64)
    e = gram_ops.approximation_error(m.transform(emb(spark, sf)), "id", "features", "z", "rbf", loss, gamma=0.5)
    return e.select(*(_r(F.col(c), 5 if c != "total_loss" else 3).alias(c) for c in e.columns))


_ZL = f"(SELECT id, list(z ORDER BY i) AS z FROM {_fourier(_project(EMB, _G), 16, 0.5, True)} GROUP BY id)"


def _error_sql(loss: str) -> str:
    e = f"SELECT exp(-0.5e0 * list_sum(list_transform(range(1, 65), lambda t: (a.x[t] - b.x[t]) ** 2))) - list_dot_product(za.z, zb.z) AS e FROM v a JOIN zl za ON a.id = za.id, v b JOIN zl zb ON b.id = zb.id WHERE a.id <= b.id"
    value = "abs(e)" if loss == "l1" else "e * e"
    return f"WITH v AS {EMB}, zl AS {_ZL} SELECT round(avg({value}), 5) + 0.0 AS mean_loss, round(sum({value}), 3) + 0.0 AS total_loss, round(max({value}), 5) + 0.0 AS max_loss FROM ({e})"


_add("rbf_approximation_error", _error, _error_sql("l1"))
_add("rbf_approximation_error_l2", lambda s, sf: _error(s, sf, "l2"), _error_sql("l2"))

# losses -------------------------------------------------------------------------

_MARGIN = f"(SELECT id, y, list_dot_product(x, {_one('loss', D, 'gaussian')}) * 3e0 AS p FROM {BIN})"


def _margins(spark, sf) -> DataFrame:
    w = F.array(*(F.lit(float(v)) for v in rng.matrix(SEED, "loss", 1, D, "gaussian")[0]))
    return emb_bin(spark, sf).select("id", "y", (kernels.dot(F.col("features"), w) * 3.0).alias("p"))


_SIG = lambda v: f"(exp(least(0e0, {v})) / (1 + exp(-abs({v}))))"
_VALUE = {"squared": "0.5e0 * (p - y) ** 2", "logistic": "ln(1 + exp(-y * p))", "squared_hinge": "greatest(1 - p * y, 0) ** 2", "hinge": "greatest(1 - p * y, 0)"}
_GRAD = {"squared": "p - y", "logistic": f"-y * {_SIG('-p * y')}", "squared_hinge": "-2 * y * greatest(1 - p * y, 0)", "hinge": "CASE WHEN p * y < 1 THEN -y ELSE 0e0 END"}
_four = ("squared", "logistic", "squared_hinge", "hinge")
_add("loss_values", lambda s, sf: _margins(s, sf).select("id", *(_r(LOSSES[k].value_column(F.col("p"), F.col("y"))).alias(k) for k in _four)), f"SELECT id, {', '.join(f'round({_VALUE[k]}, 6) + 0.0 AS {k}' for k in _four)} FROM {_MARGIN}")
_add("loss_gradients", lambda s, sf: _margins(s, sf).select("id", *(_r(LOSSES[k].dloss_column(F.col("p"), F.col("y"))).alias(k) for k in _four)), f"SELECT id, {', '.join(f'round({_GRAD[k]}, 6) + 0.0 AS {k}' for k in _four)} FROM {_MARGIN}")


def _duals(spark, sf, what):
    """Conjugates and dual steps of a dual value -y sigmoid(p), batch by batch."""
    rows = _margins(spark, sf)
    names = ["id", *_four]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            y, p = b.column(1).to_numpy(), b.column(2).to_numpy()
            a = -y / (1 + np.exp(-p))
            out = [LOSSES[k].conjugate(a, y) if what == "conjugate" else LOSSES[k].sdca_update(-a, y, p, 0.7) for k in _four]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.asarray(v, float)) for v in out)], names)

    return rows.mapInArrow(run, "id long, " + ", ".join(f"{k} double" for k in _four)).select("id", *(_r(F.col(k)).alias(k) for k in _four))


_DUAL = f"(SELECT id, y, p, y * (1 / (1 + exp(-p))) AS a FROM {_MARGIN})"
_CONJ = {"squared": "-a * y + 0.5e0 * a * a", "logistic": "a * y * ln(a * y) + (1 - a * y) * ln(1 - a * y)", "squared_hinge": "-a * y + 0.25e0 * a * a", "hinge": "-a * y"}
_SH = "((y - p - 0.5e0 * a) / 1.2e0)"
_STEP = {"squared": "(y - a - p) / 1.7e0", "logistic": f"(y * {_SIG('-p * y')} - a) / greatest(1, 0.95e0)", "squared_hinge": f"CASE WHEN y * (a + {_SH}) < 0 THEN -a ELSE {_SH} END", "hinge": "y * least(greatest((1 - p * y) / 0.7e0 + a * y, 0), 1) - a"}
_add("loss_conjugates", lambda s, sf: _duals(s, sf, "conjugate"), f"SELECT id, {', '.join(f'round({_CONJ[k]}, 6) + 0.0 AS {k}' for k in _four)} FROM {_DUAL}")
_add("sdca_steps", lambda s, sf: _duals(s, sf, "step"), f"SELECT id, {', '.join(f'round({_STEP[k]}, 6) + 0.0 AS {k}' for k in _four)} FROM {_DUAL}")

# learned weights ----------------------------------------------------------------


def _lkrf(spark, sf, divergence: str, alpha=None, what="p", digits: int = 6, **more):
    m = lkrf.LearnedKernel(maps.RandomFourier(16, 0.5, True, SEED), divergence, alpha=alpha, **more).fit_frame(emb_bin(spark, sf))
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(getattr(m, what))], "j long, v double").select("j", _r(F.col("v"), digits).alias(what))


_Z64 = _fourier(_project(EMB, _cells("w", "16", D, "gaussian")), 16, 0.5, True)
_STAT = f"(SELECT i AS j, s * s / max(s * s) OVER () AS v FROM (SELECT z.i, sum(b.y * z.z) AS s FROM {_Z64} z JOIN {BIN} b ON z.id = b.id GROUP BY z.i))"


def _simplex(v: str, total: str) -> str:
    """Projection of (j, v) on {p >= 0, sum p = total} by a running sum over the sorted values."""
    return f"(SELECT j, greatest(v - (SELECT max(CASE WHEN v > (c - {total}) / n THEN struct_pack(n := n, t := (c - {total}) / n) END).t FROM (SELECT v, row_number() OVER (ORDER BY v DESC) AS n, sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS c FROM {v})), 0) AS p FROM {v})"


_add("lkrf_statistic", lambda s, sf: _lkrf(s, sf, "kl", 0.5, "statistic"), f"SELECT CAST(j AS BIGINT) AS j, round(v, 6) + 0.0 AS statistic FROM {_STAT}")
_add("lkrf_kl", lambda s, sf: _lkrf(s, sf, "kl", 0.5), f"SELECT CAST(j AS BIGINT) AS j, round(exp(v / 0.5e0) / sum(exp(v / 0.5e0)) OVER (), 6) + 0.0 AS p FROM {_STAT}")
_add("lkrf_chi2", lambda s, sf: _lkrf(s, sf, "chi2", 0.01), f"SELECT CAST(j AS BIGINT) AS j, round(p / 0.32e0, 6) + 0.0 AS p FROM {_simplex(_STAT, '0.32e0')}")
_SHIFT = f"(SELECT j, v + 4e0 / 256 AS v FROM {_STAT})"
_add("lkrf_squared", lambda s, sf: _lkrf(s, sf, "squared", 4.0), f"SELECT CAST(j AS BIGINT) AS j, round(p / 0.25e0, 6) + 0.0 AS p FROM {_simplex(_SHIFT, '0.25e0')}")
_add("lkrf_chi2_origin", lambda s, sf: _lkrf(s, sf, "chi2_origin", 0.05), f"SELECT CAST(j AS BIGINT) AS j, round(p, 6) + 0.0 AS p FROM {_simplex(f'(SELECT j, v / 0.8e0 AS v FROM {_STAT})', '1e0')}")
# the optimum in closed form: mass moves to the best base from those that fall short of it by more than the price
_exact = dict(digits=4, max_iter=100, eps_abs=1e-10, eps_rel=1e-10)
_add("lkrf_tv", lambda s, sf: _lkrf(s, sf, "tv", 0.5, **_exact), f"SELECT CAST(j AS BIGINT) AS j, round(CASE WHEN v = 1 THEN 1 - sum(q) OVER () ELSE q END, 4) + 0.0 AS p FROM (SELECT j, v, CASE WHEN v = 1 THEN 0e0 WHEN v < 0.5e0 THEN 0e0 ELSE 1 / 16e0 END AS q FROM {_STAT})")
# p = (a / n) / (m - v) with m from bisection, so that the sum is one
_RKL = f"WITH RECURSIVE st AS MATERIALIZED {_STAT}, b AS (SELECT 0 AS t, 1e0 AS lo, 2e0 AS hi UNION ALL SELECT t + 1, CASE WHEN s > 1 THEN mid ELSE lo END, CASE WHEN s > 1 THEN hi ELSE mid END FROM (SELECT t, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, sum(0.05e0 / 16 / ((lo + hi) / 2 - v)) AS s FROM b, st WHERE t < 60 GROUP BY t))"
_add("lkrf_reverse_kl", lambda s, sf: _lkrf(s, sf, "reverse_kl", 0.05, **_exact), f"{_RKL} SELECT CAST(j AS BIGINT) AS j, round(0.05e0 / 16 / ((lo + hi) / 2 - v), 4) + 0.0 AS p FROM b, st WHERE t = 60")
# the dual search: the multiplier at which the divergence is the bound
_KLR = f"WITH RECURSIVE st AS MATERIALIZED {_STAT}, b AS (SELECT 0 AS t, 1e-3 AS lo, 1e3 AS hi UNION ALL SELECT t + 1, CASE WHEN kl > 0.5e0 THEN mid ELSE lo END, CASE WHEN kl > 0.5e0 THEN hi ELSE mid END FROM (SELECT t, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, sum(e * (v - 1) / mid) / sum(e) - ln(sum(e)) + ln(16) AS kl FROM (SELECT b.*, sqrt(lo * hi) AS mid, v, exp((v - 1) / sqrt(lo * hi)) AS e FROM b, st WHERE t < 100) GROUP BY t))"
_add("lkrf_dual_search", lambda s, sf: _lkrf(s, sf, "kl", None, rho=0.5), f"{_KLR} SELECT CAST(j AS BIGINT) AS j, round(exp((v - 1) / lo) / sum(exp((v - 1) / lo)) OVER (), 6) + 0.0 AS p FROM b, st WHERE t = 100")


def _kept_bases(spark, sf):
    """The map that is left when bases without weight are removed."""
    m = lkrf.LearnedKernel(maps.RandomFourier(16, 0.5, True, SEED), "chi2", alpha=0.01).fit_frame(emb_bin(spark, sf))
    m.remove_bases()
    return _long(m.transform(emb(spark, sf)))


_KEPT = f"(SELECT j, row_number() OVER (ORDER BY j) - 1 AS i, p / 0.32e0 AS p FROM {_simplex(_STAT, '0.32e0')} WHERE p > 0)"
_add("lkrf_removed_bases", _kept_bases, _out(f"(SELECT z.id, k.i, z.z * 4e0 * sqrt(k.p) AS z FROM {_Z64} z JOIN {_KEPT} k ON z.i = k.j)"))

# solvers ------------------------------------------------------------------------

_STEPS, _ETA, _ALPHA, _DECAY = 5, 0.5, 0.01, 0.1


def _fit(spark, sf, estimator, **params):
    df = emb_bin(spark, sf).withColumnRenamed("y", "label")
    model = estimator(transformer=maps.RandomFourier(8, 0.5, True, SEED), max_iter=_STEPS, tol=0.0, alpha=_ALPHA, intercept_decay=_DECAY, seed=SEED, **params).fit(df)
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate([*model.coef_, model.intercept_])], "j long, v double").select("j", _r(F.col("v")).alias("coef"))


_ZT = f"(SELECT z.id, b.y, list_append(list(z.z ORDER BY z.i), 1e0) AS z FROM {_fourier(_project(EMB, _cells('w', '8', D, 'gaussian')), 8, 0.5, True)} z JOIN {BIN} b ON z.id = b.id GROUP BY z.id, b.y)"


def _recursive(loss: str, state: str, update: str, steps: int = _STEPS, where: str = "true") -> str:
    """Full-batch steps, over the rows that ``where`` names, as a recursive query over a state of lists."""
    names = re.findall(r" AS (\w+)", state)
    grad = "[" + ", ".join(f"avg(dl * z[{k}])" for k in range(1, 10)) + "]"
    keep = ", ".join(f"any_value({n}) AS {n}" for n in names)
    inner = f"SELECT t, {keep}, {grad} AS g FROM (SELECT *, {_GRAD[loss]} AS dl FROM (SELECT s.*, zt.z, zt.y, list_dot_product(zt.z, s.w) AS p FROM gd s, zt WHERE s.t <= {steps} AND {where})) GROUP BY t"
    return f"WITH RECURSIVE zt AS MATERIALIZED {_ZT}, gd AS (SELECT 1 AS t, {state} UNION ALL SELECT t + 1, {update} FROM ({inner})) SELECT CAST(unnest(range(0, 9)) AS BIGINT) AS j, round(unnest(w), 6) + 0.0 AS coef FROM gd WHERE t = {steps + 1}"


_ZERO = "list_transform(range(0, 9), lambda k: 0e0)"
_each = lambda body: f"list_transform(range(1, 10), lambda k: {body})"
_LAM = f"(CASE WHEN k < 10 - 1 THEN {_ALPHA} ELSE {_DECAY} END)"
_RATE = f"({_ETA} / (1 + {_ETA} * {_ALPHA} * t) ** 0.75e0)"
for _loss in _four:
    _est = linear.SGDRegressor if _loss == "squared" else linear.SGDClassifier
    _add(f"sgd_fullbatch_{_loss}", lambda s, sf, e=_est, k=_loss: _fit(s, sf, e, loss=k, mode="full_batch", eta0=_ETA, average=0), _recursive(_loss, f"{_ZERO} AS w", _each(f"w[k] - {_RATE} * (g[k] + {_LAM} * w[k])")))
_add(
    "adagrad_fullbatch", lambda s, sf: _fit(s, sf, linear.AdaGradClassifier, loss="logistic", mode="full_batch", eta0=_ETA),
    _recursive("logistic", f"{_ZERO} AS w, {_ZERO} AS g1, {_ZERO} AS g2", f"{_each(f'-{_ETA} * t * ((g1[k] + g[k]) / t) / (sqrt(g2[k] + g[k] * g[k]) + 0.0001e0 + {_LAM} * {_ETA} * t)')}, {_each('g1[k] + g[k]')}, {_each('g2[k] + g[k] * g[k]')}"),
)
_FULL = f"(g[k] + {_LAM} * w[k])"
_add(
    "adam_fullbatch", lambda s, sf: _fit(s, sf, linear.AdamClassifier, loss="logistic", mode="full_batch", eta0=_ETA),
    _recursive(
        "logistic", f"{_ZERO} AS w, {_ZERO} AS m, {_ZERO} AS v",
        f"{_each(f'w[k] - {_ETA} * ((0.9e0 * m[k] + 0.1e0 * {_FULL}) / (1 - 0.9e0 ** t)) / (sqrt((0.999e0 * v[k] + 0.001e0 * {_FULL} * {_FULL}) / (1 - 0.999e0 ** t)) + 1e-8)')}, {_each(f'0.9e0 * m[k] + 0.1e0 * {_FULL}')}, {_each(f'0.999e0 * v[k] + 0.001e0 * {_FULL} * {_FULL}')}",
    ),
)
# every partition takes one step with its mean gradient, and the mean of the states by rows is the step of all rows
_add("sgd_distributed", lambda s, sf: _fit(s, sf, linear.SGDClassifier, loss="logistic", eta0=_ETA, average=0, step_rows=1 << 40), ORACLES["sgd_fullbatch_logistic"])
_SOFT = lambda v, t: f"(sign({v}) * greatest(abs({v}) - {t}, 0))"
_L1W = f"(w[k] - {_RATE.replace(str(_ALPHA), '0.005e0')} * (g[k] + (CASE WHEN k < 9 THEN 0.005e0 ELSE {_DECAY} END) * w[k]))"
_add("sgd_fullbatch_l1", lambda s, sf: _fit(s, sf, linear.SGDClassifier, loss="logistic", mode="full_batch", eta0=_ETA, average=0, l1_ratio=0.5), _recursive("logistic", f"{_ZERO} AS w", _each(f"CASE WHEN k < 9 THEN {_SOFT(_L1W, '0.005e0 * ' + _RATE.replace(str(_ALPHA), '0.005e0'))} ELSE {_L1W} END")))


def _objectives(spark, sf):
    """Loss and penalty of the weights that each epoch starts from."""
    df = emb_bin(spark, sf).withColumnRenamed("y", "label")
    m = linear.SGDClassifier(transformer=maps.RandomFourier(8, 0.5, True, SEED), loss="logistic", mode="full_batch", max_iter=_STEPS, tol=0.0, alpha=_ALPHA, intercept_decay=_DECAY, eta0=_ETA, average=0).fit(df)
    return spark.createDataFrame([(t + 1, float(a), float(b)) for t, (a, b) in enumerate(zip(m.history, m.objectives))], "t long, loss double, objective double").select("t", _r(F.col("loss")).alias("loss"), _r(F.col("objective")).alias("objective"))


_PATH = _recursive("logistic", f"{_ZERO} AS w", _each(f"w[k] - {_RATE} * (g[k] + {_LAM} * w[k])")).rsplit("SELECT CAST(unnest", 1)[0]
_add("fit_objectives", _objectives, f"{_PATH} SELECT CAST(t AS BIGINT) AS t, round(avg({_VALUE['logistic']}), 6) + 0.0 AS loss, round(avg({_VALUE['logistic']}) + any_value(pen), 6) + 0.0 AS objective FROM (SELECT t, y, list_dot_product(z, w) AS p, 0.5e0 * ({_ALPHA} * (list_dot_product(w, w) - w[9] * w[9]) + {_DECAY} * w[9] * w[9]) AS pen FROM gd, zt WHERE t <= {_STEPS}) GROUP BY t")


def _row_by_row(loss: str, state: str, update: str, last: str = "w") -> str:
    """Single-row steps in the order of a digest as a recursive query over a state of lists; r is the row's number."""
    rows = f"(SELECT *, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM {_ZT})"
    order = f"(SELECT row_number() OVER (ORDER BY e, md5('{SEED}|' || e || '|' || id), id) AS k0, id, r, n, y, z FROM zt, range(0, {_STEPS}) q(e))"
    step = f"SELECT *, {_GRAD[loss]} AS dl FROM (SELECT s.*, o.z, o.y, o.r, o.n, list_dot_product(o.z, s.w) AS p FROM gd s JOIN o ON o.k0 = s.t)"
    return f"WITH RECURSIVE zt AS MATERIALIZED {rows}, o AS MATERIALIZED {order}, gd AS (SELECT CAST(1 AS BIGINT) AS t, {state} UNION ALL SELECT t + 1, {update} FROM ({step})) SELECT CAST(unnest(range(0, 9)) AS BIGINT) AS j, round(unnest({last}), 6) + 0.0 AS coef FROM gd WHERE t = (SELECT max(t) FROM gd)"


_R1 = f"(0.1e0 / (1 + 0.1e0 * {_ALPHA} * t) ** 0.75e0)"
_W1 = f"(w[k] - {_R1} * (dl * z[k] + {_LAM} * w[k]))"
_add("sgd_sequential", lambda s, sf: _fit(s, sf, linear.SGDClassifier, loss="logistic", mode="sequential", eta0=0.1), _row_by_row("logistic", f"{_ZERO} AS w, {_ZERO} AS mean", f"{_each(_W1)}, {_each(f'mean[k] + ({_W1} - mean[k]) / t')}", "mean"))
_R2 = f"(0.1e0 / (1 + 0.1e0 * {_ALPHA} * t))"
_NONE = "(SELECT list(0e0) FROM zt)"
_put = lambda value: f"list_transform(range(1, n + 1), lambda q: CASE WHEN q = r THEN {value} ELSE m[q] END)"
_add(
    "saga_fit", lambda s, sf: _fit(s, sf, linear.SAGAClassifier, loss="logistic", mode="sequential", eta0=0.1),
    _row_by_row("logistic", f"{_ZERO} AS w, {_ZERO} AS mean, {_NONE} AS m", f"{_each(f'w[k] - {_R2} * ((dl - m[r]) * z[k] + mean[k] + {_LAM} * w[k])')}, {_each('mean[k] + (dl - m[r]) * z[k] / n')}, {_put('dl')}"),
)
# u in place of w; the intercept is a feature of weight sqrt(l2 / decay)
_V9 = f"(CASE WHEN k < 9 THEN z[k] ELSE sqrt({_ALPHA} / {_DECAY}) END)"
_VV = f"(list_dot_product(z, z) - 1 + {_ALPHA} / {_DECAY})"
_PV = f"(p + (sqrt({_ALPHA} / {_DECAY}) - 1) * w[9])"
_S0 = f"((y - {_PV} - 0.5e0 * m[r]) / (0.5e0 + {_VV} / ({_ALPHA} * n)))"
_S1 = f"(CASE WHEN y * (m[r] + {_S0}) < 0 THEN -m[r] ELSE {_S0} END)"
_add(
    "sdca_fit", lambda s, sf: _fit(s, sf, linear.SDCAClassifier, loss="squared_hinge", mode="sequential"),
    _row_by_row("squared_hinge", f"{_ZERO} AS w, {_NONE} AS m", f"{_each(f'w[k] + {_S1} * {_V9} / ({_ALPHA} * n)')}, {_put(f'm[r] + {_S1}')}", f"list_transform(range(1, 10), lambda k: w[k] * CASE WHEN k < 9 THEN 1e0 ELSE sqrt({_ALPHA} / {_DECAY}) END)"),
)


def _doubly_model(spark, sf):
    df = emb_bin(spark, sf).withColumnRenamed("y", "label")
    n = df.count()
    return linear.DoublySGDClassifier(transformer=maps.RBFSampler(100, 0.5, SEED), loss="logistic", mode="sequential", max_iter=2, tol=0.0, batch_size=-(-n // 5), n_bases_sampled=8, seed=SEED).fit(df)


def _doubly_fit(spark, sf):
    model = _doubly_model(spark, sf)
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate([*model.coef_, model.intercept_])], "j long, v double").select("j", _r(F.col("v")).alias("coef"))


def _doubly_predict(spark, sf):
    return _doubly_model(spark, sf).decision_function(emb_bin(spark, sf)).select("id", _r(F.col("margin")).alias("margin"))


_DZ = f"(SELECT z.id, any_value(b.y) AS y, list(z.z * sqrt(80e0) ORDER BY z.i) AS z FROM {_fourier(_project(EMB, _cells('w', '80', D, 'gaussian')), 80, 0.5, True)} z JOIN {BIN} b ON z.id = b.id GROUP BY z.id)"
_DE = "(0.1e0 / (1 + 0.1e0 * 0.001e0 * t))"
_DG = "[" + ", ".join(f"avg(dl * z[{k}])" for k in range(1, 81)) + "]"
_DROWS = f"SELECT row_number() OVER (PARTITION BY e ORDER BY md5('{SEED}|' || e || '|' || id), id) - 1 AS pos, e, count(*) OVER (PARTITION BY e) AS n, y, z FROM dz, range(0, 2) q(e)"
_DSTEP = f"SELECT t, any_value(w) AS w, any_value(b) AS b, avg(dl) AS d, {_DG} AS g FROM (SELECT *, {_GRAD['logistic']} AS dl FROM (SELECT s.*, o.z, o.y, list_dot_product(o.z, s.w) + s.b AS p FROM gd s JOIN o ON o.e = (s.t - 1) // 5 AND o.pos >= least((s.t - 1) % 5 * ((n + 4) // 5), n - (n + 4) // 5) AND o.pos < least((s.t - 1) % 5 * ((n + 4) // 5), n - (n + 4) // 5) + (n + 4) // 5)) GROUP BY t"
_DMODEL = f"WITH RECURSIVE dz AS MATERIALIZED {_DZ}, o AS MATERIALIZED ({_DROWS}), gd AS (SELECT CAST(1 AS BIGINT) AS t, list_transform(range(0, 80), lambda k: 0e0) AS w, 0e0 AS b UNION ALL SELECT t + 1, list_transform(range(1, 81), lambda k: CASE WHEN k <= 8 * (t - 1) THEN (1 - {_DE} * 0.001e0) * w[k] WHEN k <= 8 * t THEN -{_DE} * g[k] ELSE 0e0 END), b - {_DE} * (d + 0.0001e0 * b) FROM ({_DSTEP}))"
_add("doubly_fit", _doubly_fit, f"{_DMODEL} SELECT CAST(unnest(range(0, 81)) AS BIGINT) AS j, round(unnest(list_append(w, b)), 6) + 0.0 AS coef FROM gd WHERE t = 11")
_add("predict_doubly", _doubly_predict, f"{_DMODEL} SELECT id, round(list_dot_product(z, w) + b, 6) + 0.0 AS margin FROM dz, gd WHERE t = 11")


def _sparse_mb_fit(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2200.0).alias("label"))
    model = linear.SparseMBRegressor(n_components=32, alpha=1.0).fit(unit(spark, sf).join(p, "id"))
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate([*model.coef_, model.intercept_])], "j long, v double").select("j", _r(F.col("v"), 4).alias("coef"))


# the minimum of the same quadratic, by conjugate gradients with the diagonal
_NZ = f"(SELECT id, i, z FROM {_SMB} WHERE z <> 0 UNION ALL SELECT p_partkey, 32, 1e0 FROM part)"
_HIJ = "(CASE WHEN c.i = 32 OR c.j = 32 THEN 0e0 WHEN c.i = c.j THEN (CASE WHEN c.i IN (0, 31) THEN 1.0001e0 ELSE 2.0001e0 END) WHEN abs(c.i - c.j) = 1 THEN -1e0 ELSE 0e0 END)"
_NPAIRS = "(SELECT p.i, q.i AS j, sum(p.z * q.z) AS v FROM nz p JOIN nz q ON p.id = q.id GROUP BY p.i, q.i)"
_NCELLS = f"(SELECT c.i, c.j, coalesce(s.v, 0e0) + {_HIJ} AS v FROM (SELECT i, j FROM range(0, 33) x(i), range(0, 33) y(j)) c LEFT JOIN {_NPAIRS} s ON c.i = s.i AND c.j = s.j)"
_NA = f"(SELECT list(r ORDER BY i) AS a, list(d ORDER BY i) AS diag FROM (SELECT i, list(v ORDER BY j) AS r, max(CASE WHEN i = j THEN v END) AS d FROM {_NCELLS} GROUP BY i))"
_NB = "(SELECT list(coalesce(v, 0e0) ORDER BY c.i) AS b FROM range(0, 33) c(i) LEFT JOIN (SELECT i, sum(z * p_retailprice / 2200e0) AS v FROM nz JOIN part ON id = p_partkey GROUP BY i) s ON c.i = s.i)"
_zip33 = lambda body: f"list_transform(range(1, 34), lambda k: {body})"
_CG = f"SELECT t, w, r, p, rz, q, rz / list_dot_product(p, q) AS s, diag FROM (SELECT cg.*, diag, list_transform(a, lambda x: list_dot_product(x, p)) AS q FROM cg, na WHERE t < 400 AND rz > 1e-24)"
_NEXT = f"SELECT t, rz, p, {_zip33('w[k] + s * p[k]')} AS w, {_zip33('r[k] - s * q[k]')} AS r, diag FROM ({_CG})"
_AGAIN = f"SELECT t + 1, w, r, {_zip33('r[k] / diag[k] + z2 / rz * p[k]')}, z2 FROM (SELECT *, list_dot_product(r, {_zip33('r[k] / diag[k]')}) AS z2 FROM ({_NEXT}))"
_add("sparse_mb_fit", _sparse_mb_fit, f"WITH RECURSIVE nz AS MATERIALIZED {_NZ}, na AS MATERIALIZED {_NA}, cg AS (SELECT 0 AS t, list_transform(b, lambda v: 0e0) AS w, b AS r, {_zip33('b[k] / diag[k]')} AS p, list_dot_product(b, {_zip33('b[k] / diag[k]')}) AS rz FROM {_NB}, na UNION ALL {_AGAIN}) SELECT CAST(unnest(range(0, 33)) AS BIGINT) AS j, round(unnest(w), 4) + 0.0 AS coef FROM cg WHERE t = (SELECT max(t) FROM cg)")

# serving ------------------------------------------------------------------------


class _Fixed:
    """A model of given weights, for serving queries."""

    def __init__(self):
        m = maps.RandomFourier(16, 0.5, True, SEED).fit(D)
        self.model = linear.SGDClassifier(loss="logistic")
        self.model.classes_ = [-1.0, 1.0]
        self.model.map_, self.model.mean_, self.model.std_ = m, None, None
        self.model.coef_, self.model.intercept_ = rng.matrix(SEED, "coef", 1, 16, "gaussian")[0], 0.1


_MZ = f"(SELECT z.id, any_value(b.y) AS y, sum(z.z * {rng.sql_cell(SEED, 'coef', '0', 'z.i', 'gaussian')}) + 0.1e0 AS m FROM {_Z64} z JOIN {BIN} b ON z.id = b.id GROUP BY z.id)"
_add("predict_margin", lambda s, sf: _Fixed().model.decision_function(emb_bin(s, sf)).select("id", _r(F.col("margin")).alias("margin")), f"SELECT id, round(m, 6) + 0.0 AS margin FROM {_MZ}")
_add("predict_label", lambda s, sf: _Fixed().model.predict(emb_bin(s, sf)).select("id", "prediction"), f"SELECT id, CASE WHEN m > 0 THEN 1e0 ELSE -1e0 END AS prediction FROM {_MZ}")
_add("predict_proba", lambda s, sf: _Fixed().model.predict_proba(emb_bin(s, sf)).select("id", _r(F.col("probability")).alias("probability")), f"SELECT id, round(1 / (1 + exp(-m)), 6) + 0.0 AS probability FROM {_MZ}")
_add("score_accuracy", lambda s, sf: _Fixed().model.predict(emb_bin(s, sf)).agg(_r(F.avg((F.col("y") == F.col("prediction")).cast("double"))).alias("accuracy")), f"SELECT round(avg(CASE WHEN (m > 0) = (y > 0) THEN 1e0 ELSE 0e0 END), 6) + 0.0 AS accuracy FROM {_MZ}")


def _score_r2(spark, sf):
    scored = _Fixed().model.decision_function(emb_bin(spark, sf))
    return spark.createDataFrame([(linear.r2(scored, "y", "margin"),)], "r2 double").select(_r(F.col("r2"), 5).alias("r2"))


_add("score_r2", _score_r2, f"SELECT round(1 - sum((y - m) ** 2) / sum((y - (SELECT avg(y) FROM {BIN})) ** 2), 5) + 0.0 AS r2 FROM {_MZ}")
_add("sigmoid", lambda s, sf: _margins(s, sf).select("id", _r(sigmoid_column(F.col("p"))).alias("s")), f"SELECT id, round(1 / (1 + exp(-p)), 6) + 0.0 AS s FROM {_MARGIN}")


def _standardise(spark, sf):
    df = emb(spark, sf)
    m = maps.RandomFourier(16, 0.5, True, SEED).fit(D)
    mean, std = linear.moments(df, m, "features")
    z = maps.map_batches(df, "features", "z", linear.Scorer(m, np.zeros(16), 0.0, mean, std), lambda s, x: s.z(x), maps.ArrayType(maps.DoubleType()))
    return _long(z)


_add("standardise", _standardise, _out(f"(SELECT id, i, (z - avg(z) OVER (PARTITION BY i)) / (1e-6 + stddev_samp(z) OVER (PARTITION BY i)) AS z FROM {_Z64})"))


def _sparse_round_trip(spark, sf):
    dense = to_dense(to_sparse(unit(spark, sf), "id"), "id")
    return to_coo(dense, "id").select("id", F.col("j").cast("long").alias("j"), _r(F.col("v")).alias("v"))


_add("sparse_round_trip", _sparse_round_trip, f"SELECT id, j, round(v, 6) + 0.0 AS v FROM {_XJ(UNIT)} WHERE v <> 0")

# rows, targets, small functions ---------------------------------------------------

_add("fetch_row", lambda s, sf: _long(row(emb(s, sf), "id", 40).withColumnRenamed("features", "z")), _out(f"(SELECT id, unnest(range(0, len(x))) AS i, unnest(x) AS z FROM {EMB} WHERE id = 40)"))
_add("fetch_feature", lambda s, sf: feature(emb(s, sf), "id", 17).select("id", _r(F.col("value")).alias("value")), f"SELECT id, round(x[18], 6) + 0.0 AS value FROM {EMB}")


def _validity(spark, sf):
    """Rows spoilt by a null, an infinity or a cell too few, by a rule of the id, and whether they are valid."""
    k = F.pmod("id", F.lit(5))
    spoilt = F.when(k == 0, F.array(F.lit(None).cast("double"))).when(k == 1, F.array(F.lit(float("inf")))).when(k == 2, F.array(F.lit(float("nan")))).when(k == 3, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
    return unit(spark, sf).select("id", valid(F.concat(F.slice("features", 1, 3), spoilt), 4).alias("ok"))


_add("valid_rows", _validity, "SELECT p_partkey AS id, p_partkey % 5 = 4 AS ok FROM part")
_add("target_classes", lambda s, sf: binary_target(read(s, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).alias("label")), "label").select("id", "y"), "SELECT vec_id AS id, CASE WHEN label < 5 THEN 1e0 ELSE -1e0 END AS y FROM embeddings")
_add("target_numbers", lambda s, sf: numeric_target(read(s, sf, "part"), "p_size").select(F.col("p_partkey").alias("id"), "y"), "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS y FROM part")

_GOOD = {"C": 1.0, "alpha": 0.1, "eta0": 0.5, "l1_ratio": 0.5, "tol": 0.0, "max_iter": 3, "beta1": 0.5}
_BAD = {"C": 0.0, "alpha": -1.0, "eta0": 0.0, "l1_ratio": 1.5, "tol": -1.0, "max_iter": 0, "beta1": 1.0}


def _checked_parameters(spark, sf):
    """Which values of parameters an estimator takes."""
    rows = []
    for good, values in ((True, _GOOD), (False, _BAD)):
        for name, value in values.items():
            try:
                linear.SGDClassifier(**{name: value})
                rows.append((name, good, True))
            except ValueError:
                rows.append((name, good, False))
    return spark.createDataFrame(rows, "name string, good boolean, taken boolean")


_add("checked_parameters", _checked_parameters, "SELECT name, good, good AS taken FROM (SELECT unnest(['" + "', '".join(_GOOD) + "']) AS name), (SELECT unnest([true, false]) AS good)")


def _rates(spark, sf):
    rows = [(k, t, float(linear.learning_rate(k, t, 0.5, 0.01, 0.75, 0.001))) for k in linear.RATES for t in range(1, 51)]
    return spark.createDataFrame(rows, "kind string, t long, eta double").select("kind", "t", _r(F.col("eta")).alias("eta"))


_add("learning_rates", _rates, "SELECT kind, t, round(CASE kind WHEN 'constant' THEN 0.5e0 WHEN 'pegasos' THEN 1 / (0.01e0 * t) WHEN 'inv_scaling' THEN 0.5e0 / t ** 0.75e0 WHEN 'optimal' THEN 0.5e0 / (1 + 0.005e0 * t) ** 0.75e0 ELSE 0.5e0 / (1 + 0.001e0 * t) END, 6) + 0.0 AS eta FROM (SELECT unnest(['constant', 'pegasos', 'inv_scaling', 'optimal', 'original']) AS kind), range(1, 51) r(t)")
_add("next_power_of_two", lambda s, sf: s.createDataFrame([(n, maps.next_power_of_two(n)) for n in range(1025)], "n long, power long"), "SELECT n, CASE WHEN n < 2 THEN 1 ELSE CAST(2 ** ceil(log2(n)) AS BIGINT) END AS power FROM range(0, 1025) r(n)")


def _chi(spark, sf):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.chi(SEED, "chi", 50, 8))], "i long, v double").select("i", _r(F.col("v")).alias("v"))


_add("sampler_chi", _chi, f"SELECT i, round(sqrt(list_sum(list_transform(w, lambda g: g * g))), 6) + 0.0 AS v FROM {_cells('chi', '50', 8, 'gaussian')}")


def _rowwise(name: str, function, sql: str) -> None:
    """A function of whole batches of parts; to nine decimals, as the seventh of such sums can be a tie."""

    def query(spark, sf):
        z = maps.map_batches(unit(spark, sf), "features", "z", None, lambda m, x: function(x), maps.ArrayType(maps.DoubleType()))
        return z.select("id", F.posexplode("z").alias("i", "z")).select("id", F.col("i").cast("long").alias("i"), _r(F.col("z"), 9).alias("z"))

    _add(name, query, _out(sql).replace("round(z, 6)", "round(z, 9)"))


_rowwise("elementwise_power", lambda x: linalg.safe_power(x, 3), f"(SELECT id, j AS i, v * v * v AS z FROM {_XJ(UNIT)})")
_rowwise("elementwise_product", lambda x: linalg.elementwise_product(x, x[:, ::-1]), f"(SELECT id, unnest(range(0, 4)) AS i, unnest(list_transform(range(1, 5), lambda k: x[k] * x[5 - k])) AS z FROM {UNIT})")
_SIMPLEX4 = "list_max(list_transform(range(1, 5), lambda k: (list_sum(u[1:k]) - 1) / k))"
_rowwise("simplex_projection_pivot", lambda x: np.array([linalg.project_simplex_pivot(v) for v in x]).reshape(x.shape), f"(SELECT id, unnest(range(0, 4)) AS i, unnest(list_transform(x, lambda v: greatest(v - t, 0))) AS z FROM (SELECT id, x, {_SIMPLEX4} AS t FROM (SELECT id, x, list_reverse_sort(x) AS u FROM {UNIT})))")


class _Squares(maps.FeatureMap):
    """A map of a user's own: squares of the features."""

    def _draw(self):
        self.width = self.d

    def apply(self, x):
        return x * x


_map("map_user_defined", lambda: _Squares(), unit, 4, f"(SELECT id, j AS i, v * v AS z FROM {_XJ(UNIT)})")

# streaming ----------------------------------------------------------------------


def _stream_transform(spark, sf):
    """Map the events as a file stream into a table and read that table."""
    from kestrel.sources.tables import shared_path
    from kestrel.streaming.streams import file_stream, run_to_table, transform_stream

    base = shared_path(spark, "stream")
    read(spark, sf, "events").write.parquet(f"{base}/in")
    m = maps.RandomFourier(8, 0.5, True, SEED).fit(4)
    run_to_table(transform_stream(events(file_stream(spark, f"{base}/in")), m).select("id", "z"), f"{base}/out", f"{base}/state")
    return _long(spark.read.parquet(f"{base}/out"))


_EVT = "(SELECT event_id AS id, [CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END, CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END, CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END, value / 500e0] AS x FROM events)"
_add("stream_transform", _stream_transform, _out(_fourier(_project(_EVT, _cells("w", "8", 4, "gaussian")), 8, 0.5, True)))


def _stream_fit(spark, sf):
    """Fit on a stream of four files, one a micro-batch, each batch taking up the state that the one before left."""
    from kestrel.sources.tables import shared_path
    from kestrel.streaming.streams import file_stream, fit_stream

    base = shared_path(spark, "stream")
    rows = emb_bin(spark, sf).withColumnRenamed("y", "label")
    for k in range(4):
        rows.where(F.pmod("id", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    make = lambda: linear.SGDClassifier(transformer=maps.RandomFourier(8, 0.5, True, SEED), loss="logistic", mode="full_batch", max_iter=1, tol=0.0, alpha=_ALPHA, intercept_decay=_DECAY, eta0=_ETA, average=0)
    model = fit_stream(file_stream(spark, f"{base}/in"), make(), f"{base}/state")
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate([*model.coef_, model.intercept_])], "j long, v double").select("j", _r(F.col("v")).alias("coef"))


_add("stream_incremental_fit", _stream_fit, _recursive("logistic", f"{_ZERO} AS w", _each(f"w[k] - {_RATE} * (g[k] + {_LAM} * w[k])"), 4, "zt.id % 4 = s.t - 1"))

# scale --------------------------------------------------------------------------


def lines4(spark, sf) -> DataFrame:
    """Order lines as four scaled numbers; the key repeats, so results are aggregates."""
    t = read(spark, sf, "lineitem")
    cells = [F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 105000.0, F.col("l_discount") / 0.1, F.col("l_tax") / 0.08]
    return spread(t.select(F.col("l_orderkey").alias("id"), F.array(*cells).alias("features")))


def _lineitem_margin(spark, sf):
    m = maps.RandomFourier(256, 0.5, True, SEED).fit(4)
    model = linear.Scorer(m, np.ones(256), 0.0)
    scored = maps.map_batches(lines4(spark, sf), "features", "m", model, lambda s, x: s.margin(x), maps.DoubleType())
    return scored.groupBy((F.col("id") % 8).alias("g")).agg(F.count("*").alias("n"), _r(F.avg("m"), 4).alias("mean_margin"))


_L4 = "(SELECT l_orderkey AS id, [l_quantity / 50e0, l_extendedprice / 105000e0, l_discount / 0.1e0, l_tax / 0.08e0] AS x FROM lineitem)"
_add("lineitem_fourier_margin", _lineitem_margin, f"SELECT id % 8 AS g, count(*) // 256 AS n, round(sum(z) / (count(*) // 256), 4) + 0.0 AS mean_margin FROM {_fourier(_project(_L4, _cells('w', '256', 4, 'gaussian')), 256, 0.5, True)} GROUP BY id % 8")

"""Embedding near-duplicates by NN-descent.

Equal vectors are one class.  A first neighbour graph comes from short blocks of
classes sorted by random sign codes; NN-descent then compares neighbours of
neighbours, pivot by pivot, until few lists change.  Edges at the threshold are
verified in double precision and give components.  Lists are cut, so rounds with
new codes follow in which vectors look for links to other components alone: a full
list hides none of these, and two tight groups meet.  A round also joins what brute
force finds for a bounded query sample.  Only a round without any new link is the
last, so links are sought until a fresh search knows them all, be they rare or
many.  Links are then counted within components, all pairs in blocks of which only
counts leave, so a group of any size is counted whole.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import materialise, scratch, table, tune
from kestrel.llm.graph import connected_components

LOG = logging.getLogger(__name__)

#: Length of neighbour lists, reverse neighbours a pivot looks at, rows of a block, code tables a round.
NEIGHBOURS, REVERSE, BLOCK, TABLES = 8, 8, 256, 10
CODE_BITS = 24
ITERATIONS = 3
#: Queries that brute force answers each round.
AUDIT = 400
#: What two vectors in half precision can change a cosine by.
HALF = 0.001
#: Rows of a chunk of a component, in between twice the root of its size; parts in which a large component is dealt.
LEAST_CHUNK, MOST_CHUNK, SALTS = 64, 2048, 64


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, unit): little-endian doubles of length one, null for vectors that link with nothing."""

    def run(batches):
        import numpy as np

        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = None if v is None or None in v else np.array(v, float)
                if x is not None and x.size and np.isfinite(x).all():
                    big = np.abs(x).max()
                    if big > 0:
                        x = x / big
                        x = x / np.sqrt((x * x).sum())
                        out.append((x + 0.0).astype("<f8").tobytes())
                        continue
                out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, unit binary")


def _matrix(column, dtype, dim):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


_EDGES = "u long, v long, sim float"


def _edge_batch(u, v, sim):
    import numpy as np

    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(sim.astype(np.float32))], ["u", "v", "sim"])


def _tables(total: int) -> int:
    """Code tables of a round: more for more rows, as blocks stay as they are."""
    return TABLES * max(1, -(-total.bit_length() // 16))


def _best(nodes, x):
    """The NEIGHBOURS best edges of every row of a block."""
    import numpy as np

    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return None
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return _edge_batch(np.repeat(nodes, k), nodes[top].ravel(), np.take_along_axis(s, top, axis=1).ravel())


def _across(nodes, x, components, threshold):
    """Edges of a block's rows to other components: the best where it is a link for sure, else all that may be."""
    import numpy as np

    s = x @ x.T
    s[components[:, None] == components] = -2
    top = s.argmax(axis=1)
    sure = s[np.arange(len(s)), top] >= threshold + HALF
    i, j = np.nonzero((s >= threshold - HALF) & ~sure[:, None])
    i, j = np.concatenate([np.flatnonzero(sure), i]), np.concatenate([top[sure], j])
    return _edge_batch(nodes[i], nodes[j], s[i, j]) if len(i) else None


def code_blocks(classes: DataFrame, dim: int, round_no: int, tables_no: int = TABLES, threshold: float | None = None) -> DataFrame:
    """Edges within blocks of rows sorted by sign codes: the best neighbours of the first
    graph, or, with a threshold, links across the components (column component)."""

    def codes(batches):
        import numpy as np

        planes = np.random.default_rng(1000 + round_no).standard_normal((dim, tables_no * CODE_BITS)).astype(np.float32)
        weights = 1 << np.arange(CODE_BITS - 1, -1, -1)
        for batch in batches:
            x = _matrix(batch.column(1), "<f2", dim).astype(np.float32)
            bits = ((x @ planes) > 0).reshape(len(x), tables_no, CODE_BITS)
            code = bits @ weights
            for t in range(tables_no):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t].astype(np.int64)), *batch.columns], ["t", "code", "node", "half", "component"])

    def search(batches):
        import numpy as np

        def block(n):
            return _best(nodes[:n], x[:n]) if threshold is None else _across(nodes[:n], x[:n], components[:n], threshold)

        nodes, x, tables, components = np.zeros(0, np.int64), np.zeros((0, dim), np.float32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            nodes = np.concatenate([nodes, batch.column(2).to_numpy()])
            tables = np.concatenate([tables, batch.column(0).to_numpy()])
            x = np.concatenate([x, _matrix(batch.column(3), "<f2", dim).astype(np.float32)])
            components = np.concatenate([components, batch.column(4).to_numpy()])
            while len(nodes) >= 2 * BLOCK:
                n = int((tables[:BLOCK] == tables[0]).sum())  # a block ends with its table
                if (out := block(n)) is not None:
                    yield out
                nodes, x, tables, components = nodes[n:], x[n:], tables[n:], components[n:]
        while len(nodes):
            n = int((tables == tables[0]).sum())
            if (out := block(n)) is not None:
                yield out
            nodes, x, tables, components = nodes[n:], x[n:], tables[n:], components[n:]

    component = F.col("node") if threshold is None else F.col("component")
    rows = classes.select("node", "half", component.alias("component")).mapInArrow(codes, "t int, code long, node long, half binary, component long")
    return rows.repartitionByRange("t", "code", "node").sortWithinPartitions("t", "code", "node").mapInArrow(search, _EDGES)


def _top(edges: DataFrame, k: int) -> DataFrame:
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("n") <= k).drop("n")


def _descend(graph: DataFrame, classes: DataFrame, dim: int) -> DataFrame:
    """Better edges from comparing the neighbours, forward and reverse, of every pivot."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("node"), F.when(F.col("n") >= NEIGHBOURS, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    back = graph.select(F.col("v").alias("p"), F.col("u").alias("node"), F.xxhash64("u", "v").alias("h"))
    salted = Window.partitionBy("p", F.pmod("h", F.lit(16))).orderBy("h")
    back = back.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= REVERSE)
    back = back.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("h"))).where(F.col("n") <= REVERSE)
    members = graph.select(F.col("u").alias("p"), F.col("v").alias("node")).unionByName(back.select("p", "node")).distinct()
    vectors = classes.select("node", "half").join(worst, "node", "left")
    lists = members.join(vectors, "node").groupBy("p").agg(F.collect_list("node").alias("nodes"), F.collect_list("half").alias("halves"), F.collect_list(F.coalesce("worst", F.lit(-2.0).cast("float"))).alias("worst"))

    def compare(batches):
        import numpy as np

        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            nodes = batch.column(1).flatten().to_numpy()
            x = _matrix(batch.column(2).flatten(), "<f2", dim).astype(np.float32)
            limit = batch.column(3).flatten().to_numpy()
            u, v, sims = [], [], []
            for lo, hi in zip(at - at[0], at[1:] - at[0]):
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > limit[lo:hi, None])
                u.append(nodes[lo:hi][i])
                v.append(nodes[lo:hi][j])
                sims.append(s[i, j])
            if u:
                yield _edge_batch(np.concatenate(u), np.concatenate(v), np.concatenate(sims))

    return lists.mapInArrow(compare, _EDGES)


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u < v) whose cosine in double precision reaches the threshold."""

    def check(batches):
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                dim = len(batch.column(2)[0].as_py()) // 8
                a, b = _matrix(batch.column(2), "<f8", dim), _matrix(batch.column(3), "<f8", dim)
                keep = pa.array(np.flatnonzero((a * b).sum(axis=1) >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["u", "v"])

    left = classes.select(F.col("node").alias("u"), F.col("unit").alias("a"))
    right = classes.select(F.col("node").alias("v"), F.col("unit").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _missed(classes: DataFrame, threshold: float, round_no: int) -> DataFrame:
    """(u, v): links of a query sample, by brute force, whose ends are in different components."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(round_no))).limit(AUDIT).select("node", "unit", "component").toArrow()
    queries = classes.sparkSession.sparkContext.broadcast(tuple(c.to_pylist() for c in sample.columns))

    def search(batches):
        import numpy as np

        q_ids, q_raw, q_components = queries.value
        dim = len(q_raw[0]) // 8
        q, q_nodes, q_of = np.frombuffer(b"".join(q_raw)).reshape(-1, dim), np.array(q_ids), np.array(q_components)
        for batch in batches:
            nodes, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            i, j = np.nonzero((q @ _matrix(batch.column(1), "<f8", dim).T >= threshold) & (q_of[:, None] != of))
            yield pa.RecordBatch.from_arrays([pa.array(q_nodes[i]), pa.array(nodes[j])], ["u", "v"])

    return classes.select("node", "unit", "component").mapInArrow(search, "u long, v long")


def _class_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): links of each class to rows of other classes of its component, all pairs in blocks.

    ``members`` has component, node, unit, copies.  Chunks of a component meet
    pairwise; a task holds two chunks, dealt by a hash, and emits one count a member.  Members learn the size of a large component by one of SALTS
    copies of it, so no component is one key.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > LEAST_CHUNK)
    size = F.greatest(F.lit(LEAST_CHUNK), F.least(F.lit(MOST_CHUNK), 2 * F.sqrt("rows")))
    large = sizes.select("component", F.ceil(F.col("rows") / size).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int"))
    known = salted.join(large, ["component", "salt"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    many = known.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = many.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "unit", "copies")
    lists = dealt.groupBy("component", "i", "j").agg(F.collect_list(F.struct("chunk", "node", "copies", "unit")).alias("m"))

    def count(batches):
        import numpy as np

        for batch in batches:
            for i, j, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = m.values
                chunk, node, copies = (s.field(k).to_numpy() for k in range(3))
                dim = len(s.field(3)[0].as_py()) // 8
                x = _matrix(s.field(3), "<f8", dim)
                a, b = chunk == i, chunk == j
                linked = x[a] @ x[b].T >= threshold
                if i == j:
                    np.fill_diagonal(linked, False)
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(linked @ copies[b])], ["node", "links"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a], node[b]])), pa.array(np.concatenate([linked @ copies[b], copies[a] @ linked]))], ["node", "links"])

    return lists.select("i", "j", "m").mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, zero or hold null or non-finite components have no
    links and are their own component.  Vectors of different lengths never link.
    Rows with a null id take part in links; the component is the smallest id that
    is there, null where there is none.
    """
    spark = df.sparkSession
    tune(spark)
    with scratch(spark, "units", "class-links"):
        rows, known = _class_links(df, id_col, vector_col, threshold)
    firsts = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(firsts, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _class_links(df: DataFrame, id_col: str, vector_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(vec_id, unit, key) of every row, and (node, key, first_id, copies, component, links) of every class."""
    spark = df.sparkSession
    rows = materialise(unit_vectors(df, id_col, vector_col).withColumn("key", F.when(F.col("unit").isNotNull(), F.unhex(F.md5("unit")))), "units")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels, counts = [], []
    for (size,) in classes.select(F.octet_length("unit")).distinct().collect():  # one pass a vector length
        part, dim = classes.where(F.octet_length("unit") == size), size // 8

        def halve(batches, dim=dim):
            import numpy as np

            for batch in batches:
                x = _matrix(batch.column(1), "<f8", dim).astype("<f2") if batch.num_rows else np.zeros((0, dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "unit", "copies", "half"])

        part = materialise(part.select("node", "unit", "copies").mapInArrow(halve, "node long, unit binary, copies long, half binary"), "half-vectors")
        total = part.count()
        graph = materialise(_top(code_blocks(part, dim, 0, _tables(total)), NEIGHBOURS), "graph")
        for _ in range(ITERATIONS):
            better = materialise(_top(graph.unionByName(_descend(graph, part, dim)), NEIGHBOURS), "graph")
            changed = better.join(graph, ["u", "v"], "left_anti").count()
            graph = better
            if changed < 0.01 * NEIGHBOURS * total:
                break
        near = graph.where(F.col("sim") >= threshold - 0.005).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links, round_no = materialise(_verified(near, part, threshold), "links"), 0
        found = materialise(connected_components(links, "u", "v"), "components")
        while True:
            round_no += 1
            known = part.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            near = code_blocks(known, dim, round_no, _tables(total), threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            new = materialise(_verified(near, part, threshold).unionByName(_missed(known, threshold, round_no)), "links")
            n_new = new.count()
            LOG.info("round %d over %d vectors of %d dimensions: %d links that no search before knew", round_no, total, dim, n_new)
            if not n_new:
                break
            links = links.unionByName(new)
            found = materialise(connected_components(links, "u", "v"), "components")
        labels.append(found)
        counts.append(_class_counts(found.join(part, "node"), threshold))
    known = classes.select("node", "key", "first_id", "copies")
    for name, parts, columns in (("component", labels, "node long, component long"), ("links", counts, "node long, links long")):
        merged = parts[0] if parts else spark.createDataFrame([], columns)
        for p in parts[1:]:
            merged = merged.unionByName(p)
        known = known.join(merged.select("node", name), "node", "left")
    return rows, materialise(known.withColumn("component", F.coalesce("component", "node")), "class-links")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95; an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

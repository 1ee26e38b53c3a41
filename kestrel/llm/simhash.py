"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments.  Two fingerprints at most ``radius`` bits
apart differ by at most ``radius // segments`` bits in one segment at least, so
each fingerprint looks up the small Hamming ball around each of its segments in
a table of all segments, and complete distances are verified in the join.  Of two
unequal segments only the larger one enumerates the smaller, which halves the
probes.  The search is exact; only distinct fingerprints take part in it, so a
group of exact copies costs one row.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import materialise, scratch, small, table, tune
from kestrel.llm.graph import connected_components

#: From this many distinct fingerprints on, two segments of 32 bits select better than three of 21.
WIDE_FROM = 1 << 23


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """(id, fp, version) with the 64-bit SimHash and another hash of every whole text.

    Words are runs without ASCII white space after lower-casing A-Z; features are
    all word n-grams of ``width``, repeats included; shorter texts have one
    feature, their whole word sequence; null, empty and blank texts have
    fingerprint zero.  A bit is set where over half the feature hashes set it.
    """

    def compute(batches):
        import numpy as np
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            texts = batch.column(1)
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                if not words:
                    continue
                joined = b" ".join(words)
                ends, at = [], -1
                for w in words:
                    at += len(w) + 1
                    ends.append(at)
                starts = [0, *(e + 1 for e in ends[:-1])]
                if len(words) <= width:
                    hashes = [xxh64_intdigest(joined, 42)]
                else:
                    hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :])]
                h = np.array(hashes, "<u8")
                total = np.zeros(64, np.int64)
                for block in range(0, len(h), 1 << 16):
                    total += np.unpackbits(h[block : block + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(total * 2 > len(h), bitorder="little").view("<i8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), batch.column(2)], ["id", "fp", "version"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), _version(text).alias("version"))
    return rows.mapInArrow(compute, "id long, fp long, version long")


def _version(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def near_pairs(distinct: DataFrame, radius: int = 4, segments: int | None = None, ball: int | None = None, rotations: tuple[int, ...] = (0,)) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at most ``radius`` bits apart.

    A pair can come more than once, from several segments.  All pairs are found
    unless ``ball``, the radius searched within a segment, is set below
    ``radius // segments``; ``rotations`` then adds segmentations of the rotated
    fingerprint, which find most of what one segmentation misses.
    """
    if segments is None:
        segments = 3 if distinct.count() < WIDE_FROM else 2
    ball = radius // segments if ball is None else ball
    edges = [64 * k // segments for k in range(segments + 1)]
    index, probe = [], []
    for turn in rotations:
        turned = f"(shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn}))" if turn else "fp"
        for lo, hi in zip(edges, edges[1:]):
            k, bits = len(index), hi - lo
            cut = f"(shiftrightunsigned({turned}, {lo}) & {(1 << bits) - 1}L)"
            masks = "array(" + ",".join(f"{m}L" for m in _ball(bits, ball)) + ")"
            index.append(f"struct({k} AS k, {cut} AS v)")
            probe.append(f"transform(filter(transform({masks}, m -> {cut} ^ m), v -> v <= {cut}), v -> struct({k} AS k, v AS v))")
    left = distinct.selectExpr("fp AS a", f"explode(flatten(array({', '.join(probe)}))) AS s").selectExpr("a", "s.k", "s.v")
    right = distinct.selectExpr("fp AS b", f"explode(array({', '.join(index)})) AS s").selectExpr("b", "s.k AS k2", "s.v AS v2")
    close = (F.col("k") == F.col("k2")) & (F.col("v") == F.col("v2")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return left.join(right, close).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(id, fp, version, component, component_id): the smallest id that links of ``radius`` bits reach.

    Rows with a null id take part in links and get the component of their
    fingerprint, null where it has no other id.
    """
    with scratch(df.sparkSession, "fingerprints", "fingerprint-components"):
        prints = materialise(fingerprints(df, id_col, text_col, width), "fingerprints")
        distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
        labels = connected_components(near_pairs(distinct.select("fp"), radius))
        joined = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
        joined = materialise(joined, "fingerprint-components")
    roots = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = joined.join(roots, "component").select("fp", "component", "component_id")
    return prints.join(of_print, "fp").select("id", "fp", "version", "component", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents.

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows come back as often as they are there; an empty table gives no rows.
    """
    tune(spark)
    found = near_duplicates(table(spark, sf_dir, "documents", dealt=True))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of the stage: words of a shingle and least Jaccard similarity.
SHINGLE, SIMILAR = 5, 0.8
#: Documents (about) in which common shingles are looked for, and how many of these are put last at most.
SAMPLE, COMMON = 50_000, 500_000
#: Nodes that a task remembers so that repeated rows are cut once.
REMEMBERED = 1 << 20


def _shingles(text: str | None, width: int):
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words has one, of its whole sequence."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.array([xxh64_intdigest(x) for x in words], "<u8")
    n = max(1, len(w) - width + 1)
    h = np.full(n, len(w) if len(w) < width else width, "<u8")
    factor = 1
    for k in range(min(width, len(w))):  # a sum of word hashes times odd factors by place
        factor = factor * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        h += w[k : k + n] * np.uint64(factor)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))).view("<i8"))


def shared_prefixes(df: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """Pairs (a, b), a < b, of ids whose texts can have the Jaccard similarity of shingle sets; none that has it is missed.

    Shingles have one order for all texts, common ones last.  Two sets so similar
    share a shingle among the first (1 - least) of each, and their first common one
    stands so early in both that what follows can hold enough of them.  Which are
    common comes from a sample; it decides the work, not the result.  Shingles of
    one text alone go after one shuffle, before the join.  Rows of one id have one text.
    """

    def every(batches):
        for batch in batches:
            for text in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(text, width))], ["gram"])

    def prefixes(batches):
        import numpy as np

        last, seen = shared.value, set()
        for batch in batches:
            grams, ids, sizes, places = [np.zeros(0, np.int64)], [], [], [np.zeros(0, np.int32)]
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = np.zeros(0, np.int64)
                h = first
                if node not in seen:
                    seen = seen if len(seen) < REMEMBERED else set()
                    seen.add(node)
                    h = _shingles(text, width)
                    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
                    first = np.concatenate([h[~late], h[late]])[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
                grams.append(first)
                places.append(np.arange(len(first), dtype=np.int32))
                ids.append(len(first))
                sizes.append(len(h))
            ids = np.array(ids, np.int64)
            columns = (np.concatenate(grams), np.repeat(batch.column(0).to_numpy(), ids), np.repeat(np.array(sizes, np.int32), ids), np.concatenate(places))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "id", "size", "place"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    share = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInArrow(every, "gram long").groupBy("gram").count().where("count > 2")
    common = sample.orderBy(F.desc("count"), "gram").limit(COMMON).select("gram").toArrow()  # at most COMMON rows
    shared = df.sparkSession.sparkContext.broadcast(sorted_array(common.column("gram")))
    rows = texts.mapInArrow(prefixes, "gram long, id long, size int, place int")
    found = rows.withColumn("others", F.count("*").over(Window.partitionBy("gram"))).where("others > 1").drop("others")
    found = materialise(found, "shared-prefixes")
    shared.unpersist()
    left, right = found.toDF("gram", "a", "na", "pa"), found.toDF("gram", "b", "nb", "pb")
    overlap = F.ceil((F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - 1e-6)
    alike = (F.col("a") < F.col("b")) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= overlap)
    return left.join(right, "gram").where(alike).select("a", "b").distinct()


def sorted_array(column):
    import numpy as np

    return np.sort(column.to_numpy())


def _parities(grams) -> bytes:
    """Of every bin of a power of two of bins, at least four a member, whether a set has an odd number of members there."""
    import numpy as np

    bins = max(8, 1 << (4 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount(grams & (bins - 1), minlength=bins).astype(np.uint8) & 1).tobytes()


def most_common(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """An upper bound of the members that two sets share, from their parities: a bin that differs holds one that is not shared."""
    import numpy as np

    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(a) != len(b):  # the parities of half the bins are those of both halves added up
        a, b = (v if len(v) == min(len(a), len(b)) else v[: len(v) // 2] ^ v[len(v) // 2 :] for v in (a, b))
    return (nx + ny - int(np.bitwise_count(a ^ b).sum())) // 2


def similar_pairs(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, row_col: str, width: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts' sets of word shingles have the Jaccard similarity.

    Only texts that are in a pair are turned into sets, and sets meet only where the
    parities of their bins leave the similarity possible.  Rows of one id have one
    text, and ``row_col`` numbers the rows of df.
    """

    def shingles(batches):
        for batch in batches:
            sets = [_shingles(text, width) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([_parities(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "odd", "grams"])

    def enough(common, nx, ny):
        return common >= least * (nx + ny - common)

    def bound(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
            keep = pa.array([i for i, (nx, x, ny, y) in enumerate(rows) if enough(most_common(x, nx, y, ny), nx, ny)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    def compare(batches):
        import numpy as np

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                common = len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True))
                if enough(common, len(x) // 8, len(y) // 8):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    firsts = df.groupBy(F.col(id_col).alias("id")).agg(F.min(row_col).alias("__k_row")).join(ends, "id", "left_semi").select("__k_row")
    firsts = materialise(firsts, "pair-ends")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(row_col).alias("__k_row")).join(small(firsts), "__k_row", "left_semi")
    sets = materialise(texts.select("id", "text").mapInArrow(shingles, "id long, size int, odd binary, grams binary"), "shingle-sets")
    left, right = sets.select("id", "size", "odd").toDF("a", "na", "x"), sets.select("id", "size", "odd").toDF("b", "nb", "y")
    likely = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "x", "nb", "y").mapInArrow(bound, "a long, b long")
    likely = materialise(likely, "likely-pairs")
    left, right = sets.select("id", "grams").toDF("a", "x"), sets.select("id", "grams").toDF("b", "y")
    left, right = left.join(likely.select("a"), "a", "left_semi"), right.join(likely.select("b"), "b", "left_semi")
    return likely.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document, that of the smallest id, of each near-duplicate group.

    First the operator's own components go down to one document.  Of these, all
    whose shingle sets are SIMILAR are near copies as well, whatever the size of the
    input.  Rows that share an id and stay in one group are one document; rows are
    judged by their own text.  A null id stays only where its group has no id.
    """
    with scratch(df.sparkSession, "representative-rows", "near-copies"):
        kept, lost = _near_copies(df, id_col, text_col)
    return kept.join(small(lost), "__k_node", "left_anti").select(*(f"`{c}`" for c in df.columns))


def _near_copies(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one document a component with its node and a number, and the nodes that are near copies of others."""
    found = near_duplicates(df, id_col, text_col)
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("component_id").alias("id"), F.min("version").alias("version"))
    stay = materialise(stay.select(F.col("component").alias("__k_node"), F.col("id").alias("__k_id"), F.col("version").alias("__k_version")), "representatives")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__k_id")) & (_version(F.col(text_col).cast("string")) == F.col("__k_version"))
    kept = df.join(stay.hint("shuffle_hash"), same).select(*(F.col(f"`{c}`") for c in df.columns), "__k_node").withColumn("__k_row", F.monotonically_increasing_id())
    kept = materialise(kept, "representative-rows", "zstd")
    pairs = materialise(shared_prefixes(kept, "__k_node", text_col), "candidate-pairs")
    groups = connected_components(similar_pairs(pairs, kept, "__k_node", text_col, "__k_row"))
    groups = groups.join(stay.select(F.col("__k_node").alias("node"), F.col("__k_id").alias("id")), "node")
    roots = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("root"))
    lost = groups.join(roots, "component").where(F.col("node") != F.col("root.node")).select(F.col("node").alias("__k_node"))
    return kept, materialise(lost, "near-copies")

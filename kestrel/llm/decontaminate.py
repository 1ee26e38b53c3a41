"""Benchmark decontamination by latent semantic retrieval.

1. Words are 32-bit hashes; documents are stored once as sequences of them, whatever
   the benchmark.  The words of the benchmark are features of their own, all other
   words of the corpus share BUCKETS hashed features.
2. All passages of all documents are stored once as counted features; document
   frequencies are counted over them.
3. A distributed randomised SVD of the TF-IDF passages of the benchmark and of the
   whole corpus gives the latent space; no passage is left out of the fit.
4. Candidates are stretches of an item's length whose cosine to the item is high in
   that space.  Both sides are measured there, so a copy has cosine one whatever the
   rank and the size of corpus or benchmark.  An inverted file over the rarest words
   of each item tells where to take cosines: a stretch that holds COMMON of an item
   in order must hold some of them near each other, whatever the item's length, so
   the file loses nothing that step 5 would accept.
5. Candidates are confirmed by the longest common subsequence of words and by the
   answer, the end of the item, so that shared stock words do not count.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import materialise, scratch, table, tune

#: Words of a passage for document frequencies; words that may stand between those of an item.
PASSAGE, WINDOW = 64, 32
#: Hashed features of words that the benchmark has not.
BUCKETS = 1 << 14
#: Latent dimensions at most, loadings at most, power iterations.
RANK, LOADINGS, POWER = 64, 1 << 24, 2
#: Cells of gathered loadings that a task multiplies at once, about what stays in cache; entries of one product.
CELLS, CHUNK = 1 << 18, 16
#: Least latent cosine of a candidate.
COSINE = 0.4
#: Least share of an item's words in common order, words of the answer and the share of it.
COMMON, ANSWER, ANSWER_SHARE = 0.75, 5, 0.6

#: Hits of rare words that a task sorts at once.
LOT = 1 << 20
#: Bytes of benchmark text that are gathered at once; a larger benchmark is searched for slice by slice.
SLICE_BYTES = 4 << 20

_PUNCT = None


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates, everything else belongs to words."""
    global _PUNCT
    if _PUNCT is None:
        _PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split()


@dataclass
class Benchmark:
    """Items as sequences of places in the sorted array of their own words' hashes."""

    item_ids: list
    items: list
    vocabulary: object

    def features(self, hashes):
        """A feature a word: its place in the vocabulary, or that of its bucket after it."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary) + (hashes & np.uint32(BUCKETS - 1)))


def hashes_of(text: str | None):
    import numpy as np
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(w) for w in words_of(text)] if text else [], "<u4")


def load_benchmark(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    """Gather a benchmark, or a slice of it; items without a word are left out."""
    import numpy as np

    item_ids, items = [], []
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").collect():
        if len(h := hashes_of(row.t)):
            item_ids.append(row.i)
            items.append(h)
    vocabulary = np.unique(np.concatenate([np.zeros(0, "<u4"), *items]))
    return Benchmark(item_ids, [np.searchsorted(vocabulary, h).tolist() for h in items], vocabulary)


def compact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, version): every document's words as little-endian 32-bit hashes, and a hash of its text."""

    def run(batches):
        for batch in batches:
            out = [hashes_of(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "ids", "version"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _version(text).alias("version"))
    return rows.mapInArrow(run, "doc_id long, ids binary, version long")


def _version(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _joined(batch):
    """All words of a batch in one array, and each document's bounds."""
    import numpy as np

    raw = batch.column(1).to_pylist()
    ends = np.cumsum([len(x) // 4 for x in raw])
    return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], ends]).astype(np.int64)


def _passages(at):
    """(passage of each word, passages) of joined documents."""
    import numpy as np

    lengths = np.diff(at)
    first = np.concatenate([[0], np.cumsum(-(-lengths // PASSAGE))])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return first[doc] + (np.arange(at[-1]) - at[doc]) // PASSAGE, int(first[-1])


def passage_rows(docs: DataFrame, shared, n: int) -> DataFrame:
    """(lengths, features, tf): all passages of all documents, a lot of them a row; ``shared`` broadcasts the benchmark.

    Of each passage how many distinct features it has, these in order (of n, in two
    bytes if they suffice), and how often each is there, PASSAGE times at most.
    """
    import numpy as np

    kind = "<u2" if n <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            ids, at = _joined(batch)
            passage, passages = _passages(at)
            keys, tf = np.unique(passage * n + shared.value.features(ids), return_counts=True)
            cells = [np.bincount(keys // n, minlength=passages).astype("u1"), (keys % n).astype(kind), tf.astype("u1")]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["lengths", "features", "tf"])

    return materialise(docs.select("doc_id", "ids").mapInArrow(run, "lengths binary, features binary, tf binary"), "passages", "zstd")


def _rows_of(batch, n: int):
    """(lengths, features, tf) of each lot of a batch of ``passage_rows``."""
    import numpy as np

    for lengths, features, tf in zip(*(c.to_pylist() for c in batch.columns)):
        yield np.frombuffer(lengths, "u1"), np.frombuffer(features, "<u2" if n <= 1 << 16 else "<u4").astype(np.int64), np.frombuffer(tf, "u1")


def passage_counts(rows: DataFrame, n: int) -> tuple:
    """(passages, in how many of them each of the n features is), over all ``passage_rows``."""
    import numpy as np

    def run(batches):
        total, counts = 0, np.zeros(n, np.int64)
        for batch in batches:
            for lengths, features, _ in _rows_of(batch, n):
                total += len(lengths)
                counts += np.bincount(features, minlength=n)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"w": pa.array(np.append(-1, some)), "n": pa.array(np.append(total, counts[some]))})

    found = rows.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()  # a row a feature
    counts = np.zeros(n + 1, np.int64)
    counts[found.column("w").to_numpy()] = found.column("n").to_numpy()  # -1, the passages, comes last
    return int(counts[-1]), counts[:-1]


def _tfidf(features, passage, idf):
    """Sparse rows (passage, feature, weight) of unit length, sorted by passage."""
    import numpy as np

    keys, tf = np.unique(passage * len(idf) + features, return_counts=True)
    p, w = keys // len(idf), keys % len(idf)
    weight = (1 + np.log(tf)) * idf[w]
    return p, w, weight / np.sqrt(np.maximum(np.bincount(p, weights=weight**2)[p], 1e-12)) if len(p) else weight


def _product(p, w, x, v):
    """A^T (A v) of sparse rows sorted by passage: the features that are there, and their rows."""
    import numpy as np

    starts = np.flatnonzero(np.diff(p, prepend=-1))
    y = np.add.reduceat(v[w] * x[:, None], starts, axis=0)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
    order = np.argsort(w, kind="stable")
    at = np.flatnonzero(np.diff(w[order], prepend=-1))
    return w[order][at], np.add.reduceat(y[row[order]] * x[order][:, None], at, axis=0)


def _segment_sums(source, row, x, many):
    """Sums of x times rows of source over segments of ``many`` entries each; small matrix products that stay in cache."""
    import numpy as np

    while True:
        chunks = np.maximum(1, -(-many // CHUNK))
        first = np.cumsum(chunks) - chunks
        slot = np.repeat(first * CHUNK - (np.cumsum(many) - many), many) + np.arange(len(row))
        n = int(chunks.sum())
        at, weight = np.zeros(n * CHUNK, np.intp), np.zeros(n * CHUNK, np.float32)
        at[slot], weight[slot] = row, x
        out = np.empty((n, source.shape[1]), np.float32)
        step = max(1, CELLS // (CHUNK * source.shape[1]))
        held = np.empty((step * CHUNK, source.shape[1]), np.float32)  # gathering into new memory costs ten times as much
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            cells = held[: (hi - lo) * CHUNK]
            source.take(at[lo * CHUNK : hi * CHUNK], axis=0, out=cells, mode="clip")
            np.matmul(weight[lo * CHUNK : hi * CHUNK].reshape(-1, 1, CHUNK), cells.reshape(hi - lo, CHUNK, -1), out=out[lo:hi].reshape(hi - lo, 1, -1))
        if n == len(many):
            return out
        source, row, x, many = out, np.arange(n), np.float32(1), chunks


def _grow(total, lengths, w, tf, idf, v) -> None:
    """Add A^T (A v) to total, A the unit TF-IDF rows of a lot of passages; in single precision within the lot."""
    import numpy as np

    many = lengths.astype(np.int64)
    x = (np.log(np.arange(1, PASSAGE + 1)) + 1).astype(np.float32)[tf - 1] * idf[w]
    x /= np.repeat(np.sqrt(np.maximum(np.add.reduceat(x * x, np.cumsum(many) - many), 1e-12)), many)
    y = _segment_sums(v, w, x, many)
    order = np.argsort(w.astype(np.uint16) if len(v) <= 1 << 16 else w, kind="stable")
    w, x, row = w[order], x[order], np.repeat(np.arange(len(many)), many)[order]
    at = np.flatnonzero(np.diff(w, prepend=-1))
    total[w[at]] += _segment_sums(y, row, x, np.diff(np.append(at, len(w))))


def latent_space(rows: DataFrame, items: list[list[int]], idf, n_passages: int):
    """Loadings (features x rank) by randomised subspace iteration over all ``passage_rows``.

    Each iteration is one job: tasks multiply their passages with the broadcast
    basis and back and emit a feature-by-rank partial sum, rows of which are added
    up by feature.  The benchmark's own passages are stacked below with the weight
    of the corpus, so that rare items keep directions of their own.
    """
    import numpy as np

    spark, n = rows.sparkSession, len(idf)
    rank = max(1, min(RANK, LOADINGS // n, len(items)))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n, rank)))[0].astype(np.float32)
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)  # a task sends a row a feature, however much it read
    at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
    p, w, x = _tfidf(np.concatenate([np.array(i, np.int64) for i in items]), _passages(at)[0], idf)
    x = x * np.sqrt(max(1.0, n_passages / len(items)))
    weights = idf.astype(np.float32)
    for _ in range(POWER):
        now = spark.sparkContext.broadcast((basis, weights))

        def run(batches, now=now):
            v, idf = now.value
            total = np.zeros(v.shape)
            for batch in batches:
                for lengths, features, tf in _rows_of(batch, len(v)):
                    if len(lengths):
                        _grow(total, lengths, features, tf, idf, v)
            some = np.flatnonzero(total.any(axis=1))
            for lo in range(0, len(some), 4096):
                part = some[lo : lo + 4096]
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.ListArray.from_arrays(offsets, pa.array(total[part].astype(np.float32).ravel()))], ["w", "row"])

        found = rows.mapInArrow(run, "w long, row array<float>")
        sums = found.groupBy("w").agg(*(F.sum(F.element_at("row", k + 1)).alias(f"c{k}") for k in range(rank))).toArrow()  # a row a feature
        some, own = _product(p, w, x, basis)
        grown = 1e-9 * np.random.default_rng(8).standard_normal(basis.shape)
        grown[some] += own
        if sums.num_rows:
            grown[sums.column("w").to_numpy()] += np.stack([sums.column(f"c{k}").to_numpy() for k in range(rank)], axis=1)
        basis = np.linalg.qr(grown)[0].astype(np.float32)
        now.unpersist()
    return basis


def common_subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def confirm(item: list[int], region: list[int]) -> float:
    """The share of the item's words in common order, 0 unless the answer is there too."""
    share = common_subsequence(item, region) / len(item)
    answer = item[-ANSWER:]
    if share < COMMON or common_subsequence(answer, region) < ANSWER_SHARE * len(answer):
        return 0.0
    return share


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_items, cosine, lcs): documents that hold a benchmark item, each with its best item.

    Null, empty and wordless texts hold nothing, nor does anything under an empty
    benchmark; items without a word are left out.  Of equal matches the smallest
    item_id is given.  Rows that share an id are one document; a null id is given
    as null.
    """
    match = F.struct("lcs", "cosine", (-F.col("item_id")).alias("order"), "item_id")
    rows = _matches(df, benchmark, id_col, text_col, item_col, item_text)
    rows = rows.groupBy("doc_id", "slice").agg(F.max("n_items").alias("n_items"), F.max(match).alias("m"))
    best = rows.groupBy("doc_id").agg(F.sum("n_items").alias("n_items"), F.max("m").alias("m"))
    return best.select("doc_id", "m.item_id", "n_items", "m.cosine", "m.lcs")


def rare_words(items: list[list[int]], frequency) -> tuple:
    """(starts, items, needed, spans): postings of each vocabulary word in the items whose rarest words it is among.

    At most ``lack`` words of an item are missing where COMMON of it is there, so
    of its ``lack + needed`` rarest words ``needed`` at least are, within the
    item's span.  No match is lost by looking for these alone.
    """
    import numpy as np

    pairs, needed, spans = [], np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for k, item in enumerate(items):
        lack = int(len(item) * (1 - COMMON) + 1e-9)
        needed[k] = min(1 + len(item) // 8, len(item) - lack)
        spans[k] = len(item) + WINDOW
        rarest = sorted(item, key=lambda w: (frequency[w], w))[: lack + needed[k]]
        pairs += [(w, k) for w in sorted(set(rarest))]
    pairs = np.array(sorted(pairs), np.int64)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(frequency) + 1))
    return starts, pairs[:, 1], needed, spans


def candidates(ids, at, postings):
    """(document, item, from, to) of stretches of joined documents that can hold an item; see rare_words."""
    import numpy as np

    starts, posted, needed, spans = postings
    known = np.flatnonzero(ids >= 0)
    degree = np.diff(starts)[ids[known]]
    known, degree = known[degree > 0], degree[degree > 0]
    upto = np.concatenate([[0], np.cumsum(degree)])
    reach, lo = int(spans.max()), 0
    while lo < len(known):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + LOT, side="right")) - 1)
        first = int(np.searchsorted(known, known[lo] - reach))  # a stretch that ends here can begin before
        n = degree[first:hi]
        place = np.repeat(known[first:hi], n)
        item = posted[np.repeat(starts[ids[known[first:hi]]], n) + np.arange(len(place)) - np.repeat(upto[first:hi] - upto[first], n)]
        doc = np.searchsorted(at, place, side="right") - 1
        key = doc * len(needed) + item
        order = np.argsort(key, kind="stable")
        key, place, item, doc = key[order], place[order], item[order], doc[order]
        last = np.arange(len(key)) + needed[item] - 1
        inside = np.minimum(last, len(key) - 1)
        close = np.flatnonzero((last < len(key)) & (key[inside] == key) & (place[inside] - place <= spans[item]))
        done_key, done = -1, 0
        for k, d, i, a, b, span in zip(*(x[close].tolist() for x in (key, doc, item, place)), place[inside[close]].tolist(), spans[item[close]].tolist()):
            if k == done_key and a + span < done:  # inside the stretch before
                continue
            done_key, done = k, a + span + span // 2
            yield d, i, max(int(at[d]), b - span), min(int(at[d + 1]), done)
        lo = hi


def _matches(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of df and slice of the benchmark that match, with the slice's best item."""
    tune(df.sparkSession)
    slices = max(1, -(-(benchmark.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0) // SLICE_BYTES))
    docs = materialise(compact(df, id_col, text_col), "compact-documents", "zstd")
    rows = None
    for k in range(slices):
        part = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(slices)) == k)
        found = _search(docs, load_benchmark(part, item_col, item_text)).withColumn("slice", F.lit(k))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def _sum(loads, features):
    """The sum of rows of a matrix, a bounded number of them at a time."""
    return sum(loads[features[at : at + 4096]].sum(axis=0, dtype=float) for at in range(0, len(features), 4096))


def _search(docs: DataFrame, bench: Benchmark) -> DataFrame:
    import numpy as np

    spark = docs.sparkSession
    schema = "doc_id long, version long, item_id long, n_items long, cosine double, lcs double"
    if not bench.items:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(bench)
    n_words = len(bench.vocabulary)
    with scratch(spark):
        rows = passage_rows(docs, shared, n_words + BUCKETS)
        n_passages, frequency = passage_counts(rows, n_words + BUCKETS)
        idf = np.log((1 + n_passages) / (1 + frequency)) + 0.05
        loads = latent_space(rows, bench.items, idf, n_passages) * idf[:, None].astype(np.float32)
    found = spark.sparkContext.broadcast((loads, rare_words(bench.items, frequency[:n_words])))

    def search(batches):
        bench, (loads, postings) = shared.value, found.value
        items, item_ids = bench.items, bench.item_ids

        def closeness(k, region):
            """The best latent cosine to item k of stretches of its length, for long items at steps of a 256th of it."""
            length = min(len(items[k]), len(region))
            step = max(1, length // 256)
            item = _sum(loads, np.array(items[k]))
            parts = loads[region] if step == 1 else np.stack([_sum(loads, region[at : at + step]) for at in range(0, len(region), step)])
            total = np.concatenate([np.zeros((1, loads.shape[1])), np.cumsum(parts, axis=0, dtype=float)])
            z = total[length // step :] - total[: -(length // step)]
            return float(((z @ item) / np.maximum(np.linalg.norm(z, axis=1) * np.linalg.norm(item), 1e-18)).max())

        for batch in batches:
            out = []
            ids, at = _joined(batch)
            features = bench.features(ids)
            known = np.where(features < len(bench.vocabulary), features, -1)
            matches: dict[int, dict[int, tuple[float, float]]] = {}
            for d, k, lo, hi in candidates(known, at, postings):
                c = closeness(k, features[lo:hi])
                if c >= COSINE and (score := confirm(items[k], known[lo:hi].tolist())):
                    best = matches.setdefault(d, {})
                    best[k] = max(best.get(k, (0.0, 0.0)), (score, min(c, 1.0)))
            if matches:
                names, versions = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for d, best in matches.items():
                k = min(best, key=lambda k: (-best[k][0], -best[k][1], item_ids[k] is None, item_ids[k] or 0))
                out.append((names[d], versions[d], item_ids[k], len(best), best[k][1], best[k][0]))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "version", "item_id", "n_items", "cosine", "lcs"])

    return docs.mapInArrow(search, schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of the benchmark; clean documents have no row."""
    return contaminated(table(spark, sf_dir, "documents", dealt=True), table(spark, sf_dir, "benchmark"))


def remove_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without contaminated rows, each judged by its own text, rows without an id included."""
    gone = _matches(df, benchmark, id_col, text_col).select(F.col("doc_id").alias("__k_id"), F.col("version").alias("__k_version")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__k_id")) & (_version(F.col(text_col).cast("string")) == F.col("__k_version"))
    return df.join(gone.hint("shuffle_hash"), same, "left_anti")

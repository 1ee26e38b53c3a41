"""Packing of token sequences by non-negative least squares.

Documents are cut into full windows and one tail shorter than a window.  The
histogram of tail lengths (at most ``window - 1`` bins, whatever the corpus) is
covered by shallow combinations of two or three lengths that fill a window
exactly: their repeat counts solve a non-negative least-squares problem, are
rounded down to what the histogram holds, and tails are dealt to the slots by
rank.  The tails left over are packed greedily one behind the other and cut at
window ends; what remains after the last full window is cut at powers of two, so
that no sequence needs padding.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import materialise, table, tune, worker_cache
from kestrel.llm.tokens import tokenizer_path

TRIPLES_A_LENGTH = 4


def _plain(text: str) -> bool:
    """Whether both libraries surely split a text alike: ASCII, Latin letters, common punctuation."""
    import regex

    return worker_cache("plain-text", lambda: regex.compile(r"[\n -~¡-¬®-ɏ‐-‧一-鿿]*")).fullmatch(text) is not None


def _encoder(path: str):
    """texts -> lists of ids, as the tokenizers library gives them.

    The rank file of the same vocabulary, where there is one beside it, gives the
    same ids several times faster; it serves texts of plain characters that hold
    no special string, all others go through tokenizers itself.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda texts: [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(texts):
        out = []
        for text in texts:
            if _plain(text) and not any(s in text for s in special):
                out.append(quick.encode_ordinary(text))
            else:
                out.append(slow.encode(text, add_special_tokens=False).ids)
        return out

    return encode


_TOKENS = "doc_id long, doc_tokens long, q int, r int, crcs array<long>, tail_crc long, tail binary, ids binary"


def tokenise(df: DataFrame, id_col: str, text_col: str, path: str, window: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row a document: its token count, the CRC-32 of its full windows, its tail.

    ``ids`` has all ids (little-endian unsigned 32-bit) where ``keep_ids`` asks for
    them.  Null texts are empty; every document ends with ``end_id``, so none is
    without a token.
    """

    def run(batches):
        import numpy as np

        encode = worker_cache(("ids", path), lambda: _encoder(path))
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                q, r = divmod(len(ids), window)
                step = 4 * window
                tail = raw[q * step :]
                rows.append((doc, len(ids), q, r, [zlib.crc32(raw[k * step : (k + 1) * step]) for k in range(q)], zlib.crc32(tail), tail, raw if keep_ids else None))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in _TOKENS.split(", ")])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _TOKENS)


def combinations_of(histogram, window: int) -> list[tuple[int, ...]]:
    """All pairs and, for every length, the triples of the most frequent partners, that fill a window."""
    import numpy as np

    h = np.asarray(histogram, float)
    found = {(a, window - a) for a in range(1, window // 2 + 1) if h[a] and h[window - a]}
    lengths = np.flatnonzero(h)
    for a in lengths.tolist():
        b = np.arange(1, window - a)
        if len(b):
            worth = np.minimum(h[b], h[window - a - b])
            for k in np.argsort(-worth, kind="stable")[:TRIPLES_A_LENGTH].tolist():
                if worth[k] > 0:
                    found.add(tuple(sorted((a, int(b[k]), window - a - int(b[k])))))
    return sorted(found)


def solve_counts(histogram, patterns: list[tuple[int, ...]], rounds: int = 400):
    """Whole repeat counts of patterns: accelerated projected-gradient NNLS, rounded within the histogram."""
    import numpy as np

    h = np.asarray(histogram, float)
    if not patterns:
        return np.zeros(0, np.int64)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([x for p in patterns for x in p])
    counts = np.bincount(row, minlength=len(h))
    step = 1.0 / (9.0 * max(1, counts.max()))  # at least the inverse of the matrix' squared norm, entries being 3 at most
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        rest = np.bincount(row, weights=y[col], minlength=len(h)) - h
        new = np.maximum(0, y - step * np.bincount(col, weights=rest[row], minlength=len(patterns)))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    left = np.asarray(histogram, np.int64).copy()
    whole = np.zeros(len(patterns), np.int64)

    def take(k: int, most: int) -> None:
        need = np.bincount(patterns[k])
        at = np.flatnonzero(need)
        n = min([most, *(left[at] // need[at]).tolist()])
        whole[k] += n
        left[at] -= n * need[at]

    for k in np.argsort(-x, kind="stable").tolist():
        take(k, int(x[k]))
    for k in np.argsort(-(x - np.floor(x)), kind="stable").tolist():  # then what the fractions add up to
        take(k, int(left.sum()) + 1)
    return whole


def _intervals(patterns, counts, window: int):
    """Slots of each length as rank intervals: (r, lo, hi, first sequence, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in zip(patterns, (int(c) for c in counts)):
        if not n:
            continue
        at = 0
        for length in pattern:
            lo = used.get(length, 0)
            rows.append((length, lo, lo + n, sequence, at))
            used[length] = lo + n
            at += length
        assert at == window
        sequence += n
    return rows, sequence


def _powers(total: int, start: int) -> list[int]:
    """Ends of the power-of-two sequences that the last ``total`` tokens from start make up."""
    ends, at = [], start
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def pack(tokens: DataFrame, window: int = 1024) -> DataFrame:
    """Pieces of a tokenised table (``tokenise``): one row a piece with its place.

    Each id lies in exactly one piece and every sequence is full or of a power of
    two.  The table is written once; ranks and offsets come from per-split sums
    and windows within a split, so no length, however frequent, meets in one task.
    """
    spark = tokens.sparkSession
    held = materialise(tokens.withColumn("rk", F.monotonically_increasing_id()), "tokens", "zstd")
    rows = held.select("rk", F.shiftright("rk", 33).cast("int").alias("b"), "doc_id", "doc_tokens", "q", "r", "crcs", "tail_crc")
    per = materialise(rows.groupBy("b", "r").agg(F.count("*").alias("n"), F.sum("q").alias("q")), "tail-histogram")
    histogram = [0] * (window + 1)
    for x in per.groupBy("r").agg(F.sum("n").alias("n")).collect():  # one row a length
        histogram[x.r] = x.n
    histogram[0] = 0
    patterns = combinations_of(histogram, window)
    slots, n_patterned = _intervals(patterns, solve_counts(histogram, patterns), window)
    full = per.agg(F.coalesce(F.sum("q"), F.lit(0)).cast("long")).first()[0]

    by_split = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    split_q = per.groupBy("b").agg(F.sum("q").alias("q")).select("b", F.coalesce(F.sum("q").over(by_split), F.lit(0)).alias("q0"))
    of_length = Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select("b", "r", F.coalesce(F.sum("n").over(of_length), F.lit(0)).alias("rank0")).join(split_q, "b")
    within = Window.partitionBy("b").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("q_before", F.coalesce(F.sum("q").over(within), F.lit(0)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("b", "r").orderBy("rk")) - 1)
        .join(ranks, ["b", "r"])
        .withColumns({"rank": F.col("rank0") + F.col("nth"), "q_before": F.col("q0") + F.col("q_before")})
    )
    places = spark.createDataFrame(slots, "r int, lo long, hi long, seq0 long, at int")  # bounded by the window
    i = F.broadcast(places.select(F.col("r").alias("r2"), "lo", "hi", "seq0", "at"))
    placed = placed.join(i, (F.col("r") == F.col("r2")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").drop("r2")
    placed = materialise(placed.select("rk", "b", "doc_id", "doc_tokens", "q", "r", "crcs", "tail_crc", "q_before", (F.col("seq0") + F.col("rank") - F.col("lo")).alias("seq"), "at"), "placed")

    windows = placed.where("q > 0").select("doc_id", "doc_tokens", "q_before", F.posexplode("crcs").alias("k", "crc")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        "doc_tokens", (F.col("q_before") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    tail_start = (F.col("q").cast("long") * window).alias("start")
    matched = placed.where("r > 0 AND seq IS NOT NULL").select(
        "doc_id", tail_start, F.col("r").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens",
        (F.lit(full) + F.col("seq")).cast("long").alias("sequence_id"), F.col("at").cast("long").alias("offset"),
    )

    rest = placed.where("r > 0 AND seq IS NULL").select("rk", "b", "doc_id", "doc_tokens", "q", "r", "tail_crc")
    sums = rest.groupBy("b").agg(F.sum("r").alias("s"))
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long")).first()[0]
    split_s = sums.select("b", F.coalesce(F.sum("s").over(by_split), F.lit(0)).alias("s0"))
    rest = rest.withColumn("g", F.coalesce(F.sum("r").over(within), F.lit(0))).join(split_s, "b").withColumn("g", F.col("g") + F.col("s0")).withColumn("e", F.col("g") + F.col("r"))
    last = total // window * window
    ends = [last, *_powers(total - last, last)]
    ends_sql = "array(" + ",".join(f"{x}L" for x in ends) + ")"
    cuts = f"array_distinct(concat(array((g div {window} + 1) * {window}L), {ends_sql}))"
    rest = rest.withColumn("cuts", F.expr(f"sort_array(filter({cuts}, c -> c > g AND c < e AND c <= {total}L))"))
    rest = rest.withColumn("parts", F.expr("zip_with(concat(array(cast(g AS bigint)), cuts), concat(cuts, array(cast(e AS bigint))), (lo, hi) -> struct(lo AS lo, hi AS hi))"))
    pieces = rest.select("rk", "doc_id", "doc_tokens", "q", "r", "tail_crc", "g", F.size("cuts").alias("n_cuts"), F.explode("parts").alias("p"))
    lo, hi = F.col("p.lo"), F.col("p.hi")
    index = F.size(F.filter(F.expr(ends_sql), lambda x: x <= lo)) - 1  # which of the last, short sequences
    short = lo >= last
    pieces = pieces.select(
        "rk", "doc_id", (F.col("q").cast("long") * window + lo - F.col("g")).alias("start"), (hi - lo).alias("length"), "tail_crc", "n_cuts",
        (lo - F.col("g")).cast("int").alias("from"), "doc_tokens",
        (F.lit(full + n_patterned) + F.when(short, F.lit(last // window) + index).otherwise(F.floor(lo / window))).cast("long").alias("sequence_id"),
        F.when(short, lo - F.try_element_at(F.expr(ends_sql), index + 1)).otherwise(lo % window).cast("long").alias("offset"),
    )
    whole = pieces.where("n_cuts = 0").select("doc_id", "start", "length", F.col("tail_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    cut = pieces.where("n_cuts > 0").join(held.select("rk", "tail"), "rk")
    cut = cut.select("doc_id", "start", "length", F.expr("crc32(substring(tail, 4 * from + 1, cast(4 * length AS int)))").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return windows.unionByName(matched).unionByName(whole).unionByName(cut)


def sequences(pieces: DataFrame, tokens: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces and a table tokenised with ``keep_ids``.

    Document ids must be unique here.  Sequences whose length is no power of two
    are padded to the window.
    """
    body = pieces.join(tokens.select("doc_id", "ids"), "doc_id").select("sequence_id", "offset", F.expr("substring(ids, cast(4 * start + 1 AS int), cast(4 * length AS int))").alias("part"))
    joined = body.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))  # a window at most
    raw = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["part"]))
    n = F.octet_length("raw")
    short = n.bitwiseAND(n - 1) != 0
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - n / 4).cast("int")))
    return joined.select("sequence_id", raw.alias("raw")).select("sequence_id", F.when(short, F.concat("raw", pad)).otherwise(F.col("raw")).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens.

    Null and empty texts are the end id alone; repeated rows and null ids are
    packed like any others; an empty table gives no rows.
    """
    tune(spark)
    return pack(tokenise(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), 1024))

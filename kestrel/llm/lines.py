"""Line dedup with DataFrame functions alone.

Every line becomes a narrow row (key hash, document, position).  The rows are
range-partitioned by hash and salt, sorted within partitions by document and
position and streamed by window functions that see first occurrences; a hash
that many documents share is dealt over ``SALTS`` sorted runs whose summaries are
merged afterwards.  What comes back is a sparse bitmap a document, 64 lines to
a word, words without a dropped line left out; texts move only where a caller
applies the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import lower_ascii, materialise, scratch, table

SALTS = 64
_BLANK = " \t\n\x0b\f\r"
_NO_ID = -(1 << 63)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a null-free order key and a hash that tells repeated ids apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, version, pos) of all lines whose key has ``min_chars`` code points."""
    rows = _keyed(df, id_col, text_col)
    rows = rows.select("doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc", "version", "pos", F.btrim("line", F.lit(_BLANK)).alias("line")).where(F.char_length("line") >= min_chars)
    rows = rows.withColumn("key", lower_ascii(F.col("line")))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "version", "pos")


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper): keys found in ``min_docs`` documents and the largest document of each."""
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    ranged = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("doc"), "pos")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"))
    first = ranged.withColumn("before", F.lag("doc").over(run)).where("before IS NULL OR before <> doc")
    runs = first.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    keys = runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return keys.where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def drop_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, version, dropped, n_dropped) of every document that loses lines.

    ``dropped`` maps a word's number to 64 bits, bit p of word w for line 64 w + p.
    Lines go if their key is in ``min_docs`` documents and not in a document of a
    larger id; rows that share an id are one document, a null id is smaller than
    any other.
    """
    lines = materialise(line_rows(df, id_col, text_col, min_chars), "lines")
    keys = materialise(repeated_keys(lines, min_docs), "repeated-keys")
    gone = lines.join(keys, ["h1", "h2"]).where("doc < keeper")  # adaptive execution splits a key of many lines
    words = gone.groupBy("doc", "version", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def _kept_text(text):
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: F.expr("0L") == _bit(i))
    return F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n"))


def _bit(i):
    word = F.coalesce(F.try_element_at(F.col("dropped"), F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document.

    Null and empty texts are one empty line; a document that loses all its lines
    keeps the empty text; repeated rows come back as often as they are there; an
    empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark, "line-bitmaps"):
        bitmaps = materialise(drop_bitmaps(docs), "line-bitmaps")
    rows = _keyed(docs, "doc_id", "text").withColumn("id", F.when(F.col("doc") != _NO_ID, F.col("doc")))
    rows = rows.join(bitmaps.hint("shuffle_hash"), ["doc", "version"], "left")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_kept_text(F.col("text")).cast("binary"), 256).alias("kept_sha256"),
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df with the dropped lines taken out of its texts, other columns as they are."""
    with scratch(df.sparkSession, "line-bitmaps"):
        bitmaps = materialise(drop_bitmaps(df, id_col, text_col, min_chars, min_docs), "line-bitmaps")
    bitmaps = bitmaps.select(F.col("doc").alias("__k_doc"), F.col("version").alias("__k_version"), "dropped")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    version = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__k_row"), doc.alias("__k_doc"), version.alias("__k_version"))
    joined = inner.join(bitmaps.hint("shuffle_hash"), ["__k_doc", "__k_version"], "left")
    return joined.select(*(
        _kept_text(F.col("__k_row")[c]).alias(c) if c == text_col else F.col("__k_row")[c].alias(c) for c in df.columns
    ))


SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND k.doc_id < r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

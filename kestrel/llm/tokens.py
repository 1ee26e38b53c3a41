"""Token counts through a digest cache.

Counts are keyed by the digest of the content and the digest of the tokenizer
file.  Texts whose key is in the cache are never encoded again; of the others
each distinct text is encoded once and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import materialise, shared_path, table, tune, worker_cache

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """texts -> token counts, as the file's own library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _first_seen(batches):
    """Drop repeats of a digest within the task, before anything is shuffled."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, digest in enumerate(batch.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def _encoder(path: str, version: str):
    def encode(batches):
        count = worker_cache(("count", path), lambda: _counter(path))
        for batch in _first_seen(batches):
            yield pa.RecordBatch.from_pydict({
                "digest": batch.column("digest"),
                "tokenizer": pa.array([version] * batch.num_rows, pa.string()),
                "n_tokens": pa.array(count(batch.column("text").to_pylist()), pa.int64()),
            })

    return encode


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str, cache_path: str) -> DataFrame:
    """Token count of every row's whole text; null counts as empty.

    ``cache_path`` is a Parquet table of schema CACHE in the shared folder; it is
    made if there is none, read for hits and appended to.  Two writers at once may
    store a key twice; readers take one.  Returns the id, n_bytes and n_tokens.
    """
    spark = df.sparkSession
    version = tokenizer_version(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)

    def stored():
        own = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
        return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    distinct = keyed.select("digest", "text").mapInArrow(_first_seen, "digest binary, text string").repartition("digest")
    misses = distinct.join(stored().select("digest").hint("shuffle_hash"), "digest", "left_anti")
    misses.mapInArrow(_encoder(path, version), CACHE).write.mode("append").parquet(cache_path)
    sized = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    counts = materialise(stored(), "token-counts")  # as a table, so that a digest of many rows can be split in the join
    return sized.join(counts, "digest").select("id", "n_bytes", "n_tokens")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the 32k piece vocabulary.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids
    come back as often as they are there; an empty table gives no rows.
    """
    tune(spark)
    counts = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("piece_bpe_32k.model"), shared_path(spark, "token-cache"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))

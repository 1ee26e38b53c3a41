"""A training corpus from raw documents: five stages, each over all the last one kept.

Language ID drops what is in no learned language; line dedup takes repeated lines
out of the texts; SimHash keeps one document of each near-duplicate group;
decontamination drops documents with benchmark passages; packing cuts the rest
into full windows.  All stages but the last return the columns they were given.
Nulls, empty texts, repeated rows and empty tables are treated as the operators
in kestrel.llm state: a null or letterless text is in no language and goes first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.llm.common import materialise, table, tune
from kestrel.llm.decontaminate import remove_contaminated
from kestrel.llm.language import reject_unknown
from kestrel.llm.lines import dedup_lines
from kestrel.llm.packing import pack, tokenise
from kestrel.llm.simhash import keep_one
from kestrel.llm.tokens import tokenizer_path

WINDOW = 1024


def language_stage(spark, docs, sf_dir):
    """Documents in a learned language; the filters are learned from this input's own labels."""
    return reject_unknown(docs, "lang", "text")


def lines_stage(spark, docs, sf_dir):
    """Documents without their repeated lines; n_chars follows the text where it is there."""
    kept = dedup_lines(docs, "doc_id", "text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in kept.columns else kept


def simhash_stage(spark, docs, sf_dir):
    """One document, that of the smallest id, of each near-duplicate group."""
    return keep_one(docs, "doc_id", "text")


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold no passage of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of full windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tune(spark)
    return pack(tokenise(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), WINDOW), WINDOW)


STAGES = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages train a language model and call a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

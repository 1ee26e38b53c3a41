"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from kestrel.llm import decontaminate, embeddings, language, lines, packing, sharding, simhash, tokens, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_sharding": sharding.op4_sharding,
    "op5_language": language.op5_language,
    "op6_urls": urls.op6_urls,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_lines": lines.op8_lines,
    "op9_tokens": tokens.op9_tokens,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLES = {
    "op1_warc": warc.SQL,
    "op4_sharding": sharding.sql(),
    "op6_urls": urls.SQL,
    "op7_embeddings": embeddings.SQL,
    "op8_lines": lines.SQL,
}

"""Shard placement through a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own permutation
(offset and skip from two hashes of its name); shards take turns, each claiming
the next free slot it prefers.  Placing a row is then one hash and one look into
the broadcast table, whose size is the prime and does not grow with the data.
Losing or adding a shard moves few rows besides its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import table

SLOTS = 4099
SHARDS = tuple(f"shard-{k:02d}" for k in range(32))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The table: slot -> index of its shard.  ``slots`` is a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table size must be a prime of at least the number of shards")
    offset = [_hash(f"offset|{s}") % slots for s in shards]
    skip = [_hash(f"skip|{s}") % (slots - 1) + 1 for s in shards]
    owner, tried, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for k in range(len(shards)):
            while owner[at := (offset[k] + tried[k] * skip[k]) % slots] >= 0:
                tried[k] += 1
            owner[at] = k
            tried[k] += 1
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, key_cols: list[str], shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, out: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """df with the slot and the shard of each row at its end; columns of df that have their names give way.

    Nulls in keys are a value of their own.  The table travels as a literal of one
    broadcast relation; there is no shuffle.
    """
    spark = df.sparkSession
    owner = fill_table(tuple(shards), slots)
    names = F.array(*(F.lit(s) for s in shards))
    filled = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("__k_slot", "__k_owner"))
    filled = filled.select(F.col("__k_slot").cast("long").alias("__k_slot"), F.element_at(names, F.col("__k_owner").cast("int") + 1).alias("__k_shard"))
    key = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in key_cols))
    slot = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))
    placed = df.withColumn("__k_at", slot).join(F.broadcast(filled), F.col("__k_at") == F.col("__k_slot"))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns if c not in out), F.col("__k_slot").alias(out[0]), F.col("__k_shard").alias(out[1]))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document.

    Rows with the same id, null ids among them, go to the same shard; an empty
    table gives no rows.  The id is the key, so a hot source is spread evenly.
    """
    return place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def sql() -> str:
    owner = fill_table(SHARDS, SLOTS)
    names = ", ".join(f"'{SHARDS[k]}'" for k in owner)
    return f"""
WITH t AS (SELECT [{names}] AS shards),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1] AS shard FROM d, t
"""

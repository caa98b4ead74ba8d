"""Sharding by a permutation-filled lookup table.

The shards take turns: each claims the next free slot of a prime-sized table in
the order of its own permutation (offset and skip from a hash of its name). A
key's slot is its hash modulo the table size, so placement is one lookup, loads
differ by at most one slot, and removing a shard moves few keys besides its
own. The table is small and of fixed size, so it is broadcast.

Defined results: rows with equal keys go to one shard; a null key is replaced
by the row's text hash, so that missing keys don't pile up in one shard; null
texts too then share a slot. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import need, table

#: Slots: a prime, over a hundred times the number of shards.
TABLE_SIZE = 8191
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Per slot the number of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime not below the number of shards")
    place = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while slots[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            slots[place[i]] = i
            free -= 1
            if not free:
                break
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a string key: 60 bits of its MD5 modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(
    rows: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """Adds slot, shard (number) and shard_name to rows; key is a string column.

    The broadcast side always has ``size`` rows.
    """
    slots = lookup_table(shards, size)
    lookup = rows.sparkSession.createDataFrame(
        [(i, s, shards[s]) for i, s in enumerate(slots)], "slot long, shard int, shard_name string"
    )
    return rows.withColumn("slot", slot_of(key, size)).join(F.broadcast(lookup), "slot")


def shard_documents(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, slot, shard, shard_name per document, placed by doc_id."""
    rows = need(docs, doc_id="long", text="string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    placed = place(rows.select("doc_id", key.alias("key")), F.col("key"), shards, size)
    return placed.select("doc_id", "slot", "shard", "shard_name")


def shard_loads(placed: DataFrame) -> DataFrame:
    """Rows per shard, combined before the shuffle."""
    return placed.groupBy("shard", "shard_name").agg(F.count(F.lit(1)).alias("n_rows"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (SELECT [%s] AS slots),
p AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT
         %% %d)::BIGINT AS slot
  FROM documents)
SELECT doc_id, slot, slots[slot + 1]::INTEGER AS shard,
       'shard-' || lpad(slots[slot + 1]::VARCHAR, 2, '0') AS shard_name
FROM p, t
""" % (", ".join(map(str, lookup_table())), TABLE_SIZE)

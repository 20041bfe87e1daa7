"""Sharding by a permutation-filled lookup table (operator 8).

Every shard has a preference order over the slots of a table of prime size: an offset and a
step, from hashes of its name, run through all slots. Shards take turns; at its turn a shard
claims the first slot of its order that is still free. Shards so own equal parts of the table
to within one slot, and adding or removing a shard moves few others. A row's slot is its
key's hash modulo the size; a broadcast of the table, ``size`` rows of two integers whatever
the data, gives its shard without a shuffle.

A row's key is its doc_id, or its text where that is null; with both null it is empty. Equal
keys share a shard. Very long texts cost one hash. Extra columns are kept by ``placed``; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import documents

SLOTS, SHARDS = 65_537, 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SLOTS) -> list[int]:
    """The index in ``shards`` of the owner of each slot."""
    if not shards or len(set(shards)) < len(shards) or not _is_prime(size) or size < len(shards):
        raise ValueError("shards must be distinct, and fewer than the slots, which must be a prime number")
    hashed = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(h[:8], "big") % size for h in hashed]
    step = [int.from_bytes(h[8:16], "big") % (size - 1) + 1 for h in hashed]
    table, filled = [-1] * size, 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            filled += 1
            if filled == size:
                return table


def placed(docs: DataFrame, shards: list[str], size: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (replacing columns of these names)."""
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot long, shard int")
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % size
    return docs.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot").select(*[f"`{c}`" for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(documents(spark, sf_dir).select("doc_id", "text"), shard_names()).select("doc_id", "slot", "shard")


def oracle() -> str:
    """The placement in SQL, the lookup table as a list."""
    return f"""
WITH t AS (SELECT {lookup_table(shard_names())} AS x),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, x[slot + 1]::INT AS shard FROM d, t
"""

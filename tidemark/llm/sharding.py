"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has its own preference order of the slots of a table of prime size (an offset and a step taken from the hash of
its name).  The shards take turns, each claiming the first slot of its order that is free, until the table is full; so the
shards' shares differ by one slot at most, and when a shard joins or leaves, few keys move between the others.  A key's
slot is its hash modulo the size of the table, and one broadcast of the table places every row, whatever the data.

The table has ``slots`` rows, a parameter: that bounds what is broadcast.  A null key counts as the empty string, a key of any
length is hashed whole.  Equal keys and repeated rows share a shard; there are no ties, since each slot has one owner; no row is
dropped; an empty input gives an empty result.  Input columns of any name keep their values; one that carries the name of an
added column is returned with ``_in`` after its name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside

SLOTS = 65_537


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that claimed each slot; ``slots`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards) or slots < max(2, len(shards)) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("distinct shards and a prime number of slots, at least as many, are needed")
    orders = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        orders.append([int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1])
    owner, free = [-1] * slots, slots
    while free:
        for k, order in enumerate(orders):
            slot, step = order
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot] = k
            order[0] = (slot + step) % slots
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the MD5 of the key as text, modulo the size of the table."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % slots


def lookup_table(spark, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Columns slot and shard_index."""
    owners = ",".join(map(str, fill_table(shards, slots)))
    table = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return table.select(F.col("slot").cast("bigint").alias("slot"), F.col("owner").cast("int").alias("shard_index"))


def assign(df: DataFrame, key_col: str, shards: list[str], *, slots: int = SLOTS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Adds the slot and the shard's name to each row."""
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias("t"), F.get(names, F.col("shard_index")).alias("owner"))
    rows = df.select(F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), slot_of(F.col(key_col), slots).alias("s"))
    joined = rows.join(F.broadcast(table), F.col("s") == F.col("t"))
    return joined.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(beside(df.columns, [slot_col, shard_col]))], F.col("s").alias(slot_col), F.col("owner").alias(shard_col))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder per shard; every task writes its own files, so a large shard is written by many tasks."""
    df.write.partitionBy(shard_col).mode("errorifexists").parquet(path)


def oracle(shards: list[str], slots: int = SLOTS) -> str:
    owners = ",".join(map(str, fill_table(shards, slots)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owner, [{names}] AS names),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {slots} AS slot FROM documents)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, names[CAST(owner[slot + 1] AS INTEGER) + 1] AS shard FROM d, t
"""

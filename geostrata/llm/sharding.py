"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size. The shards take
turns, each claiming its next free slot, until none is free; so their shares differ by one slot at
most, and adding or removing a shard moves few slots. A row's slot is a hash of its key modulo the
table's size. The table is a broadcast of ``size`` rows, whatever the input; placing is a map-side
hash probe without a shuffle, so a key that holds a third of the rows costs no more than others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import read_table

#: Slots; a prime, over a hundred a shard at the default number of shards.
TABLE_SIZE = 8191
SHARDS = 64
#: The broadcast is refused beyond this many slots (some 10 MB).
MOST_SLOTS = 1_000_003


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def fill_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's index for each slot."""
    if size > MOST_SLOTS or size < max(2, len(names)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table needs a prime size from the number of shards to {MOST_SLOTS}")
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need names that differ")
    digests = [hashlib.md5(x.encode()).digest() for x in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def lookup_frame(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard, shard_name), made by JVM-side expressions from one literal."""
    table = ",".join(map(str, fill_table(names, size)))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard"))
    name = F.element_at(F.split(F.lit(",".join(names)), ","), F.col("shard").cast("int") + 1)
    return slots.select(F.col("slot").cast("long"), F.col("shard").cast("int"), name.alias("shard_name"))


def place(df: DataFrame, key: str, names: list[str] | None = None, size: int = TABLE_SIZE, spread_by: str | None = None) -> DataFrame:
    """(key, slot, shard, shard_name) for each row of df, repeated rows included.

    The slot is the first 32 bits of the MD5 of the key's text modulo size. A null key takes the text
    of ``spread_by`` instead (so that rows without a key do not meet on one shard), or else ''. Other
    columns of df are ignored, whatever their names; an empty df gives no rows.
    """
    text = F.coalesce(F.col(key).cast("string"), *([F.col(spread_by).cast("string")] if spread_by else []), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % size
    keyed = df.select(F.col(key), slot.alias("slot"))
    found = keyed.join(F.broadcast(lookup_frame(df.sparkSession, names or shard_names(SHARDS), size)), "slot")
    return found.select(key, "slot", "shard", "shard_name")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read_table(spark, sf_dir, "documents"), "doc_id", spread_by="text")


def sql() -> str:
    table = ",".join(map(str, fill_table(shard_names(SHARDS))))
    return f"""
WITH lookup AS (SELECT unnest(string_split('{table}', ',')) AS shard, unnest(range({TABLE_SIZE})) AS slot),
keyed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, CAST(shard AS INTEGER) AS shard, 'shard-' || lpad(shard, 4, '0') AS shard_name FROM keyed JOIN lookup USING (slot)"""

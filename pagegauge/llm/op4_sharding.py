"""Operator 4: sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SHARDS = [f"shard-{i:02d}" for i in range(24)]
SLOTS = 10007


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (index in ``shards``) of each of ``slots`` slots.

    Each shard has a preference order of all slots, a permutation (offset + j * skip) mod slots from its name alone;
    shards take turns, each claiming its best free slot. Work and size depend on the parameters only, not on data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, and at least the number of shards")
    owner = [-1] * slots
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    free, turn = slots, 0
    while free:
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        owner[at[i]] = i
        free -= 1
        turn += 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of its MD5 digest modulo the table's size; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with the columns slot (long), shard_no (int) and shard (string); no shuffle.

    Placement depends on the key alone, so a hot source spreads over all shards, and a changed list of shards moves
    about the share of keys that it has to. Rows without a key go by the digest of their text, so they spread, too (null
    texts as empty ones; without a column ``text``, to the slot of the empty key); repeated keys go together; an empty
    table stays empty. Columns named slot, shard_no or shard in ``docs`` are replaced.
    """
    shards = SHARDS if shards is None else shards
    own = F.col(key).cast("string")
    if text in docs.columns:
        own = F.coalesce(own, F.md5(F.coalesce(F.col(text), F.lit(""))))
    owner = ",".join(map(str, lookup_table(shards, slots)))
    names = F.split(F.lit("\x01".join(shards)), "\x01")
    spark = docs.sparkSession
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(owner), ","))).select(F.col("pos").cast("long").alias("slot"), F.col("col").cast("int").alias("shard_no"))
    docs = docs.drop("slot", "shard_no", "shard").withColumn("slot", slot_of(own, slots))
    # the table has `slots` rows of two numbers whatever the input, so broadcasting it is bounded
    placed = docs.join(F.broadcast(lookup), "slot")
    return placed.select(*docs.columns, "shard_no", F.element_at(names, F.col("shard_no") + 1).alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


ORACLE = f"""
WITH owner AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(string_split('{",".join(map(str, lookup_table(SHARDS)))}', ',')) AS shard_no
), placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
)
SELECT doc_id, p.slot, CAST(shard_no AS INTEGER) AS shard_no, 'shard-' || lpad(shard_no, 2, '0') AS shard
FROM placed p JOIN owner o ON o.slot = p.slot
"""

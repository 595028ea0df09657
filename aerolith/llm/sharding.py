"""Placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: offset + k x skip. Shards take turns, each
claiming its first free slot, until the table is full, so shards own equally many slots give or take one, and adding or
removing a shard moves little else. Placing a row is one hash and one look-up in the table, which has `slots` rows whatever
the data (65,537 small numbers by default: about 1 MB) and is therefore broadcast.

Defined results: a null key is a key of its own; equal keys go to one shard; a hot key goes to one shard by definition,
so shard by a key that is nearly unique (the query uses doc_id); an empty table gives an empty result; columns of the
input stay unless they are named slot or shard, which are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (place in `shards`) of each slot."""
    if not is_prime(slots):
        raise ValueError(f"{slots} is not a prime: a shard's preference order would not reach every slot")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give different shard names, at least one and at most one per slot")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    """Slot of a row: 60 bits of the MD5 of its keys as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): `slots` rows."""
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.createDataFrame([(n, o) for n, o in enumerate(fill(shards, slots))], "slot int, owner int")
    return table.select("slot", F.get(names, F.col("owner")).alias("shard"))


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows with their slot and shard."""
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(keys, slots))
    return rows.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot")


def report(placed: DataFrame, size: str | None = None) -> DataFrame:
    """Rows, slots in use and summed size of each shard."""
    total = F.sum(F.col(size)) if size else F.count(F.lit(1))
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("slot").alias("n_slots"), total.alias("total"))

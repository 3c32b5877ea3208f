"""Placement of keys on shards by a permutation-filled lookup table, in DataFrame functions.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its name. The
shards take turns: each claims the first slot of its permutation that is still free, until all slots are
taken. A key's hash picks a slot, and the slot's entry is its shard: constant time a row, by a join with the
broadcast table. The table has a fixed number of slots, whatever the data; shares differ by at most one slot,
and taking a shard away moves few keys besides its own. A shard with weight w claims w slots in its turn.

Defined results: rows with a null key are placed by an empty key; rows that repeat a key go to the same
shard; an empty table gives an empty result. Columns of the rows that are named slot or shard, in either case of
letters and also where they are the key, are replaced by the result's; all others stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537  # prime


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], *, slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Shard index of each slot. ``slots`` is prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, at least one")
    if slots < 2 or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be a prime that is not below the number of shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("every shard needs a whole weight of at least 1")
    at = [_number("offset:" + name) % slots for name in shards]
    skip = [_number("skip:" + name) % (slots - 1) + 1 for name in shards]
    table, free = [-1] * slots, slots
    while free:
        for shard, weight in enumerate(weights):
            for _ in range(min(weight, free)):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % slots
                table[at[shard]] = shard
                free -= 1
    return table


def place(rows: DataFrame, key: str, shards: list[str], *, slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """The rows with slot (long) and shard (name)."""
    table = lookup_table(shards, slots=slots, weights=weights)
    names = F.split(F.lit(",".join(map(str, table))), ",")
    entries = rows.sparkSession.range(1).select(F.posexplode(names).alias("slot", "index")).select(
        F.col("slot").cast("long").alias("slot"),
        F.element_at(F.array(*[F.lit(name) for name in shards]), F.col("index").cast("int") + 1).alias("shard"))
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots
    # the table has ``slots`` rows of two short columns: about 1 MB, fixed by the parameter
    placed = rows.withColumn("__slot", slot).drop("slot", "shard").withColumnRenamed("__slot", "slot")
    return placed.join(F.broadcast(entries), "slot").select(
        *[f"`{c}`" for c in rows.columns if c.lower() not in ("slot", "shard")], "slot", "shard")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"))

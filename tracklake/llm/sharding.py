"""Sharding by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by its own permutation
(offset and stride from a hash of its name).  Shards take turns; at its turn a
shard claims its best slot that is still free.  The full table is broadcast and
a row is placed by one hash and one look-up.  Slots per shard differ by at most
one, and adding or removing a shard moves few slots besides its own.

The table has ``100 * shards`` slots at least, a number that does not grow with
the data, so the broadcast has a fixed size.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import portable_hash

SLOTS_PER_SHARD = 100
MAX_SLOTS = 1_000_000


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def table_size(n_shards: int) -> int:
    """Smallest prime of at least SLOTS_PER_SHARD slots a shard."""
    size = max(3, n_shards * SLOTS_PER_SHARD)
    while any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        size += 1
    return size


def lookup_table(shards: list[str], slots: int | None = None) -> list[int]:
    """Index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    slots = slots or table_size(len(shards))
    if not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"{slots} slots for {len(shards)} shards; at most {MAX_SLOTS}")
    number = lambda salt, name: int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:15], 16)
    at = [number("offset", s) % slots for s in shards]
    stride = [number("stride", s) % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def assign_shards(docs: DataFrame, key: Column, shards: list[str], slot_column: str = "shard_slot", shard_column: str = "shard") -> DataFrame:
    """``docs`` with the slot and the shard name of ``key``.

    Nulls in the key count as the empty text, so all rows without a key share a slot; rows with equal keys always meet
    in one shard; a key may be of any length and any type that has a text; an empty table gives an empty table; columns
    of these two names are replaced, other extra columns stay.  No shuffle.
    """
    owner = lookup_table(shards)
    spark = docs.sparkSession
    slots = (
        spark.range(1)
        .select(F.posexplode(F.from_json(F.lit(json.dumps(owner)), "array<int>")).alias(slot_column, "_owner"))
        .select(slot_column, F.element_at(F.from_json(F.lit(json.dumps(shards)), "array<string>"), F.col("_owner") + 1).alias(shard_column))
    )
    kept = docs.drop(shard_column).withColumn(slot_column, (portable_hash(key) % len(owner)).cast("int"))
    return kept.join(F.broadcast(slots), slot_column)

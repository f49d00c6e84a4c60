"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: start and step come from two hashes of its name.
Shards take turns; at its turn a shard claims the first free slot of its order (as often as its whole-number weight says). The filled table
gives every key its shard by one lookup, and if a shard goes, the keys of the others hardly move. The table has `slots` rows whatever
the data (that is the bound on what is broadcast), and placing needs no shuffle.

Defined cases: a null key has the slot of one fixed hash, like any other key; equal keys always share a shard; an empty table
gives an empty result; more shards than slots, a repeated name or a weight below 1 raise. Columns `slot` and `shard` are
replaced, others are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The index of the shard that owns each slot."""
    weights = weights or [1] * len(names)
    if not names or len(set(names)) != len(names) or len(names) > slots or min(weights) < 1 or not _is_prime(slots):
        raise ValueError("shards need distinct names, weights of 1 or more, and a prime number of slots that isn't below theirs")
    digests = [hashlib.sha256(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    table, left = [-1] * slots, slots
    while left:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                slot, by = at[shard], step[shard]
                while table[slot] >= 0:
                    slot = (slot + by) % slots
                table[slot], at[shard], left = shard, (slot + by) % slots, left - 1
    return np.array(table, np.int32)


def place(df: DataFrame, key, names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """df with slot and shard."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, names[s]) for i, s in enumerate(lookup(names, slots, weights).tolist())], "slot int, shard string")
    df = df.select(*[c for c in df.columns if c not in ("slot", "shard")])
    return df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).join(F.broadcast(table), "slot").select(*df.columns, "slot", "shard")


def write(df: DataFrame, key, names: list[str], path: str, **how) -> None:
    """One folder a shard. Rows aren't shuffled: each task writes what it has of each shard."""
    place(df, key, names, **how).drop("slot").write.partitionBy("shard").parquet(path)

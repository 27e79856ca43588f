"""Operator 10, sharding: a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size, ``offset + j * skip``.  The
shards take turns claiming the first slot of their permutation that is still free, until all are taken;
so each gets the same number of slots, give or take one, and adding or losing a shard moves few others.
The table has ``size`` rows, a parameter and not a function of the data, and is broadcast: placing a row
is a hash and a lookup, with no shuffle.

Null keys share one slot (the hash's of null).  Empty input gives empty output.  Repeated rows go to one
shard.  Columns other than the key are passed through; columns named ``slot``, ``shard`` or
``shard_name`` are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIZE = 65_537


def _number(text: str, n: int) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little") % n


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The shard's index for each of ``size`` slots (a prime, larger than the number of shards)."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size <= len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime above the number of shards")
    at = [_number("offset:" + s, size) for s in shards]
    skip = [_number("skip:" + s, size - 1) + 1 for s in shards]
    out, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while out[slot] >= 0:
                slot = (slot + skip[i]) % size
            out[slot], at[i] = i, (slot + skip[i]) % size
            free -= 1
            if not free:
                break
    return np.array(out, np.int32)


def shard_rows(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with the slot, shard index and shard name of every row."""
    spark = df.sparkSession
    slots = spark.createDataFrame(
        [(s, int(i), shards[i]) for s, i in enumerate(lookup_table(shards, size))], "slot int, shard int, shard_name string"
    )
    placed = df.drop("slot", "shard", "shard_name").withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("int"))
    return placed.join(F.broadcast(slots), "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard, shard_name of every document, over 96 shards."""
    names = [f"shard-{i:03d}" for i in range(96)]
    placed = shard_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", names)
    return placed.select("doc_id", "slot", "shard", "shard_name")

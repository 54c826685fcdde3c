"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime number of slots; at least a hundred for each shard keeps the shards even within a percent.
SLOTS = 65537
SHARDS = 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot.

    Each shard prefers the slots in the order offset, offset + skip, offset + 2 skip ... modulo the prime number of slots,
    which is a permutation. The shards take turns; each claims the first slot of its order that is free.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    at = [_number(f"offset {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards] if slots > 1 else [1]
    out, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            out[at[i]] = i
            free -= 1
            if not free:
                break
    return out


def shard(docs: DataFrame, *, id_col: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """Place every row by its id: doc_id, slot, shard (number), shard_name.

    The slot is a hash of the id modulo the slots; the table (``slots`` rows, whatever the input) is broadcast, so placing
    moves no row. If a shard leaves, few rows beside its own change place. Rows of equal id go together; a null id
    hashes as the empty text. An empty table gives no rows; other columns are ignored.
    """
    shards = shards if shards is not None else [f"shard-{i:04d}" for i in range(SHARDS)]
    spark = docs.sparkSession
    rows = [(slot, i, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))]
    places = spark.createDataFrame(rows, "slot int, shard int, shard_name string")
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15)
    slot = (F.conv(digits, 16, 10).cast("long") % F.lit(slots)).cast("int")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), slot.alias("slot"))
    return keyed.join(F.broadcast(places), "slot").select("doc_id", "slot", "shard", "shard_name")

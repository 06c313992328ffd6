"""Sharding by a permutation-filled lookup table (DataFrame functions only).

Every shard owns a permutation of the slots of a prime-sized table, given by
an offset and a skip taken from the md5 of its name.  The shards take turns:
each claims the first slot of its own permutation that nobody has claimed,
until the table is full.  Every shard ends up with ``size // n`` or
``size // n + 1`` slots, and adding or removing a shard moves few slots.

A row is placed in constant time: hash of its key modulo the table size, then
one lookup in the table, which is broadcast.  The table has ``size`` rows
whatever the input is, and ``MAX_SIZE`` bounds it; rows never move.

Edge cases: a null key is a value of its own and gets one slot; an empty key
differs from null; equal keys always share a shard; repeated rows stay; an
empty table gives an empty result; other columns pass through, and a column
called like an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters of the registered query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
TABLE_SIZE = 65537
#: Largest table that is broadcast (rows of two small integers).
MAX_SIZE = 1 << 21


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Slot -> index into ``shards``; the shards take turns by preference order."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not _is_prime(size) or size < len(shards) or size > MAX_SIZE:
        raise ValueError(f"table size must be a prime from the shard count to {MAX_SIZE}")
    at = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % size
        table[at[i]] = i
    return table


def shard(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE,
          slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """``df`` with the slot of ``key`` and the name of the shard that owns it."""
    table = fill_table(shards, size)
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):  # no column of df begins like these two
        mark += "_"
    at, owner = f"{mark}slot", f"{mark}shard"
    lookup = (df.sparkSession.range(1)
              .select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias(at, owner))
              .select(at, F.element_at(F.array(*map(F.lit, shards)), F.col(owner).cast("int") + 1).alias(owner)))
    tagged = F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n"))
    digest = F.conv(F.substring(F.md5(tagged), 1, 15), 16, 10).cast("long")
    keep = [c for c in df.columns if c not in (slot_column, shard_column)]
    return (df.withColumn(at, F.pmod(digest, F.lit(size)).cast("int"))
            .join(F.broadcast(lookup), at)
            .select(*keep, F.col(at).alias(slot_column), F.col(owner).alias(shard_column)))

"""Sharding: a permutation-filled lookup table for constant-time placement.

Each shard has a preference order of the slots of a prime-sized table: it starts at an offset
and goes on by a skip, both hashes of its name, which visits every slot. The shards take turns,
each claiming the first slot of its order that is free, until the table is full. A key belongs
to the shard of slot hash(key) mod size. Slots are shared out within one of each other, and
adding or removing a shard moves few keys beyond its own.

The table has a fixed size whatever the data, so it goes to the executors as a literal array:
placement is one md5 and one array access in generated code, with no shuffle and no Python.

Defined results: a null key is placed as the empty string is; equal keys go to equal shards;
repeated rows stay; an empty table gives no rows; further columns don't matter, whatever their
names; no shards, repeated names or a table size that isn't a prime over the number of shards
are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 6553
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, size: int = SIZE) -> tuple[int, int]:
    """Offset and skip of a shard."""
    return _number(f"offset:{name}") % size, _number(f"skip:{name}") % (size - 1) + 1


def fill(shards: Sequence[str], size: int = SIZE) -> np.ndarray:
    """The shard's number in each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, one at least")
    if not _prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, at least the number of shards")
    orders = [preference(s, size) for s in shards]
    table, step, filled = np.full(size, -1, np.int32), [0] * len(shards), 0
    while filled < size:
        for i, (offset, skip) in enumerate(orders):
            while table[slot := (offset + step[i] * skip) % size] >= 0:
                step[i] += 1
            table[slot] = i
            filled += 1
            if filled == size:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def with_shard(df: DataFrame, key: Column, column: str, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """df with the number of the shard that the key belongs to."""
    literal = F.expr(f"array({', '.join(map(str, fill(shards, size)))})")  # one text: a literal for each number takes seconds
    return df.withColumn(column, F.get(literal, slot_of(key, size)).cast("int"))


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """A row for each document: doc_id, slot, shard."""
    d = docs.select("doc_id")
    return with_shard(d, d["doc_id"], "shard", shards, size).select("doc_id", slot_of(d["doc_id"], size).alias("slot"), "shard")

"""Placement on shards by a permutation-filled lookup table.

The table has a prime number of slots. Every shard has an order of preference over all slots,
a walk with its own start and step; shards take turns, and at its turn a shard claims the first
slot in its order that is free. A key's hash names a slot and the slot names the shard: one
lookup, whatever the number of keys. Shards get equal numbers of slots, give or take one, and
when a shard leaves, most slots keep their owner.

The table is a plan of fixed size (``table_size``), made once on the driver from the shard
names; data rows are only hashed and looked up by a broadcast join of that many rows. A hot
column value does not matter: placement is by key, and every row finds its shard by itself.

Defined cases: a null key is placed like the empty string. Equal keys have one place. An empty
frame stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuity.llm.columns import column, free_name

# Slots for each shard, at least: sizes then differ by less than a hundredth.
SLOTS_PER_SHARD = 100


def _number(text: str) -> int:
    """The first 60 bits of a digest: a number that every engine can make."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def prime_at_least(n: int) -> int:
    n = max(n, 3) | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def lookup_table(shards: Sequence[str], table_size: int | None = None) -> list[int]:
    """For each slot the position of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names")
    size = prime_at_least(len(shards) * SLOTS_PER_SHARD) if table_size is None else table_size
    if size < len(shards) or prime_at_least(size) != size:
        raise ValueError("the table size must be a prime not below the number of shards")
    at = [_number(f"{s}:start") % size for s in shards]
    step = [_number(f"{s}:step") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % size
        table[at[shard]] = shard
    return table


def slot_of(key: Column, table_size: int) -> Column:
    """The slot that a key's hash names."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(table_size))


def _table_frame(spark: SparkSession, table: Sequence[int], slot: str, shard: str) -> DataFrame:
    """The table as rows, from one literal."""
    listed = F.split(F.lit(",".join(map(str, table))), ",")
    rows = spark.range(1).select(F.posexplode(listed).alias(slot, shard))
    return rows.select(column(slot).cast("bigint"), column(shard).cast("int"))


def place(
    df: DataFrame,
    key: str,
    shards: Sequence[str],
    table_size: int | None = None,
    slot: str = "slot",
    shard: str = "shard",
) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` (the position in ``shards``)."""
    taken = {name.lower() for name in df.columns}
    if slot.lower() in taken or shard.lower() in taken:
        raise ValueError(f"column exists: {slot} or {shard}")
    table = lookup_table(shards, table_size)
    # As many rows as the table has slots: bounded by a parameter.
    frame = F.broadcast(_table_frame(df.sparkSession, table, slot, shard))
    return df.withColumn(slot, slot_of(column(key), len(table))).join(frame, slot).select(
        *[column(c) for c in df.columns], column(slot), column(shard)
    )


def write_shards(
    df: DataFrame, path: str, key: str, shards: Sequence[str], files: int = 1, **options
) -> None:
    """Write ``df`` as Parquet below ``path``, one folder for each shard, about ``files`` files
    in each. Slots, not shards, are dealt to tasks, so a shard may be written by several."""
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    placed = place(df, key, shards, slot=slot, shard=shard, **options)
    part = F.pmod(column(slot), F.lit(files))
    spread = placed.repartition(len(shards) * files, column(shard), part).drop(slot)
    spread.write.partitionBy(shard).parquet(path)

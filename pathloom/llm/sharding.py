"""Shards of rows by a permutation-filled lookup table, in DataFrame operations.

Method. Every shard prefers the slots of a prime-sized table in an order of its own, a permutation made of an
offset and a step from hashes of its name. Shards take turns; at its turn a shard claims the next slot of
its order that is free, until the table is full. So shards hold equally many slots, but for one, and when a
shard is added or removed few slots change hands. A row's slot is a hash of its key modulo the table size;
the table is broadcast: it has ``size`` rows, whatever the data.

Cases. A null key is hashed as the text ``\\N``, so null keys share a slot unless ``spread`` names columns: rows
whose key is null, or in ``hot``, are placed by a hash of these columns as well, which spreads a key that
holds a large share of all rows. Equal rows go to one shard. An empty table gives an empty table. The
result's own columns are added last; an input column of such a name is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """Number of the shard that holds each slot. ``size`` is a prime well above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is no prime of at least {len(shards)}")
    at = [_number(f"offset {s}") % size for s in shards]
    step = [_number(f"step {s}") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: the first 32 bits of its MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size))


def table_frame(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """``slot``, ``shard`` and ``shard_name`` of the lookup table."""
    rows = [(slot, shard, shards[shard]) for slot, shard in enumerate(lookup_table(shards, size))]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = SIZE, hot: list | None = None, spread: list[str] | None = None) -> DataFrame:
    """``df`` with ``slot``, ``shard`` and ``shard_name``."""
    clash = {"slot", "shard", "shard_name"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    place = F.col(key).cast("string")
    if spread:
        loose = F.col(key).isNull() | (F.col(key).isin(*hot) if hot else F.lit(False))
        salt = F.md5(F.to_json(F.struct(*spread)).cast("binary"))
        place = F.when(loose, F.concat(F.coalesce(place, F.lit("\\N")), F.lit("/"), salt)).otherwise(place)
    # bounded by `size` rows, not by the data
    table = F.broadcast(table_frame(df.sparkSession, shards, size))
    return df.withColumn("slot", slot_of(place, size)).join(table, "slot").select(*df.columns, "slot", "shard", "shard_name")

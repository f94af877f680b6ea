"""Sharding by a permutation-filled lookup table (the scheme known from load balancers as Maglev hashing).

Every shard has its own preference order over the slots of a table of prime size, ``(offset + k * skip) mod size``. Shards take
turns, each claiming its next free slot, until the table is full. A row goes to the shard that holds the slot of its
key's hash. Shares differ by at most one slot, and when a shard goes, few rows of the others move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 16381  # prime; about 100 slots or more for each shard keep shares even


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position in ``shards`` of the shard that claimed it. Names must be distinct; their order breaks ties."""
    if not _is_prime(size):
        raise ValueError("the table size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("need distinct shards, at least one and no more than slots")
    offsets = [_number(f"offset:{s}") % size for s in shards]
    skips = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, left = np.full(size, -1, dtype=np.int64), size
    at = list(offsets)
    while True:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skips[s]) % size
            table[at[s]] = s
            left -= 1
            if not left:
                return table.tolist()


def slot_of(key: Column | str, size: int = TABLE_SIZE) -> Column:
    """Slot of a key's text: 60 bits of its MD5, modulo the table size. NULL counts as the empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, name: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with the ``slot`` and ``shard`` of each row; columns of those names are replaced.

    The lookup table has ``size`` rows whatever the data, so it is broadcast; rows are not shuffled. Equal keys meet in one
    shard, NULL keys in that of the empty text. An empty table gives an empty table.
    """
    spark = df.sparkSession
    owners = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(fill_table(shards, size))], f"`{slot}` int, `{name}` string")
    kept = [c for c in df.columns if c not in (name, slot)]
    return df.select(*kept).withColumn(slot, slot_of(key, size)).join(F.broadcast(owners), slot).select(*kept, slot, name)


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str], size: int = TABLE_SIZE, files: int = 1) -> None:
    """Write each shard to its own folder ``shard=<name>``, in ``files`` files that share its rows by slot and row order.

    A shard's rows are spread over ``files`` tasks by a hash of all their values, so a key that holds much of the table does
    not end in one file unless ``files`` is 1, and a task that runs again deals its rows as before. Equal rows meet in one file.
    """
    placed = assign_shards(df, key, shards, size)
    plain = [c for c in placed.columns if c not in ("slot", "shard")]
    file = "_file"
    while file in placed.columns:
        file += "_"
    spread = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in plain]), F.lit(files))
    placed.withColumn(file, spread).repartition(len(shards) * files, "shard", file).drop(file, "slot").write.partitionBy("shard").parquet(path)


SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def shard_sql(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    """The placement of ``documents`` as SQL: slots by MD5, and the claims of the shards as a list."""
    owners = ", ".join(map(str, fill_table(shards, size)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""WITH placed AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size})::INTEGER AS slot FROM documents),
held AS (SELECT [{owners}] AS owners, [{names}] AS names)
SELECT doc_id, slot, names[owners[slot + 1] + 1] AS shard FROM placed, held"""

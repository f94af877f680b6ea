"""Dense row identity (0..n-1) without a single-partition sort, and paging on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"
PAGE_SIZE = 10  # fixed value: rows shown per page
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def orderable_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def add_row_id(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = ROW_ID,
    unique: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows densely in the order of ``order_by``.

    One range shuffle sorts the rows; the offset of each partition comes from the
    partition counts, so no task ever sees more than its own range. The sorted rows are
    persisted because both passes must see the same ranges; a lost block is rebuilt
    from the same range partitioner. ``order_by`` must identify a row; otherwise pass
    ``unique=False`` and every other orderable column breaks the ties.
    """
    keys = list(order_by)
    if not unique:
        named = {k for k in keys if isinstance(k, str)}
        keys += [c for c in orderable_columns(df) if c not in named]
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .persist()
    )
    part = F.shiftright("_mid", _PARTITION_BITS)
    counts = {r["_p"]: r["n"] for r in ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    start = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]]), (part + 1).cast("int"))
    return ranged.withColumn(name, local + start).drop("_mid")


def reset_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Close the gaps left by dropped rows, keeping the order."""
    renamed = df.withColumnRenamed(name, "_old_id")
    return add_row_id(renamed, ["_old_id"], name).drop("_old_id")


def page(df: DataFrame, number: int, size: int = PAGE_SIZE, pos: str = ROW_ID) -> DataFrame:
    """One page of a densely numbered table; the page number is clamped to what exists."""
    total = df.agg((F.max(pos) + 1).alias("n")).first()["n"] or 0
    last = (total - 1) // size + 1 if total > 0 else 1
    number = min(max(number, 1), last)
    return df.filter(F.col(pos).between((number - 1) * size, number * size - 1))


def filter_positions(df: DataFrame, selection: str, pos: str = ROW_ID) -> DataFrame:
    """Rows at position ``"i"`` or in the closed range ``"a-b"`` (end clamped)."""
    last = df.agg(F.max(pos).alias("m")).first()["m"]
    last = -1 if last is None else last
    parts = [p.strip() for p in selection.strip().split("-")]
    if len(parts) > 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"expected a position or a range such as '5' or '5-10', got {selection!r}")
    first, end = int(parts[0]), int(parts[-1])
    if first > end:
        raise ValueError("range start lies behind its end")
    if first > last:
        raise ValueError(f"position {first} exceeds the last position {last}")
    return df.filter(F.col(pos).between(first, min(end, last)))

"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
BATCH_ROWS = 500


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if the bytes of its values, measured, stay below ``limit``; else Spark shuffles it."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 16).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= limit else df


def private_names(columns: Sequence[str], *stems: str) -> list[str]:
    """Names for columns made on the way: the stems, lengthened alike until none of them is one of ``columns``."""
    taken, tail = {c.lower() for c in columns}, ""
    while any((stem + tail).lower() in taken for stem in stems):
        tail += "_"
    return [stem + tail for stem in stems]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups, and where each group begins, from batches sorted by integer ``keys``.

    At most a batch and a group are held at a time, so groups must be of bounded size.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.concat_batches([held, batch])
        columns = [batch.column(k).to_numpy() for k in keys]
        begin = np.append(0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1)
        if len(begin) > 1:
            yield batch.slice(0, int(begin[-1])), begin[:-1]
        held = batch.slice(int(begin[-1]))
    if held is not None and held.num_rows:
        yield held, np.zeros(1, dtype=np.int64)


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` of long texts, in a session whose Arrow batches hold ``BATCH_ROWS`` rows.

    A batch of Spark's 10,000 texts is held several times over, in the JVM and in Python. A number that the user chose stays.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """Give memory that Arrow and the C library keep for later back to the system; a C library without ``malloc_trim`` keeps its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` over batches, giving unused memory back to the system when it ends: workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped

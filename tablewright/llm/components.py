"""Connected components of links: union-find inside tasks, then star contraction over the whole edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the least vertex of their component, for a bounded list of edges."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return names, names[[find(x) for x in range(len(names))]] if len(names) else names


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges becomes at most one edge for each of its vertices, with the same components."""
    for batch in batches:
        v, root = union_find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(root[v != root]), pa.array(v[v != root])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(a, b)`` that has a link; ``component`` is its least vertex.

    Edges are bigint pairs, in any order and number; self-links and NULLs are ignored. Every round connects each vertex's
    larger neighbours, then its smaller ones, to its least neighbour; components are found when nothing changes, after a number
    of rounds that grows with the logarithm of the vertices. A vertex with very many links is no problem: minima are
    aggregated before the shuffle, and they are joined back from a checkpoint, so that Spark may split a skewed key.
    """
    live = edges.select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).filter("a < b")
    live = cut_lineage(live.mapInArrow(_shrink, "a bigint, b bigint").distinct())
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
        # larger neighbours of u go to u's least neighbour
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").filter("a < b")
        large = cut_lineage(large.distinct())
        # u and its smaller neighbours go to the least of them
        least = cut_lineage(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")))
        small = large.join(least, F.col("b") == F.col("u"))
        small = small.select(F.col("m").alias("p"), F.explode(F.array("a", "b")).alias("q")).filter("p < q")
        fresh = cut_lineage(small.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
        # done when every vertex has one edge, to a vertex that has none above it
        ends = fresh.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        was = live.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        live = fresh
        if ends == was:
            break
    found = live.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return found.unionByName(live.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())

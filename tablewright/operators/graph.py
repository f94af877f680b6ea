"""Connected components by contraction, and numbering of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.rowid import add_row_id
from tablewright.session import cut_lineage


SMALL_GRAPH = 2_000_000  # measured number of edges one task may resolve


def join_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and their component's least vertex, for a bounded list of edges."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, x, y = np.arange(len(names)), at[:len(a)], at[len(a):]
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            return names, names[parent]
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))  # every root but the least of its neighbours gives way
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = pd.concat(list(batches))
    v, p = join_ends(whole["a"].to_numpy(), whole["b"].to_numpy())
    yield pd.DataFrame({"v": v, "p": p})


def connected_components(vertices: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """``(id, component)`` with the least id of each component, for vertices ``id`` and edges ``(a, b)``.

    Every round hooks a vertex to its neighbour of least random priority, follows those
    pointers to their roots, and contracts the edges. Random priorities keep pointer
    chains short whatever the ids look like, and components at least halve each round.
    Once at most ``small`` contracted edges are left, one task resolves them.
    """
    live = cut_lineage(edges.filter("a <> b").select(
        F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).distinct())
    placed = vertices.select(F.col("id").cast("bigint").alias("id"), F.col("id").cast("bigint").alias("root"))
    turn = 0
    while left := live.count():
        if left <= small:
            ends = live.coalesce(1).mapInPandas(_finish, "v bigint, p bigint").withColumnRenamed("v", "root")
            placed = placed.join(ends, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
            break
        turn += 1

        def rank(c: str):
            return F.struct(F.xxhash64(F.lit(turn), c).alias("p"), F.col(c).alias("v"))

        both = live.select("a", rank("b").alias("n")).unionByName(live.select(F.col("b").alias("a"), rank("a").alias("n")))
        hooks = both.groupBy("a").agg(F.min("n").alias("n")).select(
            F.col("a").alias("v"), F.least(rank("a"), F.col("n"))["v"].alias("p"))
        hooks = cut_lineage(hooks)
        while True:
            up = hooks.select(F.col("v").alias("p"), F.col("p").alias("g"))
            jumped = cut_lineage(hooks.join(up, "p").select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")))
            hooks = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("v").alias("root"), F.col("p"))
        placed = cut_lineage(placed.join(to, "root", "left").select("id", F.coalesce("p", "root").alias("root")))
        ends = live.join(hooks.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(
            hooks.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        live = cut_lineage(ends.filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    names = placed.groupBy("root").agg(F.min("id").alias("component"))
    return placed.join(names, "root").select("id", "component")


def number_clusters(assigned: DataFrame, component: str = "component", name: str = "cluster") -> DataFrame:
    """Component names become 0.. in ascending order of their name; missing means noise, -1."""
    numbered = add_row_id(assigned.select(component).filter(F.col(component).isNotNull()).distinct(), [component], "_number")
    joined = assigned.join(numbered, component, "left")
    return joined.withColumn(name, F.coalesce("_number", F.lit(-1)).cast("bigint")).drop("_number", component)

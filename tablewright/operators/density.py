"""Density-based clustering. Copies of a point count with their weight and are compared once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distances import MANY_DIMENSIONS, Space
from tablewright.operators.graph import connected_components, number_clusters
from tablewright.operators.groups import join_groups
from tablewright.operators.neighbors import nearest_neighbors
from tablewright.operators.pairwise import as_points, near_blocks
from tablewright.operators.spanning import spanning_tree
from tablewright.session import cut_lineage


def block_edges(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks: as many edges as points, not as pairs."""
    seen_left, seen_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    ends, roots = [], []
    for start in range(len(left)):
        if seen_left[start] or not near[start].any():
            continue
        front = np.array([start])
        seen_left[start] = True
        while len(front):
            hit = near[front].any(axis=0) & ~seen_right
            seen_right |= hit
            back = near[:, hit].any(axis=1) & ~seen_left if hit.any() else np.zeros(len(left), bool)
            seen_left |= back
            front = np.nonzero(back)[0]
            reached = np.concatenate([right[hit], left[back]])
            ends.append(reached)
            roots.append(np.full(len(reached), left[start]))
    if not ends:
        return np.array([], dtype=left.dtype), np.array([], dtype=left.dtype)
    return np.concatenate(ends), np.concatenate(roots)


def distinct_points(df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """``(id, weight, vec)``: one row per distinct point, named by its least id."""
    return as_points(df, features, [id_col]).groupBy("vec").agg(
        F.min(id_col).cast("bigint").alias("id"), F.count("*").alias("weight")).select("id", "weight", "vec")


def _spread_to_copies(df: DataFrame, features: Sequence[str], id_col: str, points: DataFrame, value: str) -> DataFrame:
    """Give every row the value its distinct point received."""
    rows = as_points(df, features, [id_col])
    return join_groups(rows, points.select("vec", "weight", value), ["vec"], "weight", df.count()).select(id_col, value)


def fit_dbscan(df: DataFrame, features: Sequence[str], id_col: str, eps: float = 0.5, min_samples: int = 5,
               metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """``(id, cluster, core)``: clusters numbered by their least core id, -1 for noise.

    A border point joins the cluster of the least core id within ``eps``.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps and min_samples must be positive")
    space = Space(metric, p)
    points = cut_lineage(distinct_points(df, features, id_col))

    def count(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": ((d <= eps) @ b["weight"].to_numpy(float)).astype("int64")})

    counts = near_blocks(points, points, "id", count, "id bigint, n bigint", space, radius=eps, quick=True)
    dense = counts.groupBy("id").agg(F.sum("n").alias("n")).select("id", (F.col("n") >= min_samples).alias("core"))
    points = cut_lineage(points.join(dense, "id"))
    cores = points.filter("core")

    def link(a: pd.DataFrame, b: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        ends, roots = block_edges(a["id"].to_numpy(), b["id"].to_numpy(), near)
        return pd.DataFrame({"a": ends, "b": roots})

    edges = near_blocks(cores, cores, "id", link, "a bigint, b bigint", space, radius=eps, quick=True, flags=True)
    components = connected_components(cores.select("id"), edges)

    return _label(df, features, id_col, points, components, eps, space)


def _label(df: DataFrame, features: Sequence[str], id_col: str, points: DataFrame, components: DataFrame, eps: float,
           space: Space) -> DataFrame:
    """Border points join the least core id in reach; clusters are numbered; copies follow their point."""

    def touch(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ids = np.where(d <= eps, b["id"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        found = ids < np.iinfo(np.int64).max
        return pd.DataFrame({"id": a["id"].to_numpy()[found], "core_id": ids[found]})

    border = near_blocks(points.filter("NOT core"), points.filter("core"), "id", touch, "id bigint, core_id bigint", space, radius=eps, quick=True)
    border = border.groupBy("id").agg(F.min("core_id").alias("core_id"))
    named = components.unionByName(
        border.join(components.withColumnRenamed("id", "core_id"), "core_id").select("id", "component"))
    labelled = number_clusters(points.join(named, "id", "left"))
    labels = _spread_to_copies(df, features, id_col, labelled.withColumn("_both", F.struct("cluster", "core")), "_both")
    return labels.select(id_col, "_both.cluster", "_both.core")


def core_distances(df: DataFrame, features: Sequence[str], id_col: str, min_samples: int, metric: str = "euclidean",
                   p: float = 2.0) -> DataFrame:
    """Distinct points ``(id, weight, vec, core)`` with the distance to their ``min_samples``-th neighbour, itself included.

    Boxes of leaves bound it where there are few dimensions, so no lists of neighbours are made.
    """
    from tablewright.operators.modes import kth_distances  # modes builds on this module

    points = cut_lineage(distinct_points(df, features, id_col))
    space = Space(metric, p)
    if space.name == "euclidean" and len(features) < MANY_DIMENSIONS:
        if (points.agg(F.sum("weight")).first()[0] or 0) < min_samples:
            return points.withColumn("core", F.lit(float("inf")))
        return cut_lineage(points.join(kth_distances(points, min_samples, space).select("id", F.col("distance").alias("core")), "id"))
    queries = points.select(F.col("id").alias(id_col), *[F.col("vec")[i].alias(f) for i, f in enumerate(features)])
    near = nearest_neighbors(queries, df, features, id_col, min_samples, metric, p)
    kth = near.filter(F.col("rank") == min_samples).select(F.col(id_col).cast("bigint").alias("id"), F.col("distance").alias("core"))
    return cut_lineage(points.join(kth, "id", "left").withColumn("core", F.coalesce("core", F.lit(float("inf")))))


def fit_optics(df: DataFrame, features: Sequence[str], id_col: str, eps: float, min_samples: int = 5,
               max_eps: float = float("inf"), metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """``(id, cluster, core)``: the reachability structure cut at ``eps``.

    The structure is a spanning forest under mutual reachability, of the edges up to ``eps``.
    """
    if not 0 < eps <= max_eps:
        raise ValueError("eps must be positive and at most max_eps")
    points = core_distances(df, features, id_col, min_samples, metric, p)
    reach = points.filter(F.col("core") <= max_eps)
    tree = spanning_tree(reach, Space(metric, p), core="core", radius=eps)
    flagged = points.withColumn("core", F.col("core") <= eps)
    components = connected_components(flagged.filter("core").select("id"), tree.filter(F.col("w") <= eps).select("a", "b"))
    return _label(df, features, id_col, flagged, components, eps, Space(metric, p))

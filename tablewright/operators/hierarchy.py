"""Hierarchical clustering: single linkage on a spanning tree, other linkages by reciprocal nearest neighbours, and Birch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distances import Space
from tablewright.operators.density import _spread_to_copies, distinct_points
from tablewright.operators.graph import number_clusters
from tablewright.operators.kmeans import fit_kmeans
from tablewright.operators.linkage import LINKAGES, REST, linkage_tree
from tablewright.operators.rowid import add_row_id
from tablewright.operators.spanning import cut_tree, spanning_tree
from tablewright.session import cut_lineage

def fit_single_linkage(df: DataFrame, features: Sequence[str], id_col: str, n_clusters: int | None = 3, metric: str = "euclidean",
                       distance_threshold: float | None = None) -> DataFrame:
    """``(id, cluster)``, exact; clusters are numbered by their least id."""
    points = cut_lineage(distinct_points(df, features, id_col))
    tree = spanning_tree(points, Space(metric), radius=distance_threshold)
    groups = cut_tree(points.select("id"), tree, n_clusters if distance_threshold is None else None, distance_threshold)
    labelled = number_clusters(points.join(groups, "id"))
    return _spread_to_copies(df, features, id_col, labelled, "cluster")


def fit_agglomerative(df: DataFrame, features: Sequence[str], id_col: str, n_clusters: int | None = 3, linkage: str = "ward",
                      metric: str = "euclidean", distance_threshold: float | None = None, seed: int = 42,
                      micro_clusters: int | None = None, rest: int = REST) -> DataFrame:
    """``(id, cluster)``, exact at every size; clusters are numbered by their least id.

    Finding nearest neighbours takes time quadratic in the distinct points, and complete and average linkage also hold a table of
    all distances. For tables beyond that, ``micro_clusters`` names a number of k-means centres that are merged in their place,
    each with the number of its rows; the result is then that of the two stages, whatever the number of rows. ``rest`` clusters
    are finished in one task, which changes no result. Ward always measures Euclidean distances.
    """
    if linkage == "single":
        return fit_single_linkage(df, features, id_col, n_clusters, metric, distance_threshold)
    if linkage not in LINKAGES:
        raise ValueError("linkage is ward, complete, average or single")
    if micro_clusters is None:
        points = cut_lineage(distinct_points(df, features, id_col))
    else:
        micro = fit_kmeans(df, features, micro_clusters, max_iter=20, seed=seed)
        placed = cut_lineage(micro.transform(df, "_micro").select(id_col, "_micro"))
        at = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in micro.centers])
        points = cut_lineage(placed.groupBy("_micro").agg(F.min(id_col).cast("bigint").alias("id"), F.count("*").alias("weight")).select(
            "id", "weight", F.element_at(at, F.col("_micro") + 1).alias("vec"), "_micro"))
    tree = linkage_tree(points, linkage, metric, rest)
    groups = cut_tree(points.select("id"), tree, n_clusters if distance_threshold is None else None, distance_threshold)
    labelled = number_clusters(points.join(groups, "id"))
    if micro_clusters is None:
        return _spread_to_copies(df, features, id_col, labelled, "cluster")
    return placed.join(F.broadcast(labelled.select("_micro", "cluster")), "_micro").select(id_col, "cluster")


def fit_birch(df: DataFrame, features: Sequence[str], id_col: str, n_clusters: int | None = 3, threshold: float = 0.5,
              seed: int = 42, micro_clusters: int | None = None) -> DataFrame:
    """``(id, cluster)`` through clustering features of radius at most ``threshold``.

    The features (n, Σx, Σx²) are sums per cell of a grid whose cells have that radius, so
    they do not depend on row order and can be added up across partitions and over time.
    """
    cells = clustering_features(df, features, threshold)
    centers = cells.select("_cell", *[(F.col(f"s{i}") / F.col("n")).alias(f) for i, f in enumerate(features)], "n")
    with_cell = df.select(id_col, _cell(features, threshold).alias("_cell"))
    if n_clusters is None:
        named = number_clusters(cells.select("_cell", F.col("_cell").alias("component")))
    else:
        numbered = cut_lineage(add_row_id(centers, ["_cell"], "_key"))
        named = fit_agglomerative(numbered, features, "_key", n_clusters, "ward", seed=seed, micro_clusters=micro_clusters).join(
            numbered.select("_key", "_cell"), "_key").select("_cell", "cluster")
    return with_cell.join(named, "_cell").select(id_col, "cluster")


def _cell(features: Sequence[str], threshold: float):
    side = 2.0 * threshold / len(features) ** 0.5
    return F.array(*[F.floor(F.col(f) / F.lit(side)).cast("bigint") for f in features])


def clustering_features(df: DataFrame, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``(_cell, n, s0.., q)``: additive summaries; grouping combines before the shuffle."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    square = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    return df.groupBy(_cell(features, threshold).alias("_cell")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)], F.sum(square).alias("q"))

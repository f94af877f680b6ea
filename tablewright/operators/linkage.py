"""Ward, complete and average linkage by rounds of reciprocal nearest neighbours, at any number of points.

These linkages are reducible: two clusters that are each other's nearest neighbour stay so until they are merged, whatever
merges elsewhere. So each round merges all such pairs at once, and the merges with their heights are the edges of the same
tree that merging one pair at a time gives. A round is a few DataFrame jobs; nothing on the driver grows with the points.

Ward needs only a centroid and a size for each cluster: nearest neighbours are searched between blocks, near ones only, and no
distance is kept. Complete and average linkage keep a table of cluster distances, from which a round's merges are one grouped aggregate:
the largest distance, or the sum of all distances of a pair of clusters, is additive over merged clusters.

Once no more than ``REST`` clusters are left, one task finishes them with the same rule.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distances import Space, cross_distances
from tablewright.operators.pairwise import divide, matrix, near_blocks
from tablewright.session import cut_lineage

REST = 1024  # clusters that one task merges to the end
LINKAGES = ("ward", "complete", "average")
MERGES = "a bigint, b bigint, w double"


def nearest_first(d: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each row the column of the least (distance, lesser id, greater id). A row's own column must be infinite."""
    last = np.iinfo(np.int64).max
    lo, hi = np.minimum(rows[:, None], columns), np.maximum(rows[:, None], columns)
    tied = d == d.min(axis=1, keepdims=True)
    lo = np.where(tied, lo, last)
    return np.where(tied & (lo == lo.min(axis=1, keepdims=True)), hi, last).argmin(axis=1)


def merge_all(ids: np.ndarray, sizes: np.ndarray, d: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """All merges ``(kept id, merged id, height)`` of a bounded matrix of cluster distances, by the rounds of this module."""
    out: list[tuple[int, int, float]] = []
    d, ids, sizes = d.astype(float).copy(), ids.copy(), sizes.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(ids) > 1:
        near = nearest_first(d, ids, ids)
        i = np.flatnonzero(near[near] == np.arange(len(ids)))
        i = i[ids[i] < ids[near[i]]]
        for a, b in zip(i, near[i]):
            height = d[a, b]
            out.append((int(ids[a]), int(ids[b]), float(height)))
            if linkage == "complete":
                row = np.maximum(d[a], d[b])
            elif linkage == "average":
                row = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
            else:
                with np.errstate(invalid="ignore"):
                    square = (sizes[a] + sizes) * d[a] ** 2 + (sizes[b] + sizes) * d[b] ** 2 - sizes * height**2
                    row = np.sqrt(np.maximum(square, 0) / (sizes[a] + sizes[b] + sizes))
            row[[a, b]] = np.inf
            d[a], d[:, a] = row, row
            d[b], d[:, b] = np.inf, np.inf
            sizes[a] += sizes[b]
        left = np.setdiff1d(np.arange(len(ids)), near[i])
        d, ids, sizes = d[np.ix_(left, left)], ids[left], sizes[left]
    return out


def merge_rows(merges: list[tuple[int, int, float]]) -> pd.DataFrame:
    return pd.DataFrame(merges, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})


def _reciprocal(nearest: DataFrame) -> DataFrame:
    """``(a, b, w)`` of each pair of clusters that are each other's nearest, from ``(id, other, w)``; ``a`` is the lesser id."""
    back = nearest.select(F.col("id").alias("other"), F.col("other").alias("id"))
    pairs = nearest.join(back, ["id", "other"]).filter(F.col("id") < F.col("other"))
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b"), "w")


def _rest(rows: DataFrame, run, schema: str = MERGES) -> DataFrame:
    """The bounded rest in one task."""
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(run, schema)


def _ward_nearest(clusters: DataFrame, space: Space) -> DataFrame:
    """``(id, other, w)``: each cluster's nearest by the growth of the squared distances to centroids.

    A cluster first meets those of its own cell. What it finds there bounds how far off the centroid of a nearer one can be, since
    none has fewer rows than the smallest.
    """
    schema = "id bigint, other bigint, w double"

    def kernel(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        na, nb = a["weight"].to_numpy(float)[:, None], b["weight"].to_numpy(float)[None, :]
        d = d * np.sqrt(2 * na * nb / (na + nb))
        d[ia[:, None] == ib[None, :]] = np.inf
        at = nearest_first(d, ia, ib)
        least = d[np.arange(len(ia)), at]
        keep = np.isfinite(least)
        return pd.DataFrame({"id": ia[keep], "other": ib[at][keep], "w": least[keep]})

    cells = divide(clusters, "id", space)
    if cells.pivots is None:
        found = near_blocks(clusters, cells, "id", kernel, schema, space)
    else:
        met = near_blocks(clusters, cells, "id", kernel, schema, space, nearest=2, own_cell=True)
        least = float(clusters.agg(F.min("weight")).first()[0])
        reach = F.col("_w") / F.sqrt(2 * F.col("weight") * F.lit(least) / (F.col("weight") + F.lit(least)))
        known = clusters.join(met.groupBy("id").agg(F.min("w").alias("_w")), "id", "left")
        known = cut_lineage(known.withColumn("_bound", F.coalesce(reach * (1 + 1e-9), F.lit(float("inf")))).drop("_w"))
        found = near_blocks(known, cells, "id", kernel, schema, space, bound="_bound")
    best = F.min(F.struct("w", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "other")).alias("m")
    return found.groupBy("id").agg(best).select("id", "m.other", "m.w")


def ward_tree(points: DataFrame, rest: int = REST) -> DataFrame:
    """Merges ``(a, b, w)`` of points ``(id, weight, vec)``: the lesser id stays as the name of the merged cluster."""
    space = Space("euclidean")
    clusters, tree = points.select("id", "weight", "vec"), None
    while True:
        left = clusters.count()
        if left <= max(rest, 1):
            break
        merges = cut_lineage(_reciprocal(_ward_nearest(clusters, space)))
        tree = merges if tree is None else tree.unionByName(merges)
        to = merges.select(F.col("b").alias("id"), F.col("a").alias("_to"))
        named = clusters.join(to, "id", "left").withColumn("id", F.coalesce("_to", "id"))
        # two at most are merged: their weighted mean
        both = named.groupBy("id").agg(F.collect_list(F.struct("weight", "vec")).alias("m"), F.sum("weight").alias("weight"))
        first, second = F.col("m")[0], F.try_element_at("m", F.lit(2))
        mean = F.zip_with(first["vec"], second["vec"], lambda x, y: (x * first["weight"] + y * second["weight"]) / (first["weight"] + second["weight"]))
        clusters = cut_lineage(both.select("id", "weight", F.when(second.isNull(), first["vec"]).otherwise(mean).alias("vec")))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, n = matrix(pdf["vec"]), pdf["weight"].to_numpy(float)
        d = cross_distances(x, x, "euclidean") * np.sqrt(2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
        return merge_rows(merge_all(pdf["id"].to_numpy(), n, d, "ward"))

    last = cut_lineage(_rest(clusters, finish))
    return last if tree is None else cut_lineage(tree.unionByName(last))


def _pair_rows(points: DataFrame, space: Space) -> DataFrame:
    """``(a, b, d, n)``: every pair of points once, with its distance and the number of pairs of rows it stands for."""
    def kernel(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        i, j = np.nonzero(ia[:, None] < ib[None, :])
        n = a["weight"].to_numpy(float)[i] * b["weight"].to_numpy(float)[j]
        return pd.DataFrame({"a": ia[i], "b": ib[j], "d": d[i, j], "n": n})

    return near_blocks(points, points, "id", kernel, "a bigint, b bigint, d double, n double", space)


def table_tree(points: DataFrame, linkage: str, metric: str = "euclidean", rest: int = REST) -> DataFrame:
    """Merges ``(a, b, w)`` for complete or average linkage, from a table of all cluster distances: its rows are quadratic."""
    pairs = _pair_rows(points.select("id", "weight", "vec"), Space(metric))
    # what is kept adds up over merged clusters: the largest distance, or the sum over pairs of rows
    kept = F.col("d") if linkage == "complete" else F.col("d") * F.col("n")
    pairs = cut_lineage(pairs.select("a", "b", kept.alias("v"), "n"))
    merged = F.max("v") if linkage == "complete" else F.sum("v")
    height = F.col("v") if linkage == "complete" else F.col("v") / F.col("n")
    left, tree = points.count(), None
    while left > max(rest, 1):
        link = pairs.select("a", "b", height.alias("w"))
        ends = link.select(F.col("a").alias("id"), F.col("b").alias("other"), "w", "a", "b").unionByName(
            link.select(F.col("b").alias("id"), F.col("a").alias("other"), "w", "a", "b"))
        nearest = ends.groupBy("id").agg(F.min(F.struct("w", "a", "b", "other")).alias("m")).select("id", "m.other", "m.w")
        merges = cut_lineage(_reciprocal(nearest))
        tree = merges if tree is None else tree.unionByName(merges)
        left -= merges.count()
        for end in ("a", "b"):
            to = merges.select(F.col("b").alias(end), F.col("a").alias("_to"))
            pairs = pairs.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        pairs = pairs.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(merged.alias("v"), F.sum("n").alias("n"))
        pairs = cut_lineage(pairs)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.append(pdf["a"].to_numpy(), pdf["b"].to_numpy()))
        i, j = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
        d, n = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(ids)))
        d[i, j] = d[j, i] = pdf["v"] if linkage == "complete" else pdf["v"] / pdf["n"]
        n[i, j] = n[j, i] = pdf["n"]
        # the sizes of three clusters follow from those of their pairs; two need none
        size = np.ones(len(ids))
        if len(ids) > 2:
            size = np.array([np.sqrt(n[k, (k + 1) % len(ids)] * n[k, (k + 2) % len(ids)] / n[(k + 1) % len(ids), (k + 2) % len(ids)]) for k in range(len(ids))])
        return merge_rows(merge_all(ids, size, d, linkage))

    last = cut_lineage(_rest(pairs, finish))
    return last if tree is None else cut_lineage(tree.unionByName(last))


def linkage_tree(points: DataFrame, linkage: str, metric: str = "euclidean", rest: int = REST) -> DataFrame:
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    return ward_tree(points, rest) if linkage == "ward" else table_tree(points, linkage, metric, rest)


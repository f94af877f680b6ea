"""Exact k nearest neighbours, and classification and regression by them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.distances import MANY_DIMENSIONS, Space, pair_distances
from tablewright.operators.pairwise import as_points, divide, matrix, near_blocks
from tablewright.session import cut_lineage


def nearest_columns(d: np.ndarray, k: int, exact=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k least of each row, of equal ones the first columns.

    ``exact(rows, columns)`` gives the distances behind a matrix that holds them to about eleven digits; without it they stand in ``d``.
    """
    k = min(k, d.shape[1])
    kth = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    rows, cols = np.nonzero(d <= (kth if exact is None else kth * (1 + 1e-9)))
    values = d[rows, cols] if exact is None else exact(rows, cols)
    order = np.lexsort((cols, values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (place < k) & np.isfinite(values)
    return rows[keep], cols[keep], values[keep]


def nearest_neighbors(
    queries: DataFrame, points: DataFrame, features: Sequence[str], id_col: str, k: int = 5,
    metric: str = "euclidean", p: float = 2.0, skip_self: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """``(id, rank, neighbor, distance, carry…)``: the k nearest points of each query, ties by smaller id.

    Of equal points only the k with the smallest ids can ever be chosen, so copies beyond
    that are dropped before anything is compared; that keeps hot copies cheap and exact. Where the points fall into cells, a
    query meets its nearest cell first: the k-th distance found there is what tells which other cells can matter.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keep_k = k + 1 if skip_self else k
    copies = Window.partitionBy("vec").orderBy(id_col)
    right = (as_points(points, features, [id_col, *carry]).withColumn("_c", F.row_number().over(copies))
             .filter(F.col("_c") <= keep_k).drop("_c"))
    left = as_points(queries, features, [id_col])
    id_type = points.schema[id_col].dataType.simpleString()
    carried = "".join(f", {c} {points.schema[c].dataType.simpleString()}" for c in carry)
    names = list(carry)
    space = Space(metric, p)
    product = space.base == "euclidean" and len(features) >= MANY_DIMENSIONS

    def best(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ids, own = b[id_col].to_numpy(), a[id_col].to_numpy()
        order = np.argsort(ids, kind="stable")
        b, ids, d = b.iloc[order], ids[order], d[:, order]
        if skip_self:
            d = np.where(own[:, None] == ids[None, :], np.inf, d)

        def exact(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            x, y = space.rows(matrix(a["vec"])), space.rows(matrix(b["vec"]))
            values = space.outward(pair_distances(x, y, rows, cols))
            return np.where(np.isfinite(d[rows, cols]), values, np.inf)

        rows, cols, values = nearest_columns(d, k, exact if product else None)
        if "_bound" in a:  # what lies beyond the k rows already met cannot be among the nearest
            near = values <= a["_bound"].to_numpy()[rows] * (1 + 1e-9)
            rows, cols, values = rows[near], cols[near], values[near]
        found = pd.DataFrame({id_col: own[rows], "neighbor": ids[cols], "distance": values})
        for c in names:
            found[c] = b[c].to_numpy()[cols]
        return found

    schema = f"{id_col} {queries.schema[id_col].dataType.simpleString()}, neighbor {id_type}, distance double{carried}"
    cells = divide(right, id_col, space)
    if cells.pivots is None:
        partial = near_blocks(left, cells, id_col, best, schema, space, nearest=keep_k, quick=product)
    else:
        met = near_blocks(left, cells, id_col, best, schema, space, nearest=keep_k, own_cell=True, quick=product)
        # a query with fewer than k rows found so far has no bound yet and visits every cell
        kth = met.groupBy(id_col).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("distance")).alias("_d")).select(
            id_col, F.when(F.col("_n") >= k, F.col("_d")[k - 1]).alias("_bound"))
        known = left.join(kth, id_col, "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf"))))
        partial = near_blocks(cut_lineage(known), cells, id_col, best, schema, space, bound="_bound", quick=product)
    order = Window.partitionBy(id_col).orderBy("distance", "neighbor")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class NeighborModel:
    train: DataFrame
    features: list[str]
    id_col: str
    k: int
    weights: str
    metric: str
    p: float
    classification: bool
    label: str = "label"

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        near = nearest_neighbors(df, self.train, self.features, self.id_col, self.k, self.metric, self.p, carry=[self.label])
        if self.weights == "distance":
            # neighbours at distance zero, where there are any, decide alone
            touching = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(self.id_col)) == 1
            weight = F.when(touching, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        else:
            weight = F.lit(1.0)
        near = near.withColumn("_w", weight)
        if self.classification:
            votes = near.groupBy(self.id_col, self.label).agg(F.sum("_w").alias("_v"))
            best = F.max(F.struct(F.col("_v"), (-F.col(self.label)).alias("neg")))
            decided = votes.groupBy(self.id_col).agg((-best["neg"]).alias(prediction))
        else:
            decided = near.groupBy(self.id_col).agg((F.sum(F.col("_w") * F.col(self.label)) / F.sum("_w")).alias(prediction))
        return df.join(decided, self.id_col)


def fit_neighbors(
    train: DataFrame, features: Sequence[str], id_col: str, label: str = "label", n_neighbors: int = 5,
    weights: str = "uniform", metric: str = "minkowski", p: float = 2.0, classification: bool = True,
) -> NeighborModel:
    if not 1 <= n_neighbors <= 100:
        raise ValueError("n_neighbors lies between 1 and 100")
    if weights not in ("uniform", "distance"):
        raise ValueError("weights is uniform or distance")
    Space(metric, p)
    return NeighborModel(train, list(features), id_col, n_neighbors, weights, metric, p, classification, label)

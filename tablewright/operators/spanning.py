"""Minimum spanning trees over points, and cutting them into components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distances import MANY_DIMENSIONS, Space
from tablewright.operators.graph import connected_components
from tablewright.operators.leaf_tree import leaf_tree
from tablewright.operators.linkage import nearest_first
from tablewright.operators.pairwise import Cells, divide, least_reach, near_blocks
from tablewright.session import cut_lineage, spread


SMALL_FOREST = 500_000  # measured number of candidate edges one task may reduce
MANY_POINTS = 100_000  # rows beyond which rounds among near cells cost less than one pass over block pairs; both give a least tree


def block_tree(d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the links between two blocks (or inside one), by Prim's rule on the distance matrix."""
    rows, cols = d.shape
    if same:
        d = d.copy()
        np.fill_diagonal(d, np.inf)
    best_r, from_r = np.full(rows, np.inf), np.zeros(rows, int)
    best_c, from_c = d[0].copy(), np.zeros(cols, int)
    open_r, open_c = np.ones(rows, bool), np.ones(cols, bool)
    open_r[0] = False
    if same:
        open_c[0] = False
    out: list[tuple[int, int, float]] = []
    for _ in range((cols if same else rows + cols) - 1):
        c = int(np.argmin(np.where(open_c, best_c, np.inf)))
        if same:
            out.append((from_c[c], c, best_c[c]))
            open_c[c] = False
            nearer = d[c] < best_c
            best_c[nearer], from_c[nearer] = d[c][nearer], c
            continue
        r = int(np.argmin(np.where(open_r, best_r, np.inf)))
        if open_c[c] and (not open_r[r] or best_c[c] <= best_r[r]):
            out.append((from_c[c], c, best_c[c]))
            open_c[c] = False
            nearer = d[:, c] < best_r
            best_r[nearer], from_r[nearer] = d[nearer, c], c
        else:
            out.append((r, from_r[r], best_r[r]))
            open_r[r] = False
            nearer = d[r] < best_c
            best_c[nearer], from_c[nearer] = d[r][nearer], r
    if not out:
        return np.array([], int), np.array([], int), np.array([])
    left, right, w = zip(*out)
    return np.array(left), np.array(right), np.array(w)


def spanning_tree(points: DataFrame, space: Space, core: str | None = None, small: int = SMALL_FOREST, radius: float | None = None) -> DataFrame:
    """Minimum spanning tree ``(a, b, w)`` over ``(id, vec)``.

    ``core`` names a column of core distances; the edge weight is then the mutual
    reachability. Few points are compared block by block; more of them fall into cells, of
    which only near ones meet.

    With ``radius`` only edges up to that weight are wanted, and the result is the spanning forest of those edges.
    """
    points = points.select(F.col("id").cast("bigint").alias("id"), "vec", *([core] if core else []))
    if space.prunable and points.count() > MANY_POINTS:
        points = spread(points)
        cells = divide(points, "id", space)
        if cells.pivots is not None and space.name == "euclidean" and len(cells.pivots[0]) < MANY_DIMENSIONS:
            tree = leaf_tree(points, cells, core, radius)
            if tree is not None:
                cells.placed.unpersist()
                return tree
        if cells.pivots is not None:
            return _tree_by_nearest(points, cells, space, core, small, radius)
    return _tree_of_blocks(points, space, core, small, radius)


def _tree_of_blocks(points: DataFrame, space: Space, core: str | None, small: int, radius: float | None, few: bool = False) -> DataFrame:
    """One pass over the block pairs keeps the spanning tree of each: an edge outside it closes a lighter cycle and cannot be needed.

    ``few`` expects few links within ``radius`` for each row, and takes them strip by strip.
    """

    def tree_of(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        same = radius is None and len(ia) == len(ib) and set(ia) == set(ib)
        if radius is None and not same and ia.min() > ib.min():
            return pd.DataFrame({"a": [], "b": [], "w": []})  # the mirrored pair yields these edges
        if core:
            d = np.maximum(d, np.maximum(a[core].to_numpy()[:, None], b[core].to_numpy()[None, :]))
        if few:
            i, j = np.nonzero((d <= radius) & (ia[:, None] < ib))
            if len(i) <= 8 * (len(ia) + len(ib)):
                kept = lightest_forest(ia[i], ib[j], d[i, j]) if len(i) else i
                return pd.DataFrame({"a": ia[i[kept]], "b": ib[j[kept]], "w": d[i[kept], j[kept]]})
            # rows of a block pair overlap here: a point's two copies are joined first, by an edge that is dropped again
            d = np.where(ia[:, None] == ib[None, :], -1.0, d)
        if same:
            order = np.argsort(ia)
            back = np.argsort(ib)
            d, ia, ib = d[np.ix_(order, back)], ia[order], ib[back]
        x, y, w = block_tree(d, same)
        if radius is not None:
            wanted = (ia[x] != ib[y]) & (w <= radius)
            x, y, w = x[wanted], y[wanted], w[wanted]
        return pd.DataFrame({"a": np.minimum(ia[x], ib[y]), "b": np.maximum(ia[x], ib[y]), "w": w})

    found = near_blocks(points, points, "id", tree_of, "a bigint, b bigint, w double", space, radius=radius, by_row=few)
    edges = cut_lineage(found if radius is None else found.groupBy("a", "b").agg(F.min("w").alias("w")))
    return reduce_forest(points.select("id"), edges, small)


def _close(points: DataFrame, cells: Cells, space: Space) -> float:
    """About the distance to the eighth neighbour, from a thousand rows: how far a first pass looks. It changes no result."""
    def eighth(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        k = min(8, d.shape[1] - 1)
        return pd.DataFrame({"id": a["id"].to_numpy(), "d": np.partition(d, k, axis=1)[:, k]})

    some = points.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, cells.rows // 1000))) == 0)
    far = near_blocks(some, cells, "id", eighth, "id bigint, d double", space, nearest=9, own_cell=True).groupBy("id").agg(F.min("d").alias("d"))
    return (far.approxQuantile("d", [0.5], 1e-3) or [0.0])[0]


def _tree_by_nearest(points: DataFrame, cells: Cells, space: Space, core: str | None, small: int, radius: float | None) -> DataFrame:
    """The tree, or the forest up to ``radius``, by Borůvka rounds over the points: each component's lightest edge to another one.

    Short edges come first, block by block (with core distances those up to their median, from the points below it): a threshold of
    the weights cuts a minimum spanning tree into that of the lighter edges. In a round the rows of a component look into the nearest
    cell that holds another one; the least distance met, or known from the cells alone, is how far the component has to look at all.
    A component without an edge up to ``radius`` is done.
    """
    tree, place, dense = None, points.select("id", F.col("id").alias("comp")), points
    if core:
        near = (points.filter(F.col(core) < float("inf")).approxQuantile(core, [0.5], 1e-3) or [0.0])[0]
        dense = points.filter(F.col(core) <= near)
    else:
        near = _close(points, cells, space)
    if radius is not None and radius <= near:
        return _tree_of_blocks(points, space, core, small, radius, few=True)
    if near > 0:
        tree = _tree_of_blocks(dense, space, core, small, near, few=True)
        place = connected_components(points.select("id"), tree.select("a", "b")).withColumnRenamed("component", "comp")
    place = cut_lineage(place.withColumn("open", F.lit(True)))
    schema = "comp bigint, w double, a bigint, b bigint"

    def lightest(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        mine, ia, ib = a["comp"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()
        if core:
            d = np.maximum(d, np.maximum(a[core].to_numpy()[:, None], b[core].to_numpy()))
        d = np.where(mine[:, None] == b["comp"].to_numpy(), np.inf, d)
        names, at = np.unique(mine, return_inverse=True)
        row, least = d.min(axis=1), np.full(len(names), np.inf)
        np.minimum.at(least, at, row)
        keep = np.flatnonzero(np.isfinite(row) & (row == least[at]))
        to = ib[nearest_first(d[keep], ia[keep], ib)] if len(keep) else ib[:0]
        ends = pd.DataFrame({"comp": mine[keep], "w": row[keep], "a": np.minimum(ia[keep], to), "b": np.maximum(ia[keep], to)})
        return ends.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")

    while place.select("comp").distinct().limit(2).count() > 1:
        right = cut_lineage(cells.placed.join(place, "id"))
        rows = right.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *([F.max(core).alias("top")] if core else [])).collect()
        side = Cells(cells.rows, cells.pivots, right.drop("open"), cells.stats, "comp", {r["cell"]: r["lo"] for r in rows if r["lo"] == r["hi"]})
        left = right.filter("open").drop("cell", "_far", "open")
        met = near_blocks(left, side, "id", lightest, schema, space, nearest=1, own_cell=True)
        known = least_reach(left, side, space, core, {r["cell"]: r["top"] for r in rows} if core else None)
        known = known.select(F.col("value").alias("comp"), "most").unionByName(met.select("comp", F.col("w").alias("most")))
        bound = known.groupBy("comp").agg((F.least(F.min("most"), F.lit(radius)) * (1 + 1e-9)).alias("_bound"))
        asked = left.join(bound, "comp")
        asked = cut_lineage(asked.filter(F.col(core) <= F.col("_bound")) if core else asked)
        found = near_blocks(asked, side, "id", lightest, schema, space, bound="_bound")
        found = found if radius is None else found.filter(F.col("w") <= radius)
        chosen = cut_lineage(found.groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")))
        for held in (left, asked):
            held.unpersist()
        if chosen.isEmpty():
            break
        picked = chosen.select("e.a", "e.b", "e.w").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        ends = [place.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")) for c in ("a", "b")]
        links = picked.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        to = connected_components(place.select(F.col("comp").alias("id")).distinct(), links)
        going = chosen.select(F.col("comp").alias("id"), F.lit(True).alias("open"))
        to = to.join(going, "id", "left").select(F.col("id").alias("comp"), F.col("component").alias("_to"), F.coalesce("open", F.lit(False)).alias("open"))
        place = cut_lineage(place.drop("open").join(to, "comp").select("id", F.col("_to").alias("comp"), "open"))
    cells.placed.unpersist()
    if tree is None:
        return points.sparkSession.createDataFrame([], "a bigint, b bigint, w double")
    return cut_lineage(tree)


def lightest_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the spanning forest edges of a bounded edge list, by Kruskal's rule."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)].tolist(), at[len(a):].tolist()
    parent, kept = list(range(len(names))), []

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for e in np.lexsort((b, a, w)).tolist():
        p, q = find(x[e]), find(y[e])
        if p != q:
            parent[q] = p
            kept.append(e)
    return np.array(kept, int)


def _kruskal_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same between contracted ends ``ca`` and ``cb``; equal weights are told apart by the ends as they were."""
    whole = pd.concat(list(batches), ignore_index=True).sort_values(["w", "a", "b"], ignore_index=True)
    if len(whole):
        place = np.arange(len(whole))
        yield whole.iloc[lightest_forest(whole["ca"].to_numpy(), whole["cb"].to_numpy(), place)][["a", "b", "w"]]


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = pd.concat(list(batches), ignore_index=True)
    if len(whole):
        yield whole.iloc[lightest_forest(whole["a"].to_numpy(), whole["b"].to_numpy(), whole["w"].to_numpy())]


def reduce_forest(vertices: DataFrame, edges: DataFrame, small: int = SMALL_FOREST) -> DataFrame:
    """Minimum spanning forest of an edge table: Borůvka rounds, the bounded rest in one task.

    A round leaves of several edges between two components the lightest.
    """
    if edges.count() <= small:
        return cut_lineage(edges.coalesce(1).mapInPandas(_kruskal, "a bigint, b bigint, w double"))
    live = edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    place = vertices.select("id", F.col("id").alias("component"))
    tree = None
    while not live.isEmpty():
        edge = F.struct("w", "a", "b", "ca", "cb").alias("e")
        both = live.select(F.col("ca").alias("c"), edge).unionByName(live.select(F.col("cb").alias("c"), edge))
        # one candidate per component, combined before the shuffle; (w, a, b) settles ties
        chosen = cut_lineage(both.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        picked = chosen.select("a", "b", "w")
        tree = picked if tree is None else tree.unionByName(picked)
        names = place.select(F.col("component").alias("id")).distinct()
        merged = cut_lineage(connected_components(names, chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        to = merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        place = cut_lineage(place.join(to, "component").select("id", F.col("_to").alias("component")))
        ends = live.join(to.select(F.col("component").alias("ca"), F.col("_to").alias("ta")), "ca").join(
            to.select(F.col("component").alias("cb"), F.col("_to").alias("tb")), "cb")
        pair = F.least("ta", "tb").alias("ca"), F.greatest("ta", "tb").alias("cb")
        live = cut_lineage(ends.filter("ta <> tb").groupBy(*pair).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "ca", "cb"))
        if 0 < live.count() <= small:
            tree = tree.unionByName(live.coalesce(1).mapInPandas(_kruskal_rest, "a bigint, b bigint, w double"))
            break
    return cut_lineage(tree)


def cut_tree(vertices: DataFrame, tree: DataFrame, n_clusters: int | None = None, threshold: float | None = None) -> DataFrame:
    """Components left after removing the heaviest ``n_clusters - 1`` edges, or all edges of weight ``threshold`` and more."""
    if (n_clusters is None) == (threshold is None):
        raise ValueError("give either n_clusters or distance_threshold")
    if threshold is not None:
        kept = tree.filter(F.col("w") < threshold)
    elif n_clusters <= 1:
        kept = tree
    else:
        heavy = tree.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(n_clusters - 1).select("a", "b")
        kept = tree.join(F.broadcast(heavy), ["a", "b"], "left_anti")
    return connected_components(vertices, kept)

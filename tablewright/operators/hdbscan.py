"""Hierarchical density clustering (Campello 2013): merge tree, condensed clusters, most stable cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distances import Space
from tablewright.operators.density import _spread_to_copies, core_distances
from tablewright.operators.graph import connected_components, number_clusters
from tablewright.operators.rowid import add_row_id
from tablewright.operators.spanning import spanning_tree
from tablewright.session import cut_lineage

GROUP_EDGES = 500_000  # edges of one group a task may merge
SMALL_TREE = 200_000  # condensed clusters a task may settle
_NODE = "rank bigint, w double, l bigint, r bigint, lsize bigint, rsize bigint"


def merge_tree(points: DataFrame, tree: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """``(rank, w, l, r, lsize, rsize)``: the merges of single linkage, lightest first.

    A node is a point (its id) or an earlier merge (-1 - rank). Groups of edges are split
    at their middle rank: the light half falls apart into components that do not depend
    on each other, the heavy half sees each of those as one node. Halving goes on until
    every group is small enough for a task.
    """
    ranked = add_row_id(tree, ["w", "a", "b"], "rank")
    weights = points.select("id", "weight")
    live = ranked.join(weights.select(F.col("id").alias("a"), F.col("weight").alias("usize")), "a").join(
        weights.select(F.col("id").alias("b"), F.col("weight").alias("vsize")), "b").select(
        "rank", "w", F.col("a").alias("u"), "usize", F.col("b").alias("v"), "vsize", F.lit(0).cast("bigint").alias("grp"))
    live = cut_lineage(live)
    ready = None
    while True:
        sizes = live.groupBy("grp").agg(F.count("*").alias("n"), F.percentile_approx("rank", 0.5, F.lit(1000)).alias("mid"))
        marked = cut_lineage(live.join(sizes, "grp"))
        done = marked.filter(F.col("n") <= group_edges).drop("n", "mid")
        ready = done if ready is None else ready.unionByName(done)
        big = marked.filter(F.col("n") > group_edges)
        if big.isEmpty():
            break
        light = big.filter("rank <= mid").drop("n", "mid")
        heavy = big.filter("rank > mid").drop("n", "mid")
        nodes = light.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("usize").alias("size")),
                                              F.struct(F.col("v").alias("id"), F.col("vsize").alias("size"))))).distinct()
        comp = cut_lineage(connected_components(nodes.select("id"), light.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        tops = light.join(comp.withColumnRenamed("id", "u"), "u").groupBy("component").agg((-1 - F.max("rank")).alias("top"))
        whole = nodes.join(comp, "id").groupBy("component").agg(F.sum("size").alias("size"))
        merged = cut_lineage(comp.join(tops.join(whole, "component"), "component").select("id", "top", "size"))
        lights = light.join(merged.select(F.col("id").alias("u"), "top"), "u").withColumn("grp", F.col("top")).select(live.columns)
        for end in ("u", "v"):
            heavy = heavy.join(merged.select(F.col("id").alias(end), F.col("top").alias("_t"), F.col("size").alias("_s")), end, "left")
            heavy = heavy.withColumns({f"{end}size": F.coalesce("_s", f"{end}size"), end: F.coalesce("_t", end)}).drop("_t", "_s")
        live = cut_lineage(lights.unionByName(heavy.select(live.columns)))
    return cut_lineage(ready.groupBy("grp").applyInPandas(_merge_group, _NODE))


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Single-linkage merges of one bounded group of edges."""
    pdf = pdf.sort_values("rank")
    top: dict[int, int] = {}
    size: dict[int, int] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for rank, w, u, us, v, vs in zip(*[pdf[c].tolist() for c in ("rank", "w", "u", "usize", "v", "vsize")]):
        a, b = find(u), find(v)
        sa, sb = size.get(a, us), size.get(b, vs)
        out.append((rank, w, top.get(a, u), top.get(b, v), sa, sb))
        parent[b] = a
        size[a], top[a] = sa + sb, -1 - rank
    return pd.DataFrame(out, columns=["rank", "w", "l", "r", "lsize", "rsize"])


def _climb(nodes: DataFrame) -> DataFrame:
    """``(node, up)`` followed to its fixed point: pointers double their reach each round."""
    while True:
        onward = nodes.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = nodes.join(onward, "up", "left").select("node", F.coalesce("next", "up").alias("to"), F.col("up").alias("was"))
        jumped = cut_lineage(jumped)
        nodes = jumped.select("node", F.col("to").alias("up"))
        if jumped.filter("to <> was").isEmpty():
            return nodes


def condensed_labels(points: DataFrame, merges: DataFrame, min_cluster_size: int) -> DataFrame:
    """``(id, component)`` of the most stable clusters; noise is missing from the result."""
    small = F.lit(min_cluster_size)
    split = (F.col("lsize") >= small) & (F.col("rsize") >= small)
    rows = merges.withColumns({"node": -1 - F.col("rank"), "size": F.col("lsize") + F.col("rsize"), "split": split,
                               "lam": F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(1e300))})
    sides = rows.select("split", "lam", F.col("node").alias("parent"), F.inline(F.array(
        F.struct(F.col("l").alias("child"), F.col("lsize").alias("csize")), F.struct(F.col("r").alias("child"), F.col("rsize").alias("csize")))))
    sides = cut_lineage(sides)
    # a merge belongs to the cluster whose root is the nearest ancestor born in a split, or the top
    born = sides.filter("child < 0")
    start = rows.select("node").join(born.select(F.col("child").alias("node"), "parent", "split"), "node", "left").select(
        "node", F.when(F.col("parent").isNull() | F.col("split"), F.col("node")).otherwise(F.col("parent")).alias("up"))
    cluster_of = _climb(cut_lineage(start)).select("node", F.col("up").alias("cluster"))
    # a point leaves its cluster at the first merge holding min_cluster_size rows
    first = points.select(F.col("id").alias("node"), F.col("weight").alias("size")).unionByName(rows.select("node", "size"))
    first = first.join(sides.select(F.col("child").alias("node"), "parent"), "node", "left").select(
        "node", F.when((F.col("size") >= small) | F.col("parent").isNull(), F.col("node")).otherwise(F.col("parent")).alias("up"))
    exits = _climb(cut_lineage(first)).filter("node >= 0")
    heavy_parent = sides.filter("child >= 0").select(F.col("child").alias("node"), "parent")
    at = exits.join(heavy_parent, "node").select("node", F.when(F.col("up") >= 0, F.col("parent")).otherwise(F.col("up")).alias("exit"))
    left = at.join(rows.select(F.col("node").alias("exit"), "lam"), "exit").join(cluster_of.withColumnRenamed("node", "exit"), "exit")
    left = cut_lineage(left.join(points.select(F.col("id").alias("node"), "weight"), "node").select("node", "cluster", "lam", "weight"))
    # one row per cluster: birth, parent cluster, stability
    births = sides.filter("split").select(F.col("child").alias("cluster"), F.col("lam").alias("birth"), F.col("parent").alias("at"), "csize")
    births = births.join(cluster_of.select(F.col("node").alias("at"), F.col("cluster").alias("parent")), "at").drop("at")
    gone = left.groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("lam") * F.col("weight")).alias("s"))
    handed = births.groupBy(F.col("parent").alias("cluster")).agg(F.sum("csize").alias("n"), F.sum(F.col("birth") * F.col("csize")).alias("s"))
    mass = gone.unionByName(handed).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    table = mass.join(births.select("cluster", "birth", "parent"), "cluster", "full").select(
        "cluster", "parent", (F.coalesce("s", F.lit(0.0)) - F.coalesce("birth", F.lit(0.0)) * F.coalesce("n", F.lit(0))).alias("stability"))
    chosen = _most_stable(cut_lineage(table))
    return left.join(chosen, "cluster").select(F.col("node").alias("id"), "component")


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The selection of ``_most_stable`` for a bounded number of clusters."""
    whole = pd.concat(list(batches), ignore_index=True)
    stability = dict(zip(whole["cluster"].tolist(), whole["stability"].tolist()))
    parent = {c: None if pd.isna(p) else int(p) for c, p in zip(whole["cluster"].tolist(), whole["parent"].tolist())}
    kids: dict[int, list[int]] = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)
    order, at = list(kids.get(None, [])), 0
    while at < len(order):  # parents before children
        order += kids.get(order[at], [])
        at += 1
    best, own, component = {}, {}, {}
    for c in reversed(order):
        below = sum(best[k] for k in kids.get(c, []))
        own[c] = parent[c] is not None and (c not in kids or stability[c] >= below)
        best[c] = max(stability[c], below)
    for c in order:
        above = component.get(parent[c])
        component[c] = above if above is not None else (c if own[c] else None)
    rows = [(c, k) for c, k in component.items() if k is not None]
    yield pd.DataFrame(rows, columns=["cluster", "component"]).astype("int64")


def _most_stable(clusters: DataFrame, small: int | None = None) -> DataFrame:
    """``(cluster, component)``: excess-of-mass selection, children before parents, then passed down.

    The root is never selected. A measured, bounded number of clusters is settled in one
    task; beyond it, rounds are as many as the condensed tree is high.
    """
    if clusters.count() <= (SMALL_TREE if small is None else small):
        return clusters.coalesce(1).mapInPandas(_choose, "cluster bigint, component bigint")
    state = clusters.select("cluster", "parent", "stability", F.lit(None).cast("double").alias("best"), F.lit(False).alias("own"))
    while True:
        open_rows = state.filter("best IS NULL")
        if open_rows.isEmpty():
            break
        below = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(
            F.sum("best").alias("sum"), F.count_if(F.col("best").isNull()).alias("waiting"))
        joined = state.join(below, "cluster", "left")
        kids = F.coalesce("sum", F.lit(0.0))
        settle = F.col("best").isNull() & (F.coalesce("waiting", F.lit(0)) == 0)
        win = F.col("parent").isNotNull() & (F.col("sum").isNull() | (F.col("stability") >= kids))
        state = cut_lineage(joined.select(
            "cluster", "parent", "stability", F.when(settle, F.greatest("stability", kids)).otherwise(F.col("best")).alias("best"),
            F.when(settle, win).otherwise(F.col("own")).alias("own")))
    # the topmost selected ancestor decides
    named = state.select("cluster", "parent", "own", F.lit(None).cast("bigint").alias("component"), F.col("parent").isNull().alias("known"))
    while True:
        above = named.filter("known").select(F.col("cluster").alias("parent"), F.col("component").alias("_c"), F.lit(True).alias("_k"))
        step = named.join(above, "parent", "left")
        fresh = ~F.col("known") & F.coalesce("_k", F.lit(False))
        named = cut_lineage(step.select(
            "cluster", "parent", "own",
            F.when(fresh, F.coalesce("_c", F.when(F.col("own"), F.col("cluster")))).otherwise(F.col("component")).alias("component"),
            (F.col("known") | fresh).alias("known")))
        if named.filter("NOT known").isEmpty():
            return named.filter("component IS NOT NULL").select("cluster", "component")


def fit_hdbscan(df: DataFrame, features: Sequence[str], id_col: str, min_cluster_size: int = 5, min_samples: int | None = None,
                metric: str = "euclidean", group_edges: int = GROUP_EDGES) -> DataFrame:
    """``(id, cluster)``; -1 is noise. Clusters are numbered by their least member."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    points = core_distances(df, features, id_col, min_samples or min_cluster_size, metric)
    merges = merge_tree(points, spanning_tree(points, Space(metric), core="core"), group_edges)
    labels = condensed_labels(points, merges, min_cluster_size)
    least = labels.groupBy("component").agg(F.min("id").alias("_least"))
    named = labels.join(least, "component").select("id", F.col("_least").alias("component"))
    labelled = number_clusters(points.join(named, "id", "left"))
    return _spread_to_copies(df, features, id_col, labelled, "cluster")



"""Work over near points: far ones are not met, and results are those of all pairs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablewright.functions.distances import Space, cross_distances
from tablewright.operators import linkage, pairwise, spanning


def points_frame(spark, x, weights=None):
    weights = np.ones(len(x), int) if weights is None else weights
    return spark.createDataFrame([(i, int(w), [float(v) for v in row]) for i, (w, row) in enumerate(zip(weights, x))],
                                 "id bigint, weight bigint, vec array<double>")


def test_windows_meet_every_near_row_and_few_others(spark):
    x = np.random.default_rng(2).uniform(0, 10, size=(1500, 2))
    x[700:720] = x[:20]
    rows = points_frame(spark, x)

    def count(a, b, d):
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": (d <= 0.3).sum(axis=1), "met": d.shape[1]})

    got = pairwise.near_blocks(rows, rows, "id", count, "id bigint, n bigint, met bigint", Space("euclidean"), radius=0.3).groupBy("id").agg(
        F.sum("n").alias("n"), F.sum("met").alias("met")).orderBy("id").collect()
    assert [r["n"] for r in got] == (cross_distances(x, x, "euclidean") <= 0.3).sum(axis=1).tolist()
    assert sum(r["met"] for r in got) < 0.25 * 1500 * 1500


def test_ward_looks_for_the_nearest_among_near_clusters(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "_SMALL", 40)
    monkeypatch.setattr(pairwise, "WORTH", 0.0)
    rng = np.random.default_rng(5)
    x, n = rng.uniform(0, 10, size=(400, 2)), rng.integers(1, 60, 400)
    asked = []
    near = linkage.near_blocks
    monkeypatch.setattr(linkage, "near_blocks", lambda *a, **k: asked.append(k.get("bound")) or near(*a, **k))
    got = {r["id"]: (r["other"], r["w"]) for r in linkage._ward_nearest(points_frame(spark, x, n), Space("euclidean")).collect()}
    d = cross_distances(x, x, "euclidean") * np.sqrt(2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(d, np.inf)
    assert got == {i: (int(d[i].argmin()), d[i].min()) for i in range(400)}
    assert "_bound" in asked  # and not every pair of blocks


def forest(d, limit=np.inf):
    """Kruskal's rule over all pairs; of equal weights the lesser ends first."""
    i, j = np.nonzero(np.triu(d <= limit, 1))
    return [(int(i[e]), int(j[e]), float(d[i[e], j[e]])) for e in spanning.lightest_forest(i, j, d[i, j])]


def test_whole_tree_meets_near_cells_only(spark, monkeypatch):
    """Two far groups and stray points: the tree of all pairs, with and without core distances, and no pass over all block pairs."""
    monkeypatch.setattr(pairwise, "_SMALL", 60)
    monkeypatch.setattr(spanning, "MANY_POINTS", 0)
    monkeypatch.setattr(pairwise, "WORTH", 0.0)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(20, 1, (120, 2)), rng.uniform(-30, 50, (30, 2))]).round(2)
    x = np.unique(x, axis=0)
    d = cross_distances(x, x, "euclidean")
    core = np.sort(d, axis=1)[:, 4]
    rows = points_frame(spark, x).join(spark.createDataFrame([(i, float(c)) for i, c in enumerate(core)], "id bigint, core double"), "id")
    asked = []
    near = spanning.near_blocks
    monkeypatch.setattr(spanning, "near_blocks", lambda *a, **k: asked.append(k) or near(*a, **k))
    for column, weight in (("core", np.maximum(d, np.maximum(core[:, None], core))), (None, d)):
        got = sorted((r["w"], r["a"], r["b"]) for r in spanning.spanning_tree(rows, Space("euclidean"), core=column).collect())
        assert [w for w, _, _ in got] == sorted(w for _, _, w in forest(weight))  # of equal weights any tree serves
        a, b = np.array([r[1] for r in got]), np.array([r[2] for r in got])
        assert (weight[a, b] == [r[0] for r in got]).all() and len(spanning.lightest_forest(a, b, weight[a, b])) == len(x) - 1
    assert all(k.get("own_cell") or k.get("bound") or k.get("radius") for k in asked)


def test_reducing_a_forest_ends_in_one_task_once_few_edges_are_left(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 10, (120, 2)).round(1)
    d = cross_distances(x, x, "euclidean")
    i, j = np.nonzero(np.triu(d <= 3, 1))
    edges = spark.createDataFrame([(int(a), int(b), float(d[a, b])) for a, b in zip(i, j)], "a bigint, b bigint, w double")
    rounds = []
    parts = spanning.connected_components
    monkeypatch.setattr(spanning, "connected_components", lambda *a, **k: rounds.append(1) or parts(*a, **k))
    got = spanning.reduce_forest(spark.range(120), edges, small=600)
    assert len(i) > 600 and len(rounds) == 1
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted((a, b) for a, b, _ in forest(d, 3))

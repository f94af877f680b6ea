"""Steps that must stay bounded as tables grow: rows, blocks and messages of one task."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablewright.functions.distances import Space, cross_distances, product_distances
from tablewright.operators import neighbors, pairwise, trees
from tablewright.session import spread


def test_rows_of_one_partition_are_dealt_out(spark):
    rows = spark.range(1050).coalesce(1)
    dealt = spread(rows, 100)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 11 and max(sizes) <= 200 and sum(sizes) == 1050
    assert spread(rows, 2000) is rows


def test_members_of_a_forest_share_their_target(spark, monkeypatch):
    """Extra trees keep one gradient for all members, and what a judging task receives does not grow with the partitions."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(500)],
                                 "id bigint, a double, b double, label double")
    seen = []
    level = trees._level

    def spy(packed, *rest):
        seen.append(len(packed.first()["g"]))
        return level(packed, *rest)

    monkeypatch.setattr(trees, "_level", spy)
    forest = trees.fit_extra_trees(rows, ["a", "b"], ["id"], classification=False, n_estimators=6, max_depth=3)
    assert len(forest.trees) == 6 and set(seen) == {1}
    for parts in (1, 8, 1000, 20_000):
        assert trees.judged_together(128, parts) * 128 * 24 * parts <= max(trees.GROUP_BYTES, 128 * 24 * parts)
    assert trees.judged_together(128, 1) * 128 <= trees.GROUP_CELLS


def test_nearest_of_many_dimensions_are_exact(spark):
    """Copies, ties and several cells: the same neighbours, in the same order, as all differences give."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 12)) * 4
    x = (centres[rng.integers(0, 6, 5200)] + rng.normal(size=(5200, 12))).round(3)
    x[1000:1040] = x[0]
    x[2000:2100] = x[100:200]
    features = [f"f{i}" for i in range(12)]
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id bigint, " + ", ".join(f"{f} double" for f in features))
    asked = rows.filter("id % 26 = 0")
    got = neighbors.nearest_neighbors(asked, rows, features, "id", 4, skip_self=True).orderBy("id", "rank").collect()
    ids = np.arange(0, 5200, 26)
    d = cross_distances(x[ids], x, "euclidean")
    d[np.arange(len(ids)), ids] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert [r["neighbor"] for r in got] == near.ravel().tolist()
    assert [r["distance"] for r in got] == np.take_along_axis(d, near, axis=1).ravel().tolist()


def test_product_distances_decide_like_differences():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(40, 16)) + 1000
    b = np.vstack([a[:10], a[10:20] + 1e-9, rng.normal(size=(60, 16)) + 1000])
    exact = cross_distances(a, b, "euclidean")
    assert (product_distances(a, b)[np.arange(10), np.arange(10)] == 0).all()
    for limit in exact[3, 20:60]:
        assert ((product_distances(a, b, float(limit)) <= limit) == (exact <= limit)).all()
    assert np.allclose(product_distances(a, b), exact, rtol=1e-10, atol=0)


def test_a_kernel_of_rows_gets_strips(spark, monkeypatch):
    """A task holds a bounded number of distances, whatever its block holds."""
    monkeypatch.setattr(pairwise, "STRIP_CELLS", 500)
    rows = spark.range(300).select("id", F.array(F.col("id").cast("double")).alias("vec"))

    def sums(a, b, d):
        return pd.DataFrame({"id": a["id"].to_numpy(), "s": d.sum(axis=1), "cells": d.size})

    got = pairwise.near_blocks(rows, rows, "id", sums, "id bigint, s double, cells bigint", Space("euclidean")).collect()
    assert sorted((r["id"], r["s"]) for r in got) == [(i, float(sum(abs(i - j) for j in range(300)))) for i in range(300)]
    assert max(r["cells"] for r in got) <= 500


def test_memory_goes_back_when_a_batch_function_ends(monkeypatch):
    """Also when the consumer stops early: workers outlive their tasks."""
    from tablewright.llm import shared, subwords

    calls = []
    monkeypatch.setattr(shared, "release_memory", lambda: calls.append(1))
    assert list(shared.lean(iter)([1, 2])) == [1, 2] and len(calls) == 1
    early = shared.lean(iter)([1, 2])
    next(early)
    early.close()
    assert len(calls) == 2 and subwords.CACHE_CHARS <= 1_000_000


def test_links_need_no_table_of_distances(spark, monkeypatch):
    """A kernel of whole blocks is handed truth values, an eighth of the distances, made strip by strip."""
    monkeypatch.setattr(pairwise, "STRIP_CELLS", 400)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 10))
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")

    def pairs(a, b, near):
        assert near.dtype == bool
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": near.sum(axis=1)})

    got = pairwise.near_blocks(rows, rows, "id", pairs, "id bigint, n bigint", Space("cosine"), radius=0.9, quick=True, flags=True).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [n for _, n in sorted((r["id"], r["n"]) for r in got)] == (1 - unit @ unit.T <= 0.9).sum(axis=1).tolist()


def test_elbow_and_boosting_deal_their_rows(spark, monkeypatch):
    """Rows of one partition are iterated over by several tasks."""
    from tablewright.operators import boosting, kmeans

    dealt = []

    def few(df):
        out = spread(df, 50)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(kmeans, "spread", few)
    monkeypatch.setattr(boosting, "spread", few)
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0).alias("label")).coalesce(1)
    assert kmeans.elbow(rows, ["a"], max_clusters=2).count() == 2
    boosting.fit_boosted(rows, ["a"], ["id"], classification=False, n_estimators=1, max_depth=1)
    assert dealt == [4, 4]


def test_kth_distances_are_exact_and_meet_few_points(spark):
    """Copies, a coordinate of few values, several cells and groups: each distance is the one that all differences give."""
    from tablewright.operators import modes

    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 9, 9000).astype(float), rng.normal(size=9000) * 3], axis=1)
    weight = rng.integers(1, 4, 9000)
    points = spark.createDataFrame([(i, int(w), [float(c) for c in v]) for i, (w, v) in enumerate(zip(weight, x))], "id bigint, weight bigint, vec array<double>")
    k = int(0.3 * weight.sum())
    got = {r["id"]: (r["weight"], r["distance"]) for r in modes.kth_distances(points.repartition(3), k).collect()}
    assert len(got) == 9000 and [got[i][0] for i in range(9000)] == weight.tolist()
    for i in range(0, 9000, 90):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        assert got[i][1] == d[order[np.searchsorted(np.cumsum(weight[order]), k)]]
    assert modes.kth_distances(points.limit(3), 100).count() == 3
    leaves = modes._halves(x, np.arange(9000), 64)
    lo, hi = (np.array([f(x[at], axis=0) for at in leaves]) for f in (np.min, np.max))
    mass = np.array([weight[at].sum() for at in leaves])
    met = [mass[modes._bracket(a, b, lo, hi, mass, k)[3]].sum() for a, b in zip(lo, hi)]
    assert sum(len(at) for at in leaves) == 9000 and np.mean(met) < 0.4 * mass.sum()

"""Whole work and bounded steps: every point climbs, every pair passes messages, and large tables give what small ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.distances import Space, cross_distances
from tablewright.operators import affinity, graph, leaf_tree, modes, pairwise, spanning
from tablewright.plans import QUERIES


def climbed(x, weight, width, max_iter=300):
    """Where each point's climb ends and how many points it saw last."""
    at, n, going = x.copy(), np.zeros(len(x), int), np.arange(len(x))
    for _ in range(max_iter):
        near = (cross_distances(at[going], x, "euclidean") <= width) * weight
        n[going] = near.sum(axis=1)
        to = near @ x / near.sum(axis=1, keepdims=True)
        moved = np.linalg.norm(to - at[going], axis=1) > 1e-3 * width
        at[going], going = to, going[moved]
        if not len(going):
            break
    return at, n


@pytest.mark.parametrize("columns", [2, 3])
def test_running_sums_of_a_ball(columns, monkeypatch):
    monkeypatch.setattr(modes, "COLUMN_ROWS", 5)
    rng = np.random.default_rng(columns)
    x, weight = rng.normal(size=(700, columns)), rng.integers(1, 4, 700)
    x[:400, 0] = rng.integers(0, 4, 400)
    ball, places = modes.BallSums(x, weight), rng.normal(size=(90, columns))
    for width in (0.3, 1.1, 9.0):
        near = (cross_distances(places, x, "euclidean") <= width) * weight
        assert np.allclose(ball.sums(places, width), np.column_stack([near.sum(axis=1), near @ x]), rtol=0, atol=1e-9)


@pytest.mark.parametrize("travels", [True, False])
def test_every_point_climbs_to_its_mode(spark, monkeypatch, travels):
    monkeypatch.setattr(modes, "FEW_SEEDS", 0)
    monkeypatch.setattr(modes, "PART_ROWS", 120)
    monkeypatch.setattr(modes, "SEED_ROWS", 60)
    monkeypatch.setattr(modes, "FEW_MODES", 3)
    monkeypatch.setattr(modes, "fits_broadcast", lambda *a, **k: travels)
    x = np.random.default_rng(4).uniform(0, 10, (300, 2)).round(2)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double")
    got = {r["id"]: r["cluster"] for r in modes.fit_mean_shift(rows, ["x", "y"], "id", 1.5).collect()}
    at, n = climbed(x, np.ones(300, int), 1.5)
    centres = []
    for i in np.lexsort((np.arange(300), -n)):
        if not centres or (np.linalg.norm(at[centres] - at[i], axis=1) > 1.5).all():
            centres.append(i)
    assert len(centres) > 5
    d = np.sort(cross_distances(x, at[centres], "euclidean"), axis=1)
    clear = np.flatnonzero(d[:, 1] - d[:, 0] > 1e-6)
    nearest = cross_distances(x, at[centres], "euclidean").argmin(axis=1)
    assert [got[i] for i in clear] == nearest[clear].tolist()


def test_mean_shift_query_starts_from_every_customer(spark, sf, monkeypatch):
    seen = []
    climb = modes._climb_few
    monkeypatch.setattr(modes, "_climb_few", lambda seeds, *a: seen.append((len(seeds), a[-1])) or climb(seeds, *a))
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    assert QUERIES["c9_mean_shift"](spark, sf).count() == customers.count()
    assert seen == [(customers.select("c_nationkey", "c_acctbal").distinct().count(), 300)]


def dense_exemplars(x, rounds=200, damping=0.5):
    """Message passing by its definition, over the whole matrix (Frey & Dueck 2007)."""
    n = len(x)
    s = -cross_distances(x, x, "euclidean") ** 2
    s[np.diag_indices(n)] = np.median(s)
    r, a, last, steady = np.zeros((n, n)), np.zeros((n, n)), None, 0
    for _ in range(rounds):
        offers = a + s
        rival = np.array([[np.delete(offers[i], k).max() for k in range(n)] for i in range(n)])
        r = damping * r + (1 - damping) * (s - rival)
        lent = np.maximum(r, 0)
        np.fill_diagonal(lent, 0)
        gathered = np.minimum(0, np.diag(r) + lent.sum(axis=0) - lent)
        np.fill_diagonal(gathered, lent.sum(axis=0))
        a = damping * a + (1 - damping) * gathered
        chosen = np.diag(a) + np.diag(r) > 0
        steady = steady + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if steady >= 15 and chosen.any():
            break
    return np.flatnonzero(chosen)


@pytest.mark.parametrize("few", [2048, 0])
def test_affinity_propagation_hears_all_pairs(spark, monkeypatch, few):
    """More rows than any neighbour list of the past: what one task and what strips find is the dense form."""
    monkeypatch.setattr(affinity, "FEW_ROWS", few)
    monkeypatch.setattr(affinity, "PIECE_ROWS", 40)
    monkeypatch.setattr(affinity, "FEW_VALUES", 50)
    x = np.random.default_rng(11).normal(size=(100, 3)) + np.repeat(np.eye(3) * 6, [60, 25, 15], axis=0)
    rows = spark.createDataFrame([(i * 2, *map(float, v)) for i, v in enumerate(x)], "id bigint, a double, b double, c double")
    got = {r["id"]: r["exemplar"] for r in modes.fit_affinity_propagation(rows, ["a", "b", "c"], "id").collect()}
    wanted = dense_exemplars(x)
    near = cross_distances(x, x[wanted], "euclidean").argmin(axis=1)
    assert got == {i * 2: int(wanted[near[i]]) * 2 for i in range(100)}


def test_affinity_query_keeps_all_partners(spark, sf, monkeypatch):
    seen = []
    run = modes.all_pairs_exemplars
    monkeypatch.setattr(modes, "all_pairs_exemplars", lambda *a: seen.append(a[3:]) or run(*a))
    assert QUERIES["c10_affinity_propagation"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert seen == [(0.5, 200, 15, None)]


@pytest.mark.parametrize("cored,radius", [(False, None), (True, None), (False, 0.35), (True, 0.6)])
def test_tree_of_leaves_is_that_of_all_pairs(spark, monkeypatch, cored, radius):
    """Lines, a cloud and stray points in many small groups: the weights of the tree of all pairs, and no pass over blocks of pairs."""
    for name, value in (("LEAF_ROWS", 8), ("MOST_LEAVES", 10**6), ("GROUP_ROWS", 60), ("NEAR_LEAVES", 6), ("FEW_SPOTS", 2)):
        monkeypatch.setattr(leaf_tree, name, value)
    monkeypatch.setattr(pairwise, "_SMALL", 50)
    monkeypatch.setattr(spanning, "MANY_POINTS", 0)
    monkeypatch.setattr(spanning, "near_blocks", None)
    rng = np.random.default_rng(5)
    lines = np.column_stack([rng.integers(0, 5, 400), rng.uniform(0, 12, 400).round(2)])
    x = np.unique(np.vstack([lines, rng.normal(9, 1, (250, 2)).round(1), rng.uniform(-20, 30, (25, 2))]), axis=0)
    d = cross_distances(x, x, "euclidean")
    core = np.sort(d, axis=1)[:, 4]
    points = spark.createDataFrame([(i, list(map(float, v)), float(c)) for i, (v, c) in enumerate(zip(x, core))], "id bigint, vec array<double>, core double")
    weight = np.maximum(d, np.maximum(core[:, None], core)) if cored else d
    i, j = np.nonzero(np.triu(weight <= (radius or np.inf), 1))
    kept = spanning.lightest_forest(i, j, weight[i, j])
    tree = spanning.spanning_tree(points, Space("euclidean"), "core" if cored else None, radius=radius)
    got = sorted((r["w"], r["a"], r["b"]) for r in tree.collect())
    assert [w for w, _, _ in got] == sorted(weight[i[kept], j[kept]])
    a, b = np.array([r[1] for r in got]), np.array([r[2] for r in got])
    assert (weight[a, b] == [r[0] for r in got]).all() and len(spanning.lightest_forest(a, b, weight[a, b])) == len(got)


def test_ends_are_joined_whatever_the_order():
    rng = np.random.default_rng(1)
    chain = rng.permutation(5000)
    cut = np.arange(4999) % 1000 != 999
    names, least = graph.join_ends(chain[:-1][cut], chain[1:][cut])
    wanted = {int(v): int(chain[k:k + 1000].min()) for k in range(0, 5000, 1000) for v in chain[k:k + 1000]}
    assert dict(zip(names.tolist(), least.tolist())) == wanted
    names, least = graph.join_ends(np.full(300, 999), np.arange(300))
    assert set(least.tolist()) == {0} and len(names) == 301

"""Spectral clustering: shapes that no centre can part."""

import numpy as np
import pytest

from tablewright.operators import modes


def partition(rows):
    groups = {}
    for i, c in rows:
        groups.setdefault(c, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def rings(n, rng):
    """Two rings of ``n`` points each, evenly spread so that a neighbour graph links each ring."""
    at = np.arange(n) / n * 2 * np.pi
    inner = np.c_[np.cos(at), np.sin(at)] + rng.normal(0, 0.01, (n, 2))
    outer = 3 * np.c_[np.cos(at), np.sin(at)] + rng.normal(0, 0.01, (n, 2))
    return np.r_[inner, outer]


def moons(n, rng):
    at = np.linspace(0, np.pi, n)
    upper, lower = np.c_[np.cos(at), np.sin(at)], np.c_[1 - np.cos(at), 0.4 - np.sin(at)]
    return np.r_[upper, lower] + rng.normal(0, 0.02, (2 * n, 2))


@pytest.mark.parametrize("shape,affinity,gamma", [(rings, "nearest_neighbors", 1.0), (moons, "nearest_neighbors", 1.0)])
def test_shapes_are_parted(spark, shape, affinity, gamma):
    x = shape(90, np.random.default_rng(5))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, x double, y double").persist()
    found = modes.fit_spectral(df, ["x", "y"], "id", 2, affinity, n_neighbors=8, gamma=gamma)
    assert partition((r["id"], r["cluster"]) for r in found.collect()) == {frozenset(range(90)), frozenset(range(90, 180))}

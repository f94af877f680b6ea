"""Core distances come from boxes of leaves: no list of neighbours is made for few dimensions."""

import numpy as np
import pytest

from tablewright.operators import density


@pytest.mark.parametrize("k", [1, 4, 10])
def test_core_distances_of_copies_and_lone_points(spark, monkeypatch, k):
    def lists(*args, **kwargs):
        raise AssertionError("a list of neighbours was made")

    monkeypatch.setattr(density, "nearest_neighbors", lists)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), np.repeat(rng.normal(5, 1, (3, 2)), [1, 6, 12], axis=0), [[90.0, 90.0]]])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, k - 1]
    got = density._spread_to_copies(rows, ["a", "b"], "id", density.core_distances(rows, ["a", "b"], "id", k), "core").orderBy("id").collect()
    assert np.allclose([r["core"] for r in got], want, rtol=1e-12, atol=1e-12) and len(got) == len(x)


def test_too_few_points_have_no_core_distance(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0)], "id bigint, a double, b double")
    assert {r["core"] for r in density.core_distances(rows, ["a", "b"], "id", 4).collect()} == {float("inf")}
    assert density.core_distances(rows.limit(0), ["a", "b"], "id", 4).count() == 0
    assert sorted(r["core"] for r in density.core_distances(rows, ["a", "b"], "id", 3).collect()) == pytest.approx([2**0.5] * 2)

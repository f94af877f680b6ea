"""Forests of values: nodes split from histograms of all partitions, then finished where their rows meet."""

import numpy as np
import pytest

from tablewright.operators import trees

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, (12, 9, 7), (1500, 3))
    y = x[:, 0] * 100 + (x[:, 1] > 4) * 37 + x[:, 2] ** 2 + rng.integers(0, 5, 1500)
    data = [(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, a double, b double, c double, label double").repartition(3).persist()


@pytest.mark.parametrize("node_rows", [10**6, 200, 0])
def test_a_whole_tree_gives_each_cell_its_mean(rows, monkeypatch, node_rows):
    monkeypatch.setattr(trees, "NODE_ROWS", node_rows)
    model = trees.fit_forest(rows, FEATURES, classification=False, n_estimators=1, bootstrap=False, max_features="all")
    means = rows.groupBy(*FEATURES).agg({"label": "avg"}).withColumnRenamed("avg(label)", "m")
    assert model.transform(rows).join(means, FEATURES).filter("abs(prediction - m) > 1e-6").count() == 0


def test_where_a_node_is_split_changes_nothing(rows, monkeypatch):
    got = []
    for node_rows in (10**6, 300):
        monkeypatch.setattr(trees, "NODE_ROWS", node_rows)
        model = trees.fit_forest(rows, FEATURES, classification=False, n_estimators=4, max_features="all", min_samples_leaf=5, max_depth=6)
        got.append([r["prediction"] for r in model.transform(rows).orderBy("id").collect()])
        shares = {r["feature"]: r["importance"] for r in trees.feature_importance(model, rows.sparkSession).collect()}
        assert shares["a"] > 0.9 and abs(sum(shares.values()) - 1) < 1e-9
    assert np.allclose(*got)


def test_rules_of_a_node(rows):
    stump = trees.fit_forest(rows, FEATURES, classification=False, n_estimators=3, max_depth=1)
    assert all(len(t.feature) == 3 for t in stump.trees)
    none = trees.fit_forest(rows, FEATURES, classification=False, n_estimators=2, min_impurity_decrease=1e9)
    assert all(len(t.feature) == 1 for t in none.trees)
    some = trees.fit_forest(rows, FEATURES, classification=False, n_estimators=12, max_features="sqrt")
    assert some.transform(rows).selectExpr("corr(label, prediction) AS r").first()["r"] > 0.95
    assert len({int(t.feature[0]) for t in some.trees}) > 1


def test_copies_are_drawn_once_on_average():
    u = np.random.default_rng(5).integers(-2**63, 2**63 - 1, 50_000)
    first, second = trees.bootstrap_copies(u, 0), trees.bootstrap_copies(u, 1)
    assert abs(first.mean() - 1) < 0.02 and abs(first.var() - 1) < 0.05 and abs(np.corrcoef(first, second)[0, 1]) < 0.02

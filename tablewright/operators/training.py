"""Training and evaluation as one call, and the models by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark.sql import DataFrame

from tablewright.operators import (
    bayes, boosting, crossval, density, evaluation, gradient, hdbscan, hierarchy, kmeans, linear, mixture, modes, neighbors, prepare, quality, trees,
)
from tablewright.operators.rowid import ROW_ID

# (train, features, keys, classification, **parameters) -> model with transform(df)
Fit = Callable[..., Any]


def _plain(fit: Fit) -> Fit:
    return lambda train, features, keys, classification, **p: fit(train, features, **p)


def _both(fit: Fit) -> Fit:
    return lambda train, features, keys, classification, **p: fit(train, features, classification=classification, **p)


def _keyed(fit: Fit) -> Fit:
    return lambda train, features, keys, classification, **p: fit(train, features, keys, classification=classification, **p)


def _single_key(keys: Sequence[str]) -> str:
    if len(keys) != 1:
        raise ValueError("this model needs a single key column")
    return keys[0]


def _by_id(fit: Fit, **fixed: Any) -> Fit:
    return lambda df, features, keys, **p: fit(df, features, _single_key(keys), **{**fixed, **p})


CLASSIFIERS: dict[str, Fit] = {
    "logistic_regression": _plain(linear.fit_logistic), "gaussian_naive_bayes": _plain(bayes.fit_gaussian),
    "multinomial_naive_bayes": _plain(bayes.fit_multinomial), "complement_naive_bayes": _plain(bayes.fit_complement),
    "bernoulli_naive_bayes": _plain(bayes.fit_bernoulli), "categorical_naive_bayes": _plain(bayes.fit_categorical),
}
REGRESSORS: dict[str, Fit] = {
    "linear_regression": _plain(linear.fit_linear), "ridge": _plain(linear.fit_ridge), "lasso": _plain(linear.fit_lasso),
    "elastic_net": _plain(linear.fit_elastic_net),
}
EITHER: dict[str, Fit] = {
    "random_forest": _both(trees.fit_forest), "gradient_boosting": _keyed(boosting.fit_gradient_boosting), "adaboost": _both(boosting.fit_adaboost),
    "extra_trees": _keyed(trees.fit_extra_trees), "xgboost": _keyed(partial(boosting.fit_boosted, preset="xgboost")),
    "lightgbm": _keyed(partial(boosting.fit_boosted, preset="lightgbm")), "catboost": _keyed(partial(boosting.fit_boosted, preset="catboost")),
    "svm": _keyed(gradient.fit_svm),
    "knn": lambda train, features, keys, classification, **p: neighbors.fit_neighbors(train, features, _single_key(keys), classification=classification, **p),
    "decision_tree": _both(trees.fit_tree), "sgd": _keyed(gradient.fit_sgd), "mlp": _keyed(gradient.fit_mlp),
}
# (df, features, keys, **parameters) -> labelled rows, or a model with transform(df)
CLUSTERINGS: dict[str, Fit] = {
    "kmeans": lambda df, features, keys, **p: kmeans.fit_kmeans(df, features, **p),
    "minibatch_kmeans": lambda df, features, keys, **p: kmeans.fit_minibatch(df, features, keys, **p),
    "hierarchical": _by_id(hierarchy.fit_agglomerative), "dbscan": _by_id(density.fit_dbscan), "hdbscan": _by_id(hdbscan.fit_hdbscan),
    "gaussian_mixture": lambda df, features, keys, **p: mixture.fit_mixture(df, features, **p), "mean_shift": _by_id(modes.fit_mean_shift),
    "affinity_propagation": _by_id(modes.fit_affinity_propagation), "elbow_locator": lambda df, features, keys, **p: kmeans.elbow(df, features, **p),
    "optics": _by_id(density.fit_optics), "spectral_clustering": _by_id(modes.fit_spectral), "birch": _by_id(hierarchy.fit_birch),
}


def model_names(kind: str | None = None) -> list[str]:
    """Names of the models for ``classification``, ``regression`` or ``clustering``; all without a kind."""
    tables = {"classification": (CLASSIFIERS, EITHER), "regression": (REGRESSORS, EITHER), "clustering": (CLUSTERINGS,)}
    chosen = tables[kind] if kind else (CLASSIFIERS, REGRESSORS, EITHER, CLUSTERINGS)
    return [name for table in chosen for name in table]


def resolve(name: str, kind: str) -> Fit:
    """The fit function of a model for a kind of task."""
    if name not in model_names(kind):
        where = "is no model" if name not in model_names() else f"cannot be used for {kind}"
        raise ValueError(f"{name} {where}; choose one of {sorted(model_names(kind))}")
    return (CLUSTERINGS if kind == "clustering" else {**CLASSIFIERS, **REGRESSORS, **EITHER})[name]


@dataclass(frozen=True)
class Trained:
    model: Any
    prepared: prepare.Prepared
    predictions: DataFrame  # of the test part
    metrics: DataFrame  # one row
    folds: DataFrame | None  # (fold, score), if folds were asked for
    warnings: list[str]


def train_and_evaluate(df: DataFrame, target: str, name: str, kind: str, keys: Sequence[str] = (ROW_ID,), encoder: str = "ordinal",
                       scaler: str | None = "standard", test_size: float = 0.2, seed: int = 42, folds: int | None = None, **parameters: Any) -> Trained:
    """Quality gates, preparation, fit, prediction, metrics and, on request, cross-validation on the training part.

    Missing values and an empty table stop it before any split; so does a classification target that looks continuous.
    """
    if kind not in ("classification", "regression"):
        raise ValueError("kind is classification or regression")
    classification, fit = kind == "classification", resolve(name, kind)
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    quality.require_quality(df)
    if classification:
        check = quality.wrong_task_check(df, target).first()
        if check["suspicious"]:
            raise ValueError(f"{target} has {check['n_distinct']} distinct values in {check['n_rows']} rows; it looks continuous, use regression")
    ready = prepare.prepare_supervised(df, target, keys, encoder, scaler, test_size, seed, classification, check_quality=False)
    model = fit(ready.train, ready.features, ready.keys, classification, **parameters)
    predictions = model.transform(ready.test)
    metrics = evaluation.classification_metrics(predictions) if classification else evaluation.regression_metrics(predictions, p=len(ready.features))
    scores = None
    if folds:
        scores = crossval.cross_validate(ready.train, lambda part: fit(part, ready.features, ready.keys, classification, **parameters),
                                         ready.keys, folds, seed, classification=classification)
    return Trained(model, ready, predictions, metrics, scores, ready.warnings)


def cluster(df: DataFrame, name: str, keys: Sequence[str] = (ROW_ID,), encoder: str = "ordinal", scaler: str | None = "standard",
            **parameters: Any) -> tuple[Any, prepare.Prepared]:
    """Quality gate, preparation of the whole table and a clustering by name: its labelled rows or its model."""
    fit = resolve(name, "clustering")
    ready = prepare.prepare_unsupervised(df, keys, encoder, scaler)
    return fit(ready.train, ready.features, ready.keys, **parameters), ready

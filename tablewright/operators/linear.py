"""Linear and logistic models on Spark's own solvers, with regularisation in the usual units."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import total

VECTOR = "_features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(df)


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        terms = [F.col(f) * F.lit(w) for f, w in zip(self.features, self.coefficients)]
        return df.withColumn(prediction, total(terms) + F.lit(self.intercept))

    def summary(self, spark) -> DataFrame:
        """``(term, value)`` plus the number of non-zero coefficients."""
        rows = [("intercept", float(self.intercept)), ("n_nonzero", float(sum(abs(w) > 0 for w in self.coefficients)))]
        return spark.createDataFrame(rows + list(zip(self.features, map(float, self.coefficients))), "term string, value double")


@dataclass(frozen=True)
class SparkModel:
    """A fitted Spark ML model together with the features it reads."""

    features: list[str]
    model: object

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        scored = self.model.transform(assemble(df, self.features))
        return scored.select(*df.columns, F.col("prediction").alias(prediction))


def _solve(train: DataFrame, features: Sequence[str], label: str, **params) -> LinearModel:
    estimator = LinearRegression(featuresCol=VECTOR, labelCol=label, **params)
    fitted = estimator.fit(assemble(train, features))
    return LinearModel(list(features), [float(w) for w in fitted.coefficients], float(fitted.intercept))


def _label_spread(train: DataFrame, label: str) -> tuple[float, int]:
    spread, n = train.agg(F.stddev_samp(label), F.count("*")).first()
    return spread or 1.0, n


def fit_linear(train: DataFrame, features: Sequence[str], label: str = "label", fit_intercept: bool = True,
               positive: bool = False) -> LinearModel:
    if positive:
        return _non_negative(train, features, label, fit_intercept)
    return _solve(train, features, label, regParam=0.0, fitIntercept=fit_intercept, solver="normal")


def _non_negative(train: DataFrame, features: Sequence[str], label: str, fit_intercept: bool) -> LinearModel:
    """Non-negative least squares on the Gram matrix, which one aggregate yields."""
    k = len(features)
    cols = [F.col(f).cast("double") for f in features] + [F.col(label).cast("double")]
    means = train.agg(*[F.avg(c) for c in cols]).first() if fit_intercept else [0.0] * (k + 1)
    centred = [c - F.lit(m) for c, m in zip(cols, means)]
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    sums = train.agg(*[F.sum(centred[i] * centred[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram, target = np.zeros((k, k)), np.zeros(k)
    for i, j in pairs:
        if j == k:
            target[i] = sums[f"g{i}_{j}"]
        else:
            gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
    w = np.zeros(k)
    for _ in range(10_000):  # coordinate descent on a k × k system
        before = w.copy()
        for i in range(k):
            if gram[i, i] > 0:
                w[i] = max(0.0, w[i] + (target[i] - gram[i] @ w) / gram[i, i])
        if np.max(np.abs(w - before), initial=0.0) <= 1e-12 * max(1.0, np.max(np.abs(w), initial=0.0)):
            break
    return LinearModel(list(features), w.tolist(), float(means[k] - np.dot(w, means[:k])))


def fit_ridge(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
              fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-10) -> LinearModel:
    """Squared error + alpha·|w|². The solver divides by n and by the label spread; undo both."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    spread, n = _label_spread(train, label)
    return _solve(train, features, label, solver="l-bfgs", elasticNetParam=0.0, standardization=False,
                  regParam=alpha * spread / n, fitIntercept=fit_intercept, maxIter=max_iter, tol=tol)


def fit_elastic_net(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                    l1_ratio: float = 0.5, fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-10) -> LinearModel:
    """Half mean squared error + alpha·(l1_ratio·|w|₁ + (1-l1_ratio)/2·|w|²)."""
    if alpha < 0 or not 0 <= l1_ratio <= 1:
        raise ValueError("alpha must not be negative and l1_ratio lies in [0, 1]")
    spread, _ = _label_spread(train, label)
    first, second = alpha * l1_ratio, alpha * (1 - l1_ratio) * spread
    strength = first + second
    return _solve(train, features, label, solver="l-bfgs", standardization=False, regParam=strength,
                  elasticNetParam=first / strength if strength else 0.0, fitIntercept=fit_intercept, maxIter=max_iter, tol=tol)


def fit_lasso(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
              fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-10) -> LinearModel:
    return fit_elastic_net(train, features, label, alpha, 1.0, fit_intercept, max_iter, tol)


def balanced_weights(train: DataFrame, label: str, name: str = "_weight") -> DataFrame:
    """n / (k · n_class) per row."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for c, size in counts.items():
        weight = F.when(F.col(label) == c, F.lit(n / (k * size))).otherwise(weight)
    return train.withColumn(name, weight)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", C: float = 1.0, penalty: str | None = "l2",
                 l1_ratio: float = 0.0, max_iter: int = 100, class_weight: str | None = None,
                 fit_intercept: bool = True, tol: float = 1e-6) -> SparkModel:
    """Penalised logistic regression; ``C`` is the inverse strength against the summed loss."""
    if not (0 < C <= 1000 or C == float("inf")):
        raise ValueError("C lies in (0, 1000] or is infinite")
    if penalty not in (None, "l1", "l2", "elasticnet"):
        raise ValueError("penalty is l1, l2, elasticnet or None")
    n = train.count()
    mix = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio, None: 0.0}[penalty]
    strength = 0.0 if penalty is None or C == float("inf") else 1.0 / (C * n)
    rows = assemble(train, features)
    estimator = LogisticRegression(featuresCol=VECTOR, labelCol=label, regParam=strength, elasticNetParam=mix,
                                   standardization=False, maxIter=max_iter, tol=tol, fitIntercept=fit_intercept)
    if class_weight == "balanced":
        rows = balanced_weights(rows, label)
        estimator = estimator.setWeightCol("_weight")
    elif class_weight is not None:
        raise ValueError("class_weight is None or 'balanced'")
    return SparkModel(list(features), estimator.fit(rows))

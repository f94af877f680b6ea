"""Gaussian mixtures by expectation maximisation, and their information criteria."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import total
from tablewright.operators.kmeans import fit_kmeans

REG_COVAR = 1e-6  # fixed value: added to every variance


@dataclass(frozen=True)
class MixtureModel:
    features: list[str]
    weights: list[float]
    means: list[list[float]]
    covariances: list  # per component: d variances, or one d × d matrix
    kind: str
    log_likelihood: float
    n: int

    def log_densities(self) -> list[Column]:
        """log(weight) + log density per component as column arithmetic."""
        d, out = len(self.features), []
        for w, mean, cov in zip(self.weights, self.means, self.covariances):
            centred = [F.col(f) - F.lit(float(m)) for f, m in zip(self.features, mean)]
            if np.ndim(cov) == 1:
                quad = total([c * c / F.lit(float(v)) for c, v in zip(centred, cov)])
                logdet = float(np.sum(np.log(cov)))
            else:
                half = np.linalg.inv(np.linalg.cholesky(np.asarray(cov)))
                rows = [total([centred[j] * F.lit(float(half[i, j])) for j in range(i + 1)]) for i in range(d)]
                quad = total([r * r for r in rows])
                logdet = -2.0 * float(np.sum(np.log(np.diag(half))))
            out.append(F.lit(math.log(max(w, 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + logdet)) - 0.5 * quad)
        return out

    def transform(self, df: DataFrame, prediction: str = "cluster") -> DataFrame:
        scores = F.array(*self.log_densities())
        return df.withColumn(prediction, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    def parameters(self) -> int:
        k, d = len(self.weights), len(self.features)
        cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.kind]
        return k * d + cov + k - 1

    def criteria(self, spark) -> DataFrame:
        """Bayesian and Akaike information criteria: lower is better."""
        p = self.parameters()
        bic = -2 * self.log_likelihood + p * math.log(self.n)
        return spark.createDataFrame([(float(self.log_likelihood), p, float(bic), float(-2 * self.log_likelihood + 2 * p))],
                                     "log_likelihood double, n_parameters int, bic double, aic double")


def fit_mixture(df: DataFrame, features: Sequence[str], n_components: int = 3, covariance: str = "full", max_iter: int = 100,
                tol: float = 1e-3, seed: int = 42, centers: Sequence[Sequence[float]] | None = None) -> MixtureModel:
    """Expectation maximisation from k-means centres, or from ``centers``; every step is one aggregate of bounded width."""
    features = list(features)
    if covariance not in ("full", "tied", "diag", "spherical"):
        raise ValueError("covariance is full, tied, diag or spherical")
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).persist()
    start = centers or fit_kmeans(rows, features, n_components, seed=seed).centers
    spread = rows.agg(*[F.var_pop(f) for f in features]).first()
    first = [max(float(v), REG_COVAR) for v in spread]
    shape = np.diag(first) if covariance in ("tied", "full") else np.array(first)
    model = MixtureModel(features, [1.0 / n_components] * n_components, [list(map(float, c)) for c in start],
                         [shape] * n_components, covariance, -math.inf, 0)
    for _ in range(max_iter):
        step = _step(rows, model)
        settled = abs(step.log_likelihood - model.log_likelihood) / max(step.n, 1) < tol
        model = step
        if settled:
            break
    loglik, n = _likelihood(rows, model)
    rows.unpersist()
    return MixtureModel(features, model.weights, model.means, model.covariances, covariance, loglik, n)


def _log_sum(scores: list[Column]) -> tuple[Column, Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return top, F.log(total([F.exp(s - top) for s in scores])) + top


def _likelihood(df: DataFrame, model: MixtureModel) -> tuple[float, int]:
    _, whole = _log_sum(model.log_densities())
    row = df.agg(F.sum(whole), F.count("*")).first()
    return float(row[0]), int(row[1])


def _step(rows: DataFrame, model: MixtureModel) -> MixtureModel:
    """Responsibilities as columns, then every new parameter from one aggregate."""
    k, d, fs = len(model.weights), len(model.features), model.features
    scored = rows.withColumns({f"_s{c}": s for c, s in enumerate(model.log_densities())})
    _, whole = _log_sum([F.col(f"_s{c}") for c in range(k)])
    scored = scored.withColumn("_l", whole).withColumns({f"_r{c}": F.exp(F.col(f"_s{c}") - whole) for c in range(k)})
    square = model.kind in ("tied", "full")
    pairs = [(i, j) for i in range(d) for j in (range(i, d) if square else [i])]
    # products are centred on the current means, which keeps the variances accurate
    off = {(c, i): F.col(fs[i]) - F.lit(float(model.means[c][i])) for c in range(k) for i in range(d)}
    sums = scored.agg(
        F.sum("_l").alias("l"), F.count("*").alias("n"), *[F.sum(f"_r{c}").alias(f"n{c}") for c in range(k)],
        *[F.sum(F.col(f"_r{c}") * off[c, i]).alias(f"m{c}_{i}") for c in range(k) for i in range(d)],
        *[F.sum(F.col(f"_r{c}") * off[c, i] * off[c, j]).alias(f"q{c}_{i}_{j}") for c in range(k) for i, j in pairs]).first()
    n = sums["n"]
    sizes = [max(sums[f"n{c}"], 1e-12) for c in range(k)]
    shifts = [np.array([sums[f"m{c}_{i}"] / sizes[c] for i in range(d)]) for c in range(k)]
    means = [(np.array(model.means[c]) + shifts[c]).tolist() for c in range(k)]
    scatter = []
    for c in range(k):
        m = np.zeros((d, d))
        for i, j in pairs:
            m[i, j] = m[j, i] = sums[f"q{c}_{i}_{j}"] / sizes[c] - shifts[c][i] * shifts[c][j]
        scatter.append(m)
    if model.kind == "tied":
        shared = sum(s * z for s, z in zip(scatter, sizes)) / n + REG_COVAR * np.eye(d)
        covs = [shared] * k
    elif model.kind == "full":
        covs = [s + REG_COVAR * np.eye(d) for s in scatter]
    else:
        covs = [np.diag(s) + REG_COVAR for s in scatter]
        if model.kind == "spherical":
            covs = [np.full(d, v.mean()) for v in covs]
    return MixtureModel(fs, [z / n for z in sizes], means, covs, model.kind, float(sums["l"]), int(n))

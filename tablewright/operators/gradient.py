"""Models trained by data-parallel gradient steps: SGD linear models, kernel machines on feature maps, and MLPs.

A step is one Spark job: every partition sums the gradients of its rows on Arrow batches to one
array, arrays are added up as a tree, and only arrays of the parameters' size return to the driver.
Mini-batches are drawn by hash, so a run does not depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.linear import VECTOR

# fixed values: accepted losses, penalties, schedules and activations
CLASS_LOSSES = ("hinge", "log_loss", "modified_huber", "squared_hinge", "perceptron")
REGRESSION_LOSSES = ("squared_error", "huber", "epsilon_insensitive", "squared_epsilon_insensitive")
PENALTIES = ("l2", "l1", "elasticnet", None)
SCHEDULES = ("optimal", "invscaling", "constant", "adaptive")
ACTIVATIONS = ("relu", "tanh", "logistic", "identity")

FAN = 64  # partitions whose sums are added up at once

BatchGradient = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def gradient_rows(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], batches: int, seed: int) -> DataFrame:
    """``(x, y, batch)`` with ``x`` an array; the batch of a row follows from its key."""
    batch = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(batches)).cast("int")
    return df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y"), batch.alias("batch"))


def summed_gradient(rows: DataFrame, size: int, of: BatchGradient, partitions: int) -> tuple[float, np.ndarray, int]:
    """Loss sum, gradient sum and row count over ``rows``: one array for each partition, added up in tasks where there are many."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            if batch.num_rows:
                loss, grad = of(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("y").to_numpy())
                total[0], total[1] = total[0] + loss, total[1] + batch.num_rows
                total[2:] += grad
        yield one_array(total)

    sums = rows.select("x", "y").mapInArrow(partial, "v array<double>")
    while partitions > FAN:  # a tree of sums: no more than FAN arrays meet in a task or on the driver
        partitions = -(-partitions // FAN)
        part = F.pmod(F.spark_partition_id(), F.lit(partitions)).alias("part")
        sums = sums.select(part, "v").groupBy("part").applyInArrow(lambda t: pa.table([one_array(array_sum(t["v"])).column(0)], names=["v"]), "v array<double>")
    out = np.zeros(size + 2)
    for r in sums.collect():
        out += np.array(r["v"])
    return out[0], out[2:], int(out[1])


def one_array(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], names=["v"])


def array_sum(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).sum(axis=0)


def loss_and_slope(name: str, y: np.ndarray, p: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss per row and its derivative by the raw score; class labels are -1 and 1."""
    m = y * p
    if name in ("hinge", "perceptron"):
        edge = 1.0 if name == "hinge" else 0.0
        return np.maximum(0, edge - m), np.where(m < edge, -y, 0.0)
    if name == "squared_hinge":
        gap = np.maximum(0, 1 - m)
        return gap * gap, -2 * y * gap
    if name == "log_loss":
        return np.logaddexp(0, -m), -y * np.exp(-np.logaddexp(0, m))
    if name == "modified_huber":
        gap = np.maximum(0, 1 - m)
        return np.where(m >= -1, gap * gap, -4 * m), np.where(m >= -1, -2 * y * gap, -4 * y)
    r = p - y
    size = np.maximum(np.abs(r) - epsilon, 0.0)
    if name == "squared_error":
        return 0.5 * r * r, r
    if name == "huber":
        near = np.abs(r) <= epsilon
        return np.where(near, 0.5 * r * r, epsilon * np.abs(r) - 0.5 * epsilon**2), np.where(near, r, epsilon * np.sign(r))
    if name == "epsilon_insensitive":
        return size, np.where(size > 0, np.sign(r), 0.0)
    return size * size, 2 * np.sign(r) * size


@dataclass(frozen=True)
class ScoreWeights:
    """Linear scores of one or several outputs over an array or column features."""

    features: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    classes: list[float] | None
    epochs: int
    loss: float

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        x = F.array(*[F.col(f).cast("double") for f in self.features])
        return self.transform_array(df, x, prediction)

    def transform_array(self, df: DataFrame, x, prediction: str = "prediction") -> DataFrame:
        scores = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(float(c)), lambda acc, v: acc + v)
                  for w, c in zip(self.weights, self.intercepts)]
        if self.classes is None:
            return df.withColumn(prediction, scores[0])
        if len(scores) == 1:
            return df.withColumn(prediction, F.when(scores[0] > 0, self.classes[1]).otherwise(self.classes[0]))
        votes = F.array(*scores)
        at = F.array_position(votes, F.array_max(votes)).cast("int")
        return df.withColumn(prediction, F.element_at(F.array(*[F.lit(c) for c in self.classes]), at))


def fit_sgd(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", classification: bool = True,
            loss: str | None = None, penalty: str | None = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, max_iter: int = 1000,
            tol: float = 1e-3, learning_rate: str | None = None, eta0: float = 0.01, power_t: float | None = None, epsilon: float = 0.1,
            batches: int = 4, n_iter_no_change: int = 5, seed: int = 42) -> ScoreWeights:
    """A linear model under one of the SGD losses; three or more classes are trained one against the rest, together."""
    rows = gradient_rows(train, features, label, keys, batches, seed)
    return _fit_scores(rows, list(features), classification, loss, penalty, alpha, l1_ratio, max_iter, tol, learning_rate, eta0,
                       power_t, epsilon, batches, n_iter_no_change)


def _fit_scores(rows: DataFrame, features: list[str], classification: bool, loss: str | None, penalty: str | None, alpha: float,
                l1_ratio: float, max_iter: int, tol: float, learning_rate: str | None, eta0: float, power_t: float | None,
                epsilon: float, batches: int, patience: int) -> ScoreWeights:
    known = CLASS_LOSSES if classification else REGRESSION_LOSSES
    loss = loss or known[0]
    schedule = learning_rate or ("optimal" if classification else "invscaling")
    if loss not in known or penalty not in PENALTIES or schedule not in SCHEDULES:
        raise ValueError(f"loss is one of {known}, penalty one of {PENALTIES}, learning_rate one of {SCHEDULES}")
    rows = rows.persist()
    d, parts = len(rows.select("x").first()["x"]), rows.rdd.getNumPartitions()
    classes = [float(r[0]) for r in rows.select("y").distinct().orderBy("y").collect()] if classification else None
    k = 1 if classes is None or len(classes) == 2 else len(classes)
    signs = None if classes is None else (classes[1:] if k == 1 else classes)
    w = np.zeros((k, d + 1))
    # targets are centred and brought to unit spread; the penalties below undo what that changes
    centre, spread = (0.0, 1.0) if classification else _target_scale(rows)
    share = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, None: 0.0}[penalty]
    ridge = 0.0 if penalty is None else alpha * (1 - share) * (spread if loss == "epsilon_insensitive" else 1.0)
    sparse = alpha * share / (1.0 if loss == "epsilon_insensitive" else spread)
    width = epsilon / spread
    # steps stay below the inverse curvature, which keeps every schedule stable
    norm = rows.select(F.aggregate("x", F.lit(1.0), lambda acc, v: acc + v * v).alias("q")).agg(F.avg("q")).first()[0]
    ceiling = 1.0 / (norm * {"log_loss": 0.25, "squared_hinge": 2.0, "modified_huber": 2.0, "squared_epsilon_insensitive": 2.0}.get(loss, 1.0))
    rough = loss in ("hinge", "perceptron", "epsilon_insensitive")
    power = power_t if power_t is not None else (0.5 if classification else 0.25)
    seen, turn, eta, best, stale, epoch, mean = 0, 0, eta0, math.inf, 0, 0, math.inf
    for epoch in range(1, max_iter + 1):
        total_loss, total_n = 0.0, 0
        for b in range(batches):
            now = w.copy()

            def of(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
                wide = np.hstack([x, np.ones((len(x), 1))])
                score, worth, grad = wide @ now.T, 0.0, np.zeros_like(now)
                for c in range(len(now)):
                    target = (y - centre) / spread if signs is None else np.where(y == signs[c], 1.0, -1.0)
                    each, slope = loss_and_slope(loss, target, score[:, c], width)
                    worth += each.sum()
                    grad[c] = slope @ wide
                return worth, grad.ravel()

            part = rows if batches == 1 else rows.filter(F.col("batch") == b)
            value, grad, n = summed_gradient(part, w.size, of, parts)
            if not n:
                continue
            total_loss, total_n, seen, turn = total_loss + value, total_n + n, seen + n, turn + 1
            rate = {"optimal": 1.0 / (alpha * (1.0 / (alpha * 10.0) + seen)) if alpha else eta0, "invscaling": eta0 / seen**power,
                    "constant": eta0, "adaptive": eta}[schedule]
            # the schedule speaks per row; a batch takes its rows' steps at once
            rate = min(rate * n, ceiling) / (math.sqrt(turn) if rough else 1.0)
            step = grad.reshape(w.shape) / n
            w[:, :-1] -= rate * (step[:, :-1] + ridge * w[:, :-1])
            w[:, -1] -= rate * step[:, -1]
            if sparse:
                w[:, :-1] = np.sign(w[:, :-1]) * np.maximum(np.abs(w[:, :-1]) - rate * sparse, 0.0)
        mean = total_loss / max(total_n, 1)
        stale = stale + 1 if mean > best - tol else 0
        best = min(best, mean)
        if stale >= patience:
            if schedule == "adaptive" and eta > 1e-6:
                eta, stale = eta / 5, 0
            else:
                break
    rows.unpersist()
    w = w * spread
    w[:, -1] += centre
    return ScoreWeights(features, w[:, :-1].tolist(), w[:, -1].tolist(), classes, epoch, float(mean))


def _target_scale(rows: DataFrame) -> tuple[float, float]:
    centre, spread = rows.agg(F.avg("y"), F.stddev_pop("y")).first()
    return float(centre), float(spread) or 1.0


# --- support vector machines -------------------------------------------------------------


@dataclass(frozen=True)
class FeatureMap:
    """Features whose inner products approximate a kernel: random ones (Rahimi & Recht 2007), or kernel values against landmarks.

    Landmark values are turned by ``whiten``, the inverse square root of the landmarks' own kernel matrix (Williams & Seeger 2001),
    so inner products of mapped landmarks are their kernel values.
    """

    kernel: str
    directions: np.ndarray
    offsets: np.ndarray
    degree: int
    coef0: float
    whiten: np.ndarray | None = None

    def values(self, x: np.ndarray) -> np.ndarray:
        m = x @ self.directions.T
        if self.kernel == "rbf":
            return np.sqrt(2.0 / len(self.offsets)) * np.cos(m + self.offsets)
        z = (m + self.coef0) ** self.degree if self.kernel == "poly" else np.tanh(m + self.coef0)
        return z if self.whiten is None else z @ self.whiten

    def transform(self, df: DataFrame, features: Sequence[str], out: str = "_map") -> DataFrame:
        mapping = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(mapping.values(np.stack(x.to_numpy()))))

        return df.withColumn(out, mapped(F.array(*[F.col(f).cast("double") for f in features])))


def kernel_map(train: DataFrame, features: Sequence[str], keys: Sequence[str], kernel: str, gamma: str | float, degree: int, coef0: float,
               size: int, seed: int) -> FeatureMap:
    d = len(features)
    if gamma == "scale":
        spread = train.select(F.explode(F.array(*[F.col(f).cast("double") for f in features])).alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = 1.0 / (d * spread) if spread else 1.0
    elif gamma == "auto":
        gamma = 1.0 / d
    rng = np.random.default_rng(seed)
    if kernel == "rbf":
        return FeatureMap(kernel, rng.normal(size=(size, d)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, size), degree, coef0)
    # landmarks are hash-chosen rows, as many as the map is wide
    chosen = train.orderBy(F.xxhash64(F.lit(seed), *keys)).limit(size).select(*features).collect()
    return landmark_map(kernel, np.array([[float(v) for v in r] for r in chosen]), gamma, degree, coef0)


def landmark_map(kernel: str, landmarks: np.ndarray, gamma: float, degree: int, coef0: float) -> FeatureMap:
    """The Nyström map of a polynomial or sigmoid kernel. A sigmoid kernel need not be positive; its negative part counts by size."""
    raw = FeatureMap(kernel, gamma * landmarks, np.zeros(len(landmarks)), degree, coef0)
    own = raw.values(landmarks)
    power, turn = np.linalg.eigh((own + own.T) / 2)
    size = np.abs(power)
    root = np.divide(1.0, np.sqrt(size), out=np.zeros_like(size), where=size > 1e-10 * size.max(initial=0.0))
    return FeatureMap(kernel, raw.directions, raw.offsets, degree, coef0, (turn * root) @ turn.T)


@dataclass(frozen=True)
class MachineModel:
    features: list[str]
    mapping: FeatureMap | None
    model: object

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        wide = df.withColumn("_map", F.array(*[F.col(f).cast("double") for f in self.features])) if self.mapping is None else (
            self.mapping.transform(df, self.features))
        if isinstance(self.model, ScoreWeights):
            return self.model.transform_array(wide, F.col("_map"), prediction).drop("_map")
        scored = self.model.transform(wide.withColumn(VECTOR, array_to_vector("_map")))
        return scored.select(*df.columns, F.col("prediction").alias(prediction))


def fit_svm(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", classification: bool = True, C: float = 1.0,
            kernel: str = "rbf", gamma: str | float = "scale", degree: int = 3, coef0: float = 0.0, epsilon: float = 0.1,
            max_iter: int = 100, map_size: int = 100, seed: int = 42) -> MachineModel:
    """Support vector machine. Kernels other than linear work on an explicit feature map of ``map_size``."""
    if kernel not in ("linear", "rbf", "poly", "sigmoid"):
        raise ValueError("kernel is linear, rbf, poly or sigmoid")
    if C <= 0:
        raise ValueError("C must be positive")
    mapping = None if kernel == "linear" else kernel_map(train, features, keys, kernel, gamma, degree, coef0, map_size, seed)
    wide = train.withColumn("_map", F.array(*[F.col(f).cast("double") for f in features])) if mapping is None else mapping.transform(train, features)
    n = train.count()
    if not classification:
        rows = wide.select(F.col("_map").alias("x"), F.col(label).cast("double").alias("y"), F.lit(0).alias("batch"))
        model = _fit_scores(rows, list(features), False, "epsilon_insensitive", "l2", 1.0 / (C * n), 0.0, max_iter, 1e-5, "constant", 1.0,
                            None, epsilon, 1, 5)
        return MachineModel(list(features), mapping, model)
    rows = wide.select(F.col(label).alias("label"), array_to_vector("_map").alias(VECTOR)).persist()
    machine = LinearSVC(featuresCol=VECTOR, labelCol="label", regParam=1.0 / (C * n), maxIter=max_iter, standardization=False)
    if rows.select("label").distinct().count() > 2:
        machine = OneVsRest(classifier=machine, featuresCol=VECTOR, labelCol="label")
    fitted = machine.fit(rows)
    rows.unpersist()
    return MachineModel(list(features), mapping, fitted)


# --- multi-layer perceptron --------------------------------------------------------------


def _activate(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if name == "relu":
        return np.maximum(z, 0), (z > 0).astype(float)
    if name == "tanh":
        a = np.tanh(z)
        return a, 1 - a * a
    if name == "logistic":
        a = 1 / (1 + np.exp(-z))
        return a, a * (1 - a)
    return z, np.ones_like(z)


def _forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, activation: str) -> np.ndarray:
    for w, b in layers[:-1]:
        x = _activate(activation, x @ w + b)[0]
    return x @ layers[-1][0] + layers[-1][1]


def _unpack(flat: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for i, o in shapes:
        out.append((flat[at:at + i * o].reshape(i, o), flat[at + i * o:at + i * o + o]))
        at += i * o + o
    return out


@dataclass(frozen=True)
class NetworkModel:
    features: list[str]
    shapes: list[tuple[int, int]]
    flat: np.ndarray
    activation: str
    classes: list[float] | None
    n_iter: int
    loss: float
    centre: float = 0.0
    spread: float = 1.0

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        layers, activation, centre, spread = _unpack(self.flat, self.shapes), self.activation, self.centre, self.spread
        classes = None if self.classes is None else np.array(self.classes)

        @F.pandas_udf(T.DoubleType())
        def predict(x: pd.Series) -> pd.Series:
            out = _forward(layers, np.stack(x.to_numpy()), activation)
            return pd.Series(out[:, 0] * spread + centre if classes is None else classes[out.argmax(axis=1)])

        return df.withColumn(prediction, predict(F.array(*[F.col(f).cast("double") for f in self.features])))


def fit_mlp(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", classification: bool = True,
            hidden_layer_sizes: Sequence[int] = (100,), activation: str = "relu", alpha: float = 1e-4, learning_rate_init: float = 1e-3,
            max_iter: int = 200, tol: float = 1e-4, early_stopping: bool = False, batches: int = 4, n_iter_no_change: int = 10,
            seed: int = 42) -> NetworkModel:
    """A perceptron trained with Adam. With ``early_stopping`` a tenth of the rows, chosen by hash, judges progress."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"activation is one of {ACTIVATIONS}")
    features = list(features)
    rows = gradient_rows(train, features, label, keys, batches * 10 if early_stopping else batches, seed).persist()
    classes = [float(r[0]) for r in rows.select("y").distinct().orderBy("y").collect()] if classification else None
    sizes = [len(features), *hidden_layer_sizes, 1 if classes is None else len(classes)]
    shapes = list(zip(sizes[:-1], sizes[1:]))
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([rng.uniform(-1, 1, i * o) * math.sqrt(6 / (i + o)), np.zeros(o)]) for i, o in shapes])
    held = F.col("batch") % 10 == 9 if early_stopping else F.lit(False)
    table = None if classes is None else np.array(classes)
    parts = rows.rdd.getNumPartitions()
    centre, spread = (0.0, 1.0) if classification else _target_scale(rows)

    def backward(flat: np.ndarray, slopes: bool) -> BatchGradient:
        def of(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
            layers, acts, ders = _unpack(flat, shapes), [x], []
            for w, b in layers[:-1]:
                a, da = _activate(activation, acts[-1] @ w + b)
                acts.append(a)
                ders.append(da)
            out = acts[-1] @ layers[-1][0] + layers[-1][1]
            if table is None:
                delta = out - ((y - centre) / spread)[:, None]
                loss = 0.5 * float((delta**2).sum())
            else:
                out = out - out.max(axis=1, keepdims=True)
                p = np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
                hit = (y[:, None] == table[None, :]).astype(float)
                loss, delta = -float((hit * np.log(np.maximum(p, 1e-300))).sum()), p - hit
            if not slopes:
                return loss, np.zeros(len(flat))
            grads = []
            for i in range(len(layers) - 1, -1, -1):
                grads.append(np.concatenate([(acts[i].T @ delta).ravel(), delta.sum(axis=0)]))
                if i:
                    delta = (delta @ layers[i][0].T) * ders[i - 1]
            return loss, np.concatenate(grads[::-1])
        return of

    decay = np.concatenate([np.concatenate([np.ones(i * o), np.zeros(o)]) for i, o in shapes])
    first, second, t, best, stale, epoch, mean = np.zeros_like(flat), np.zeros_like(flat), 0, math.inf, 0, 0, math.inf
    for epoch in range(1, max_iter + 1):
        loss_sum, count = 0.0, 0
        for b in range(batches):
            part = rows.filter(~held & (F.col("batch") % batches == b)) if batches > 1 or early_stopping else rows
            loss, grad, n = summed_gradient(part, len(flat), backward(flat, True), parts)
            if not n:
                continue
            loss_sum, count, t = loss_sum + loss, count + n, t + 1
            grad = grad / n + alpha * decay * flat / n
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            flat = flat - learning_rate_init * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        mean = loss_sum / max(count, 1)
        judged = mean
        if early_stopping:
            loss, _, n = summed_gradient(rows.filter(held), len(flat), backward(flat, False), parts)
            judged = loss / max(n, 1)
        stale = stale + 1 if judged > best - tol else 0
        best = min(best, judged)
        if stale >= n_iter_no_change:
            break
    rows.unpersist()
    return NetworkModel(features, shapes, flat, activation, classes, epoch, float(mean), centre, spread)

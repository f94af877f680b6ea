"""K-means in its batch, fixed-start and mini-batch forms, and the elbow of its cost curve."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import total
from tablewright.operators.linear import VECTOR, assemble
from tablewright.operators.ranking import row_hash
from tablewright.session import spread


@dataclass(frozen=True)
class CenterModel:
    features: list[str]
    centers: list[list[float]]
    weights: list[float] | None = None  # rows seen per centre, for running means

    def squared(self, center: Sequence[float]) -> Column:
        return total([F.pow(F.col(f) - F.lit(float(m)), F.lit(2.0)) for f, m in zip(self.features, center)])

    def transform(self, df: DataFrame, prediction: str = "cluster") -> DataFrame:
        """The nearest centre, the first one on a tie."""
        if len(self.centers) * len(self.features) > 128:  # one lambda instead of very much generated code
            rows = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in self.centers])
            x = F.array(*[F.col(f).cast("double") for f in self.features])
            distances = F.transform(rows, lambda c: F.aggregate(
                F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
        else:
            distances = F.array(*[self.squared(c) for c in self.centers])
        return df.withColumn(prediction, (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))

    def cost(self, df: DataFrame) -> float:
        distances = [self.squared(c) for c in self.centers]
        nearest = F.array_min(F.array(*distances))
        return df.agg(F.sum(nearest)).first()[0] or 0.0


def fit_kmeans(df: DataFrame, features: Sequence[str], n_clusters: int = 3, init: str = "k-means++", n_init: int = 1,
               max_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> CenterModel:
    """Best of ``n_init`` starts by cost. ``k-means++`` starts run as its parallel form."""
    if n_clusters < 1:
        raise ValueError("n_clusters must be positive")
    mode = {"k-means++": "k-means||", "random": "random"}[init]
    if n_clusters == 1:
        row = df.agg(*[F.avg(f) for f in features]).first()
        return CenterModel(list(features), [[float(v) for v in row]])
    rows = assemble(df, features).select(VECTOR).persist()
    best = None
    for start in range(n_init):
        fitted = KMeans(featuresCol=VECTOR, k=n_clusters, initMode=mode, maxIter=max_iter, tol=tol, seed=seed + start).fit(rows)
        cost = fitted.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, [[float(v) for v in c] for c in fitted.clusterCenters()])
    rows.unpersist()
    return CenterModel(list(features), best[1])


def fit_from_centers(df: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], max_iter: int = 300,
                     tol: float = 1e-4) -> CenterModel:
    """Lloyd iterations from given centres; an empty cluster keeps its centre."""
    model = CenterModel(list(features), [list(map(float, c)) for c in centers])
    for _ in range(max_iter):
        means = {r["cluster"]: [r[f"m{i}"] for i in range(len(features))] for r in model.transform(df).groupBy("cluster").agg(
            *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]).collect()}
        moved = [means.get(k, c) for k, c in enumerate(model.centers)]
        shift = sum((a - b) ** 2 for old, new in zip(model.centers, moved) for a, b in zip(old, new))
        model = replace(model, centers=moved)
        if shift <= tol:
            break
    return model


def update_centers(model: CenterModel, batch: DataFrame) -> CenterModel:
    """One mini-batch step (Sculley 2010): centres move towards the batch means by their share of rows seen."""
    rows = model.transform(batch).groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(model.features)]).collect()
    centers, weights = [list(c) for c in model.centers], list(model.weights or [0.0] * len(model.centers))
    for r in rows:
        k = r["cluster"]
        weights[k] += r["n"]
        rate = r["n"] / weights[k]
        centers[k] = [c + rate * (r[f"m{i}"] - c) for i, c in enumerate(centers[k])]
    return CenterModel(model.features, centers, weights)


def fit_minibatch(df: DataFrame, features: Sequence[str], keys: Sequence[str], n_clusters: int = 3, batch_size: int = 1024,
                  max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> CenterModel:
    """Mini-batch k-means. Each step reads a hash-chosen share of about ``batch_size`` rows."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    cached = df.select(*keys, *features).persist()
    n = cached.count()
    share = min(1.0, batch_size / max(n, 1))

    def batch(step: int) -> DataFrame:
        if share >= 1.0:
            return cached
        return cached.filter(F.substring(row_hash(seed + step, *keys), 1, 15) < format(int(share * 16**15), "015x"))

    start = batch(0)
    model = fit_kmeans(start if start.count() >= n_clusters else cached, features, n_clusters, n_init=3, max_iter=5, seed=seed)
    model = replace(model, weights=[0.0] * n_clusters)
    for step in range(1, max_iter + 1):
        moved = update_centers(model, batch(step))
        shift = sum((a - b) ** 2 for old, new in zip(model.centers, moved.centers) for a, b in zip(old, new))
        model = moved
        if shift <= tol:
            break
    cached.unpersist()
    return model


def find_knee(xs: Sequence[float], ys: Sequence[float], curve: str = "convex", direction: str = "decreasing", s: float = 1.0) -> float | None:
    """Kneedle (Satopää 2011) over a handful of points: where the normalised curve leaves the diagonal most."""
    if len(xs) < 3 or max(ys) == min(ys):
        return None
    nx = [(x - xs[0]) / (xs[-1] - xs[0]) for x in xs]
    ny = [(y - min(ys)) / (max(ys) - min(ys)) for y in ys]
    if curve == "convex" and direction == "decreasing":
        diff = [(1 - y) - x for x, y in zip(nx, ny)]
    elif curve == "concave" and direction == "increasing":
        diff = [y - x for x, y in zip(nx, ny)]
    elif curve == "concave":
        diff = [y - (1 - x) for x, y in zip(nx, ny)]
    else:
        diff = [x - y for x, y in zip(nx, ny)]
    step = sum(b - a for a, b in zip(nx, nx[1:])) / (len(nx) - 1)
    for i in range(1, len(diff) - 1):
        if diff[i] >= diff[i - 1] and diff[i] > diff[i + 1]:
            threshold = diff[i] - s * step
            for later in diff[i + 1:]:
                if later > diff[i]:
                    break
                if later < threshold:
                    return xs[i]
    return None


def elbow(df: DataFrame, features: Sequence[str], max_clusters: int = 10, curve: str = "convex", direction: str = "decreasing",
          seed: int = 42) -> DataFrame:
    """``(k, inertia, is_elbow)`` for k = 1..max; without a knee, half of the maximum is marked."""
    if not 2 <= max_clusters <= 20:
        raise ValueError("max_clusters lies between 2 and 20")
    cached = spread(df.select(*features)).persist()
    costs = [fit_kmeans(cached, features, k, seed=seed, n_init=1 if k == 1 else 2).cost(cached) for k in range(1, max_clusters + 1)]
    cached.unpersist()
    knee = find_knee(list(range(1, max_clusters + 1)), costs, curve, direction) or max_clusters // 2
    rows = [(k + 1, float(c), k + 1 == knee) for k, c in enumerate(costs)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, is_elbow boolean")

"""Boosting on Spark: gradient boosting, AdaBoost, and regularised second-order boosting."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import total
from tablewright.operators.linear import VECTOR, assemble
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.trees import Growth, Tree, bin_edges, feature_share, grow, with_bins, tree_sums
from tablewright.session import cut_lineage, spread

CUT_EVERY = 8  # rounds between checkpoints of the running margins

# fixed values: defaults of the three presets
PRESETS = {
    "xgboost": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "reg_lambda": 1.0, "reg_alpha": 0.0, "min_child_weight": 1.0},
    "lightgbm": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "reg_lambda": 0.0, "reg_alpha": 0.0, "min_child_weight": 1e-3},
    "catboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "reg_lambda": 3.0, "reg_alpha": 0.0, "min_child_weight": 1.0},
}


@dataclass(frozen=True)
class BoostedModel:
    """Start value per output plus scaled trees; classes are None for regression."""

    features: list[str]
    start: list[float]
    rounds: list[list[Tree]]  # rounds × outputs
    learning_rate: float
    classes: list[float] | None

    def margins(self) -> list[Column]:
        sums = tree_sums([[r[c] for r in self.rounds] for c in range(len(self.start))], self.features)
        return [F.lit(s) + v * F.lit(self.learning_rate) for s, v in zip(self.start, sums)]

    def importances(self) -> list[float]:
        return [sum(t.gains.get(f, 0.0) for r in self.rounds for t in r) for f in self.features]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        margins = self.margins()
        if self.classes is None:
            return df.withColumn(prediction, margins[0])
        if len(margins) == 1:
            return df.withColumn(prediction, F.when(margins[0] > 0, self.classes[1]).otherwise(self.classes[0]))
        scores = F.array(*margins)
        at = F.array_position(scores, F.array_max(scores)).cast("int")
        return df.withColumn(prediction, F.element_at(F.array(*[F.lit(c) for c in self.classes]), at))


def _outputs(rows: DataFrame, label: str, classification: bool) -> tuple[list[float] | None, list[float]]:
    """Classes and start margins: class log-odds or logs of frequencies, or the mean."""
    if not classification:
        return None, [float(rows.agg(F.avg(label)).first()[0])]
    counts = {float(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    classes, n = sorted(counts), sum(counts.values())
    if len(classes) < 2:
        raise ValueError("a classifier needs two classes")
    if len(classes) == 2:
        return classes, [math.log(counts[classes[1]] / counts[classes[0]])]
    return classes, [math.log(counts[c] / n) for c in classes]


def _probabilities(k: int) -> list[Column]:
    if k == 1:
        return [1 / (1 + F.exp(-F.col("_m0")))]
    top = F.greatest(*[F.col(f"_m{c}") for c in range(k)])
    whole = total([F.exp(F.col(f"_m{c}") - top) for c in range(k)])
    return [F.exp(F.col(f"_m{c}") - top) / whole for c in range(k)]


def _drawn(keys: Sequence[str], seed: int, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) < share * 1_000_003


def _advance(rows: DataFrame, trees: list[Tree], rate: float, turn: int) -> DataFrame:
    moved = rows.withColumns({f"_m{c}": F.col(f"_m{c}") + F.lit(rate) * t.expression() for c, t in enumerate(trees)})
    # each round reads the margins several times; a reliable copy now and then bounds the plan
    return cut_lineage(moved) if turn % CUT_EVERY == CUT_EVERY - 1 else moved


def fit_boosted(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", classification: bool = True,
                preset: str = "xgboost", subsample: float = 1.0, colsample_bytree: float = 1.0, seed: int = 42, bins: int = 32,
                **knobs) -> BoostedModel:
    """Second-order boosting with the knobs the three boosting libraries share."""
    unknown = set(knobs) - set(PRESETS["xgboost"])
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    p = {**PRESETS[preset], **knobs}
    features = list(features)
    edges = bin_edges(train, features, bins)
    base = spread(with_bins(train.select(*keys, label, *features), features, edges))
    classes, start = _outputs(base, label, classification)
    if preset == "xgboost" and len(start) > 1:
        start = [0.5] * len(start)
    rows = cut_lineage(base.withColumns({f"_m{c}": F.lit(s) for c, s in enumerate(start)}))
    rounds: list[list[Tree]] = []
    for turn in range(p["n_estimators"]):
        chosen = F.when(_drawn(keys, seed + turn, subsample), 1.0).otherwise(0.0)
        if classification:
            probs = _probabilities(len(start))
            hits = [(F.col(label) == (classes[1] if len(start) == 1 else classes[c])).cast("double") for c in range(len(start))]
            pairs = [((q - y) * chosen, F.greatest(q * (1 - q), F.lit(1e-16)) * chosen) for q, y in zip(probs, hits)]
        else:
            pairs = [((F.col("_m0") - F.col(label)) * chosen, chosen)]
        used = features
        if colsample_bytree < 1.0:
            ranked = sorted(features, key=lambda f: hash_unit(f"{seed}:{turn}:{f}"))
            used = ranked[:max(1, round(colsample_bytree * len(features)))]
        rule = Growth(max_depth=p["max_depth"], min_child_weight=p["min_child_weight"], reg_lambda=p["reg_lambda"], reg_alpha=p["reg_alpha"], seed=seed + turn)
        trees = grow(rows, used, edges, pairs, rule)
        rows = _advance(rows, trees, p["learning_rate"], turn)
        rounds.append(trees)
    return BoostedModel(features, start, rounds, p["learning_rate"], classes)


def hash_unit(text: str) -> float:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 16**8


def fit_gradient_boosting(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", classification: bool = True,
                          loss: str | None = None, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
                          subsample: float = 1.0, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, alpha: float = 0.9,
                          seed: int = 42, min_samples_split: int = 2, max_features: str | int | float | None = None, bins: int = 32) -> BoostedModel:
    """Friedman's gradient boosting: trees follow the negative gradient, leaves are then set to their best value."""
    # fixed values: accepted losses
    losses = ("log_loss", "exponential") if classification else ("squared_error", "absolute_error", "huber", "quantile")
    loss = loss or losses[0]
    if loss not in losses:
        raise ValueError(f"loss is one of {losses}")
    features = list(features)
    edges = bin_edges(train, features, bins)
    base = spread(with_bins(train.select(*keys, label, *features), features, edges))
    classes, start = _outputs(base, label, classification)
    if loss == "exponential":
        if len(classes) > 2:
            raise ValueError("exponential loss takes two classes")
        start = [start[0] / 2]
    if loss in ("absolute_error", "huber", "quantile"):
        start = [float(exact_quantiles(base, [label], [alpha if loss == "quantile" else 0.5]).first()[0])]
    rows = cut_lineage(base.withColumns({f"_m{c}": F.lit(float(s)) for c, s in enumerate(start)}))
    rounds: list[list[Tree]] = []
    k = len(start)
    for turn in range(n_estimators):
        residuals, steps = _gradients(rows, loss, label, classes, k, alpha)
        chosen = F.when(_drawn(keys, seed + turn, subsample), 1.0).otherwise(0.0)
        rule = Growth(max_depth=max_depth, min_child_weight=0.0, min_rows=min_samples_leaf, gamma=min_impurity_decrease, seed=seed + turn,
                      min_split=min_samples_split, feature_share=feature_share(max_features, len(features)))
        trees = grow(rows, features, edges, [(-r * chosen, chosen) for r in residuals], rule)
        if loss != "squared_error":
            trees = [_refit_leaves(rows.filter(chosen > 0), t, r, s, loss, label, alpha, k) for t, r, s in zip(trees, residuals, steps)]
        rows = _advance(rows, trees, learning_rate, turn)
        rounds.append(trees)
    return BoostedModel(features, [float(s) for s in start], rounds, learning_rate, classes)


def _gradients(rows: DataFrame, loss: str, label: str, classes: list[float] | None, k: int, alpha: float) -> tuple[list[Column], list[Column]]:
    """Negative gradient and curvature per output."""
    y = F.col(label).cast("double")
    gap = y - F.col("_m0")
    if loss == "log_loss":
        probs = _probabilities(k)
        hits = [(y == (classes[1] if k == 1 else classes[c])).cast("double") for c in range(k)]
        return [h - q for h, q in zip(hits, probs)], [q * (1 - q) for q in probs]
    if loss == "exponential":
        sign = F.when(y == classes[1], 1.0).otherwise(-1.0)
        w = F.exp(-sign * F.col("_m0"))
        return [sign * w], [w]
    if loss == "absolute_error":
        return [F.signum(gap)], [F.lit(1.0)]
    if loss == "quantile":
        return [F.when(gap > 0, alpha).otherwise(alpha - 1)], [F.lit(1.0)]
    if loss == "huber":
        limit = exact_quantiles(rows.select(F.abs(gap).alias("_g")), ["_g"], [alpha]).first()[0]
        return [F.when(F.abs(gap) <= limit, gap).otherwise(F.signum(gap) * F.lit(float(limit)))], [F.lit(float(limit))]
    return [gap], [F.lit(1.0)]


def _refit_leaves(rows: DataFrame, tree: Tree, residual: Column, curve: Column, loss: str, label: str, alpha: float, k: int) -> Tree:
    leaves = replace_values(tree)
    placed = rows.withColumn("_leaf", leaves.expression())
    if loss in ("absolute_error", "quantile", "huber"):
        gap = placed.withColumn("_gap", F.col(label) - F.col("_m0"))
        middle = exact_quantiles(gap, ["_gap"], [alpha if loss == "quantile" else 0.5], ["_leaf"])
        best = {int(r["_leaf"]): r["_gap_q0"] for r in middle.collect()}
        if loss == "huber":
            limit = {int(r["_leaf"]): r["l"] for r in placed.groupBy("_leaf").agg(F.first(curve).alias("l")).collect()}
            centre = F.element_at(F.create_map(*[F.lit(x) for n, v in best.items() for x in (float(n), float(v))]), F.col("_leaf"))
            off = F.col("_gap") - centre
            bound = F.lit(float(next(iter(limit.values()))))
            pulled = gap.groupBy("_leaf").agg(F.avg(F.signum(off) * F.least(F.abs(off), bound)).alias("d")).collect()
            best = {int(r["_leaf"]): best[int(r["_leaf"])] + r["d"] for r in pulled}
    else:
        shrink = (k - 1) / k if k > 1 else 1.0
        sums = placed.groupBy("_leaf").agg((F.sum(residual) / F.greatest(F.sum(curve), F.lit(1e-150)) * shrink).alias("v"))
        best = {int(r["_leaf"]): r["v"] for r in sums.collect()}
    return Tree(tree.splits, {n: float(best.get(n, 0.0)) for n in tree.values}, tree.gains)


def replace_values(tree: Tree) -> Tree:
    """The same tree answering with its leaf numbers."""
    return Tree(tree.splits, {n: float(n) for n in tree.values}, tree.gains)


# --- AdaBoost ----------------------------------------------------------------------------


@dataclass(frozen=True)
class AdaModel:
    features: list[str]
    members: list[object]
    weights: list[float]
    classes: list[float] | None

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        scored = assemble(df, self.features)
        for i, m in enumerate(self.members):
            kept = scored.columns
            scored = m.transform(scored).select(*kept, F.col("prediction").alias(f"_p{i}"))
        names = [f"_p{i}" for i in range(len(self.members))]
        if self.classes is not None:
            votes = F.array(*[total([F.when(F.col(n) == c, w).otherwise(0.0) for n, w in zip(names, self.weights)]) for c in self.classes])
            at = F.array_position(votes, F.array_max(votes)).cast("int")
            out = F.element_at(F.array(*[F.lit(c) for c in self.classes]), at)
        else:
            # weighted median of the members: the first one reaching half of the weight
            pairs = F.array_sort(F.array(*[F.struct(F.col(n).alias("v"), F.lit(w).alias("w")) for n, w in zip(names, self.weights)]))
            half = F.lit(sum(self.weights) / 2)
            walked = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v")), lambda acc, x: F.struct(
                (acc["s"] + x["w"]).alias("s"), F.when((acc["s"] < half) & (acc["s"] + x["w"] >= half), x["v"]).otherwise(acc["v"]).alias("v")))
            out = walked["v"]
        return scored.withColumn(prediction, out).select(*df.columns, prediction)


def fit_adaboost(train: DataFrame, features: Sequence[str], label: str = "label", classification: bool = True, n_estimators: int = 50,
                 learning_rate: float = 1.0, loss: str = "linear", seed: int = 42) -> AdaModel:
    """SAMME (Zhu 2009) on stumps, or AdaBoost.R2 (Drucker 1997) on trees of depth 3."""
    if loss not in ("linear", "square", "exponential"):
        raise ValueError("loss is linear, square or exponential")
    rows = spread(assemble(train, features).select(label, VECTOR))
    n = rows.count()
    rows = rows.withColumn("_w", F.lit(1.0 / n)).persist()
    classes = [float(r[0]) for r in rows.select(label).distinct().orderBy(label).collect()] if classification else None
    members, weights = [], []
    for turn in range(n_estimators):
        common = {"featuresCol": VECTOR, "labelCol": label, "weightCol": "_w", "seed": seed}
        tree = (DecisionTreeClassifier(maxDepth=1, **common) if classification else DecisionTreeRegressor(maxDepth=3, **common)).fit(rows)
        judged = tree.transform(rows).select(label, VECTOR, "_w", "prediction")
        if classification:
            missed = (F.col("prediction") != F.col(label)).cast("double")
            err = judged.agg(F.sum(missed * F.col("_w")) / F.sum("_w")).first()[0]
            if err <= 0:
                members.append(tree)
                weights.append(1.0)
                break
            if err >= 1 - 1 / len(classes):
                break
            power = learning_rate * (math.log((1 - err) / err) + math.log(len(classes) - 1))
            fresh = F.col("_w") * F.exp(F.lit(power) * missed)
        else:
            gap = F.abs(F.col("prediction") - F.col(label))
            largest = judged.agg(F.max(gap)).first()[0]
            if not largest:
                members.append(tree)
                weights.append(1.0)
                break
            rel = gap / F.lit(largest)
            rel = {"linear": rel, "square": rel * rel, "exponential": 1 - F.exp(-rel)}[loss]
            err = judged.agg(F.sum(rel * F.col("_w")) / F.sum("_w")).first()[0]
            if err >= 0.5:
                if not members:
                    members.append(tree)
                    weights.append(1.0)
                break
            beta = err / (1 - err)
            power = learning_rate * math.log(1 / beta)
            fresh = F.col("_w") * F.pow(F.lit(beta), (1 - rel) * learning_rate)
        members.append(tree)
        weights.append(float(power))
        whole = judged.agg(F.sum(fresh)).first()[0]
        rows = judged.select(label, VECTOR, (fresh / F.lit(whole)).alias("_w"))
        if turn % 4 == 3:
            rows = cut_lineage(rows)
    return AdaModel(list(features), members, weights, classes)

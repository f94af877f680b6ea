"""Decision trees and forests: Spark's own, and a level-wise histogram builder for the kinds it lacks.

The builder grows many trees at once. In a level each partition fills flat arrays of
histograms by node, feature and bin, which are summed as arrays; only the best split of
each node, a handful of numbers, reaches the driver. Trees are applied as flat arrays.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.linear import SparkModel, VECTOR, assemble
from tablewright.session import spread

MAX_SPARK_DEPTH = 30  # fixed value: deepest tree Spark accepts
SMALL_TREE = 31  # splits of a tree that is written as column arithmetic
NO_LIMIT = 10**9  # levels; growth ends when no node can be split
LEVEL_CELLS = 4_000_000  # histogram cells that a task fills in one pass
GROUP_CELLS = 200_000  # cells that are judged together
GROUP_BYTES = 64 << 20  # of histograms that one task receives from all partitions together
NODE_ROWS = 50_000  # rows of a node, copies included, below which one task grows all that lies under it


def _tree_params(max_depth: int | None, min_samples_leaf: int, min_weight_fraction: float, min_gain: float, seed: int,
                 max_bins: int = 32) -> dict:
    """``max_depth=None`` is Spark's deepest; deeper trees are refused, not cut."""
    if max_depth is not None and not 1 <= max_depth <= MAX_SPARK_DEPTH:
        raise ValueError(f"max_depth lies between 1 and {MAX_SPARK_DEPTH}, the deepest tree Spark grows")
    return {"maxDepth": max_depth or MAX_SPARK_DEPTH, "minInstancesPerNode": min_samples_leaf,
            "minWeightFractionPerNode": min_weight_fraction, "minInfoGain": min_gain, "seed": seed, "maxBins": max_bins}


def least_leaf(min_samples_leaf: int, min_samples_split: int) -> int:
    """Spark has no least size of a node to split. Only the values that its leaf rule implies are accepted."""
    if min_samples_split > max(2, 2 * min_samples_leaf):
        raise ValueError("min_samples_split above 2 * min_samples_leaf is not supported by Spark's trees; raise min_samples_leaf")
    return min_samples_leaf


def feature_share(max_features: str | int | float | None, size: int) -> float:
    """The share of ``size`` features tried at a node: ``sqrt``, ``log2``, a count (int), a share (float), or all (None)."""
    if max_features in (None, "all"):
        return 1.0
    if max_features == "sqrt":
        return max(1, int(size ** 0.5)) / size
    if max_features == "log2":
        return max(1, int(math.log2(size))) / size if size > 1 else 1.0
    if isinstance(max_features, int):
        if not 1 <= max_features <= size:
            raise ValueError(f"max_features lies between 1 and {size}")
        return max_features / size
    if isinstance(max_features, float) and 0 < max_features <= 1:
        return max(1, int(max_features * size)) / size
    raise ValueError("max_features is sqrt, log2, a count, a share or None")


def _subset(max_features: str | float | None) -> str:
    return "all" if max_features is None else str(max_features)


def fit_tree(train: DataFrame, features: Sequence[str], label: str = "label", classification: bool = True, max_depth: int | None = 5,
             min_samples_leaf: int = 1, criterion: str | None = None, max_features: str | float | None = None,
             min_impurity_decrease: float = 0.0, seed: int = 42, min_samples_split: int = 2, max_bins: int = 32) -> SparkModel:
    min_samples_leaf = least_leaf(min_samples_leaf, min_samples_split)
    params = _tree_params(max_depth, min_samples_leaf, 0.0, min_impurity_decrease, seed, max_bins)
    if max_features is not None:
        return fit_forest(train, features, label, classification, 1, max_depth, min_samples_leaf, 0.0, max_features,
                          min_impurity_decrease, False, criterion, seed, max_bins=max_bins)
    common = {"featuresCol": VECTOR, "labelCol": label, **params}
    if classification:
        estimator = DecisionTreeClassifier(impurity=_impurity(criterion, True), **common)
    else:
        estimator = DecisionTreeRegressor(impurity=_impurity(criterion, False), **common)
    return SparkModel(list(features), estimator.fit(assemble(train, features)))


def _impurity(criterion: str | None, classification: bool) -> str:
    # fixed values: accepted split criteria
    known = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy"} if classification else {"squared_error": "variance"}
    name = criterion or ("gini" if classification else "squared_error")
    if name not in known:
        raise ValueError(f"criterion is one of {sorted(known)}")
    return known[name]


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", classification: bool = True, n_estimators: int = 100,
               max_depth: int | None = None, min_samples_leaf: int = 1, min_weight_fraction_leaf: float = 0.0,
               max_features: str | float | None = "sqrt", min_impurity_decrease: float = 0.0, bootstrap: bool = True,
               criterion: str | None = None, seed: int = 42, min_samples_split: int = 2, max_bins: int = 32) -> SparkModel | MeanForest:
    """Classes: Spark's own forest. Values: ``fit_mean_forest``, since trees of thousands of leaves take Spark a dense histogram for each node."""
    min_samples_leaf = least_leaf(min_samples_leaf, min_samples_split)
    params = _tree_params(max_depth, min_samples_leaf, min_weight_fraction_leaf, min_impurity_decrease, seed, max_bins)
    impurity = _impurity(criterion, classification)
    if not classification:
        rule = Growth(max_depth=params["maxDepth"], min_child_weight=min_samples_leaf, min_decrease=min_impurity_decrease, seed=seed,
                      feature_share=features_tried(_subset(max_features), len(features), n_estimators) / len(features))
        return fit_mean_forest(train, features, label, n_estimators, rule, min_weight_fraction_leaf, bootstrap, max_bins)
    common = {"featuresCol": VECTOR, "labelCol": label, "numTrees": n_estimators, "bootstrap": bootstrap,
              "featureSubsetStrategy": _subset(max_features), **params}
    estimator = RandomForestClassifier(impurity=impurity, **common)
    return SparkModel(list(features), estimator.fit(spread(assemble(train, features))))


def feature_importance(model, spark, top: int | None = None) -> DataFrame:
    """``(feature, importance)`` adding up to 1, largest first."""
    if isinstance(model, SparkModel):
        values = [float(v) for v in model.model.featureImportances.toArray()]
    else:
        values = model.importances()
    whole = sum(values) or 1.0
    rows = sorted(((f, v / whole) for f, v in zip(model.features, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top], "feature string, importance double")


# --- histogram builder -------------------------------------------------------------------


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Inner bin edges per feature from bounded quantile sketches of one pass."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(f, probs, F.lit(10_000)).alias(f) for f in features]).first()
    return {f: sorted(set(float(v) for v in row[f])) for f in features}


def bin_column(feature: str, edges: Sequence[float]) -> Column:
    """The number of edges below the value: bin b holds values in (edge[b-1], edge[b]]."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(feature)))


@dataclass
class Tree:
    splits: dict[int, tuple[str, float]] = field(default_factory=dict)  # node -> (feature, threshold), left if <=
    values: dict[int, float] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=dict)

    def expression(self) -> Column:
        """A small tree as column arithmetic; a larger one, whose plan would grow with it, as a function over flat arrays."""
        if len(self.splits) > SMALL_TREE:
            used = sorted({f for f, _ in self.splits.values()})
            return tree_sums([[self]], used)[0]

        def walk(node: int) -> Column:
            if node not in self.splits:
                return F.lit(float(self.values.get(node, 0.0)))
            feature, threshold = self.splits[node]
            return F.when(F.col(feature) <= threshold, walk(2 * node)).otherwise(walk(2 * node + 1))
        return walk(1)


@dataclass
class FlatTree:
    """A tree as arrays over its nodes, the root first: feature (-1 at a leaf), threshold, children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    names: list[int]

    @staticmethod
    def of(tree: Tree, features: Sequence[str], cuts: dict[str, list[float]] | None = None) -> "FlatTree":
        """With ``cuts`` thresholds are bin numbers in place of values."""
        at = {f: i for i, f in enumerate(features)}
        names, place = [1], {1: 0}
        for node in names:  # grows while it is walked
            if node in tree.splits:
                for child in (2 * node, 2 * node + 1):
                    place[child] = len(names)
                    names.append(child)
        n = len(names)
        out = FlatTree(np.full(n, -1), np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), names)
        for i, node in enumerate(names):
            if node in tree.splits:
                feature, threshold = tree.splits[node]
                out.feature[i] = at[feature]
                out.threshold[i] = threshold if cuts is None else bisect.bisect_left(cuts[feature], threshold)
                out.left[i], out.right[i] = place[2 * node], place[2 * node + 1]
            else:
                out.value[i] = tree.values.get(node, 0.0)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The place of each row's node; rows that reached a leaf leave the walk."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x)) if self.feature[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(moving):
            node = at[moving]
            inside = x[moving, self.feature[node]] <= self.threshold[node]  # a NULL goes right, as in SQL
            at[moving] = np.where(inside, self.left[node], self.right[node])
            moving = moving[self.feature[at[moving]] >= 0]
        return at


def tree_sums(groups: list[list[Tree]], features: Sequence[str]) -> list[Column]:
    """For each group of trees the sum of their values, from one vectorised function."""
    flat = [[FlatTree.of(t, features) for t in group] for group in groups]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def summed(x: pd.Series) -> pd.Series:
        rows = np.array(list(x), dtype=float).reshape(len(x), -1)
        out = np.zeros((len(rows), len(flat)))
        for c, group in enumerate(flat):
            for tree in group:
                out[:, c] += tree.value[tree.leaves(rows)]
        return pd.Series(list(out))

    sums = summed(F.array(*[F.col(f).cast("double") for f in features]) if features else F.array(F.lit(0.0)))
    return [sums[c] for c in range(len(groups))]


@dataclass(frozen=True)
class Growth:
    max_depth: int = 3
    min_child_weight: float = 1.0
    min_rows: int = 1
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    feature_share: float = 1.0
    random_threshold: bool = False
    seed: int = 42
    min_split: int = 2
    min_decrease: float = 0.0  # of the mean gain of a node's rows


def _unit(*parts: int) -> float:
    """A number from 0 to 1 that follows from whole numbers."""
    x = 0
    for part in parts:
        x = (x ^ (part & _MASK)) * 0x9E3779B97F4A7C15 & _MASK
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK
        x ^= x >> 32
    return x / 2**64


_MASK = 2**64 - 1


def best_split(cells: np.ndarray, rule: Growth, t: int, node: int) -> tuple:
    """``(G, H, gain, feature, bin, left G, left H)`` of a node's histogram: features x bins x (gradient, hessian, rows)."""
    lam, alpha = rule.reg_lambda, rule.reg_alpha

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        g = np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)
        return np.divide(g * g, h + lam, out=np.zeros_like(g), where=h + lam > 0)

    whole = cells[0].sum(axis=0)
    run = np.cumsum(cells, axis=1)
    rest = whole - run
    gain = score(run[..., 0], run[..., 1]) + score(rest[..., 0], rest[..., 1]) - score(whole[0:1], whole[1:2])
    allowed = (run[..., 1] >= rule.min_child_weight) & (rest[..., 1] >= rule.min_child_weight) & (run[..., 2] >= rule.min_rows) & (
        rest[..., 2] >= rule.min_rows) & (rest[..., 2] > 0) & (run[..., 2] > 0) & (whole[2] >= rule.min_split)
    n_features, bins = gain.shape
    if rule.random_threshold:
        pick = np.zeros_like(allowed)
        for f in range(n_features):
            held = np.flatnonzero(cells[f, :, 2])
            if len(held):
                # the threshold lies behind the last occupied bin up to the drawn position, which is never the last of all
                spot = held[0] + int(_unit(rule.seed, t, node, f) * (held[-1] - held[0]))
                pick[f, held[np.searchsorted(held, spot, side="right") - 1]] = True
        allowed &= pick
    if rule.feature_share < 1.0:
        order = sorted(range(n_features), key=lambda f: _unit(rule.seed + 1, t, node, f))
        allowed[order[max(1, round(rule.feature_share * n_features)):]] = False
    gain = np.where(allowed & (gain > max(rule.gamma, 1e-12)) & (gain >= rule.min_decrease * whole[1]), gain, -np.inf)
    at = int(gain.argmax())  # of equal gains the first feature and bin
    f, b = divmod(at, bins)
    if not np.isfinite(gain[f, b]):
        return float(whole[0]), float(whole[1]), None, None, None, None, None
    return float(whole[0]), float(whole[1]), float(gain[f, b]), f, b, float(run[f, b, 0]), float(run[f, b, 1])


def judged_together(size: int, parts: int) -> int:
    """How many nodes of ``size`` cells a task judges: each of ``parts`` partitions sends it their histograms."""
    return max(1, min(GROUP_CELLS, GROUP_BYTES // (24 * max(parts, 1))) // size)


def _level(packed: DataFrame, flat: list[FlatTree], nodes: list[tuple[int, int]], n_features: int, bins: int, rule: Growth,
           target: list[int], parts: int, drawn: Callable[[np.ndarray, int], np.ndarray] | None = None) -> list:
    """The best split of each open node ``(tree, node)``: histograms within partitions, summed as arrays, judged per group of nodes.

    ``drawn`` gives the copies of rows in a tree's sample from their column ``u``.
    """
    by_tree: dict[int, list[tuple[int, int]]] = {}
    for slot, (t, node) in enumerate(nodes):
        by_tree.setdefault(t, []).append((slot, node))
    size = n_features * bins
    group = judged_together(size, parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), size, 3))
        slots = {}
        for t, own in by_tree.items():  # nodes of a tree have neighbouring slots
            place = {name: i for i, name in enumerate(flat[t].names)}
            slots[t] = np.full(len(place), -1)
            for slot, node in own:
                slots[t][place[node]] = slot - own[0][0]
        for batch in batches:
            x, g, h = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("bins", "g", "h"))
            for t, own in by_tree.items():
                slot = slots[t][flat[t].leaves(x)]
                gt, ht = g[:, target[t]], h[:, target[t]]
                if drawn is not None:
                    copies = drawn(batch.column("u").to_numpy(), t)
                    gt, ht = gt * copies, ht * copies
                keep = np.flatnonzero((slot >= 0) & (ht > 0))
                cell = (slot[keep, None] * size + np.arange(n_features) * bins + x[keep]).ravel()
                part = total[own[0][0]:own[0][0] + len(own)].reshape(-1, 3)
                for i, w in enumerate((gt[keep], ht[keep], None)):
                    part[:, i] += np.bincount(cell, None if w is None else np.repeat(w, n_features), minlength=len(part))
        held = np.flatnonzero(total[:, :, 2].any(axis=1))
        for k in range(0, len(held), group):
            some = held[k:k + group]
            values = pa.array(total[some].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size * 3, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array(some // group, pa.int32()), pa.array(some, pa.int32()), lists], names=["part", "slot", "cells"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cells = [], {}
        for slot, values in zip(pdf["slot"], pdf["cells"]):  # one row for each partition that holds rows of the node
            cells[slot] = cells[slot] + values if slot in cells else np.array(values)
        for slot, values in cells.items():
            rows.append((slot, *best_split(values.reshape(n_features, bins, 3), rule, *nodes[slot])))
        return pd.DataFrame(rows, columns=["slot", "G", "H", "gain", "f", "b", "lg", "lh"])

    counted = packed.mapInArrow(count, "part int, slot int, cells array<double>")
    return counted.groupBy("part").applyInPandas(judge, "slot int, G double, H double, gain double, f double, b double, lg double, lh double").collect()


def grow(binned: DataFrame, features: Sequence[str], edges: dict[str, list[float]], targets: list[tuple[Column, Column]],
         rule: Growth, weight: Column | None = None) -> list[Tree]:
    """One tree per (gradient, hessian) pair, all grown level by level together.

    Gain and leaf weight follow Chen & Guestrin (2016): G²/(H+λ), −G/(H+λ), with soft-thresholded G for ``reg_alpha``.
    ``random_threshold`` lets a hash draw one threshold per node and feature, as extremely randomised trees do. Each partition
    fills one array of histograms; open nodes whose arrays would pass ``LEVEL_CELLS`` are taken in several passes. A level sends
    the driver one row for each open node. A pair that several trees share is held once.
    """
    trees = [Tree() for _ in targets]
    pairs = {id(p): p for p in targets}
    place = {name: c for c, name in enumerate(pairs)}
    target = [place[id(p)] for p in targets]
    features = list(features)
    bins = max((len(edges[f]) for f in features), default=0) + 1
    packed = binned.select(F.array(*[F.col(f"_b_{f}").cast("int") for f in features]).alias("bins"),
                           F.array(*[g.cast("double") for g, _ in pairs.values()]).alias("g"), F.array(*[h.cast("double") for _, h in pairs.values()]).alias("h"))
    # a level reads the rows once: what the targets compute is kept for the whole tree
    packed = packed.persist()
    parts = packed.rdd.getNumPartitions()

    def leaf(g: float, h: float) -> float:
        g = math.copysign(max(abs(g) - rule.reg_alpha, 0.0), g)
        return -g / (h + rule.reg_lambda) if h + rule.reg_lambda else 0.0

    level = [(t, 1) for t in range(len(trees))]
    wave = max(1, LEVEL_CELLS // max(len(features) * bins, 1))
    for _ in range(rule.max_depth):
        flat, below = [FlatTree.of(t, features, edges) for t in trees], []
        for first in range(0, len(level), wave):
            some = level[first:first + wave]
            for r in sorted(_level(packed, flat, some, len(features), bins, rule, target, parts), key=lambda r: r["slot"]):
                t, node = some[r["slot"]]
                tree = trees[t]
                tree.values[node] = leaf(r["G"], r["H"])
                if r["gain"] is None:
                    continue
                feature = features[int(r["f"])]
                tree.splits[node] = (feature, edges[feature][int(r["b"])])
                tree.gains[feature] = tree.gains.get(feature, 0.0) + r["gain"]
                del tree.values[node]
                tree.values[2 * node] = leaf(r["lg"], r["lh"])
                tree.values[2 * node + 1] = leaf(r["G"] - r["lg"], r["H"] - r["lh"])
                below += [(t, 2 * node), (t, 2 * node + 1)]
        level = sorted(below)
        if not level:
            break
    packed.unpersist()
    return trees


def with_bins(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    return df.withColumns({f"_b_{f}": bin_column(f, edges[f]) for f in features})


@dataclass(frozen=True)
class ForestModel:
    """Averaged trees; for classes, one tree per class and member, each voting with its leaf frequency."""

    features: list[str]
    trees: list[Tree]
    classes: list[float] | None

    def importances(self) -> list[float]:
        return [sum(t.gains.get(f, 0.0) for t in self.trees) for f in self.features]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        k = len(self.classes or [None])
        sums = tree_sums([self.trees[c::k] for c in range(k)], self.features)
        if self.classes is None:
            return df.withColumn(prediction, sums[0] / F.lit(float(len(self.trees))))
        votes = F.array(*sums)
        at = F.array_position(votes, F.array_max(votes)).cast("int")
        return df.withColumn(prediction, F.element_at(F.array(*[F.lit(c) for c in self.classes]), at))


def _forest_pair(label: str, value: float | None, copies: Column) -> tuple[Column, Column]:
    """Gradient and hessian of a forest's member: the label, or whether it is ``value``, times the copies of the row."""
    y = F.col(label).cast("double") if value is None else (F.col(label) == value).cast("double")
    return -y * copies, copies


def fit_extra_trees(train: DataFrame, features: Sequence[str], keys: Sequence[str], label: str = "label", classification: bool = True,
                    n_estimators: int = 100, max_depth: int | None = 8, min_samples_leaf: int = 1, max_features: str | int | float | None = "sqrt",
                    bootstrap: bool = False, seed: int = 42, batch: int = 50, min_samples_split: int = 2, bins: int = 32) -> ForestModel:
    """Extremely randomised trees. Members grow in batches that share one pass per level.

    ``max_depth=None`` grows until no node can be split.
    """
    features = list(features)
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth is at least 1, or None for no limit")
    share = feature_share(max_features, len(features))
    edges = bin_edges(train, features, bins)
    binned = spread(with_bins(train.select(*keys, label, *features), features, edges)).persist()
    classes = [float(r[0]) for r in binned.select(label).distinct().orderBy(label).collect()] if classification else None
    trees: list[Tree] = []
    plain = None if bootstrap else [_forest_pair(label, c, F.lit(1.0)) for c in classes or [None]]
    for first in range(0, n_estimators, batch):
        targets = []
        for m in range(first, min(first + batch, n_estimators)):
            if plain is not None:  # all members see the same rows
                targets += plain
                continue
            # a row enters a bootstrap sample about e^-1 … times: drawn by hash, 0, 1, 2 or 3 copies
            u = F.pmod(F.xxhash64(F.lit(seed + m), *keys), F.lit(1_000_003)) / F.lit(1_000_003.0)
            copies = F.when(u < 0.3679, 0.0).when(u < 0.7358, 1.0).when(u < 0.9197, 2.0).otherwise(3.0)
            targets += [_forest_pair(label, c, copies) for c in classes or [None]]
        rule = Growth(max_depth=max_depth or NO_LIMIT, min_rows=min_samples_leaf, feature_share=share, random_threshold=True, seed=seed + first,
                      min_split=min_samples_split)
        trees += grow(binned, features, edges, targets, rule)
    binned.unpersist()
    return ForestModel(features, trees, classes)


# --- forests of deep trees of values -------------------------------------------------------


def features_tried(subset: str, size: int, n_trees: int) -> int:
    """Features that a node tries, by the names that Spark's forests know, a count or a share."""
    if subset == "all" or (subset == "auto" and n_trees == 1):
        return size
    known = {"auto": size / 3, "onethird": size / 3, "sqrt": size ** 0.5, "log2": math.log2(size) if size > 1 else 1.0}
    if subset in known:
        return max(1, math.ceil(known[subset]))
    if subset.isdigit() and int(subset) > 0:
        return min(int(subset), size)
    if 0 < float(subset) <= 1:
        return max(1, math.ceil(float(subset) * size))
    raise ValueError("max_features is all, auto, onethird, sqrt, log2, a count or a share")


def split_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Edges between all values of a feature that has at most ``bins``, else those of ``bin_edges``."""
    edges = bin_edges(df, features, bins)
    about = df.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    for f in features:
        if about[f] <= 1.2 * bins:
            held = sorted(float(r[0]) for r in df.select(f).where(F.col(f).isNotNull()).distinct().limit(2 * bins).collect())
            if len(held) <= bins:
                edges[f] = [(a + b) / 2 for a, b in zip(held, held[1:])]
    return edges


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # of mean 1


def bootstrap_copies(u: np.ndarray, member: int) -> np.ndarray:
    """How often rows of random numbers ``u`` stand in the sample of a member: 0, 1, 2, ..., once on average."""
    with np.errstate(over="ignore"):
        x = u.astype(np.int64).view(np.uint64) + np.uint64((member + 1) * 0x9E3779B97F4A7C15 & _MASK)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def grow_rows(x: np.ndarray, y: np.ndarray, copies: np.ndarray, bins: int, depth: int, rule: Growth, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """``(feature, bin, left, value, gains)`` of a tree over the binned rows ``x``: least squares, all nodes of a level at once.

    The right child stands behind the left one; a leaf has feature -1. ``gains`` are sums by feature.
    """
    size = x.shape[1]
    tried = max(1, round(rule.feature_share * size))
    centre = float(y @ copies / copies.sum())
    d, gains, levels = y - centre, np.zeros(size), []
    row, slot, open_nodes, after = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 1, 1
    while open_nodes:
        w, wd = copies[row], copies[row] * d[row]
        H, G, S = (np.bincount(slot, v, minlength=open_nodes) for v in (w, wd, wd * d[row]))
        feature, cut, left = np.full(open_nodes, -1, dtype=np.int16), np.zeros(open_nodes, dtype=np.int32), np.zeros(open_nodes, dtype=np.int32)
        worth = np.flatnonzero((H >= 2 * rule.min_child_weight) & (S - G * G / H > 1e-12 * S)) if len(levels) < depth else np.zeros(0, dtype=np.int64)
        place = np.full(open_nodes, -1)
        place[worth] = np.arange(len(worth))
        keep = np.flatnonzero(place[slot] >= 0)
        keep = keep[np.argsort(place[slot[keep]], kind="stable")]
        row, slot, w, wd = row[keep], slot[keep], w[keep], wd[keep]
        wave = max(1, LEVEL_CELLS // (size * bins))
        for a in range(0, len(worth), wave):
            some = worth[a:a + wave]
            i, j = np.searchsorted(place[slot], [a, a + len(some)])
            cell = (((place[slot[i:j]] - a)[:, None] * size + np.arange(size)) * bins + x[row[i:j]]).ravel()
            h, g = (np.cumsum(np.bincount(cell, np.repeat(v[i:j], size), minlength=len(some) * size * bins).reshape(-1, size, bins), axis=2) for v in (w, wd))
            H1, G1 = H[some, None, None], G[some, None, None]
            allowed = (h >= rule.min_child_weight) & (H1 - h >= rule.min_child_weight)
            if tried < size:
                allowed &= (rng.random((len(some), size)).argsort(axis=1).argsort(axis=1) < tried)[:, :, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(allowed, g * g / h + (G1 - g) ** 2 / (H1 - h), -np.inf).reshape(len(some), -1)
            best = gain.argmax(axis=1)  # of equal gains the first feature and bin
            top = gain[np.arange(len(some)), best] - G[some] ** 2 / H[some]
            good = (top > 1e-12 * S[some]) & (top >= rule.min_decrease * H[some])
            feature[some[good]], cut[some[good]] = best[good] // bins, best[good] % bins
            gains += np.bincount(best[good] // bins, top[good], minlength=size)
        parted = np.flatnonzero(feature >= 0)
        left[parted] = after + 2 * np.arange(len(parted))
        levels.append((feature, cut, left, G / H + centre))
        keep = feature[slot] >= 0
        row, slot = row[keep], slot[keep]
        slot = left[slot] - after + (x[row, feature[slot]] > cut[slot])
        open_nodes = 2 * len(parted)
        after += open_nodes
    return *(np.concatenate(c) for c in zip(*levels)), gains


@dataclass(frozen=True)
class MeanForest:
    """Trees of values as flat arrays, averaged; ``gains`` holds a row for each tree."""

    features: list[str]
    trees: list[FlatTree]
    gains: np.ndarray

    def importances(self) -> list[float]:
        whole = self.gains.sum(axis=1, keepdims=True)
        return [float(v) for v in (self.gains / np.where(whole > 0, whole, 1)).sum(axis=0)]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf(T.DoubleType())
        def mean(x: pd.Series) -> pd.Series:
            rows = np.array(list(x), dtype=float).reshape(len(x), -1)
            return pd.Series(sum((t.value[t.leaves(rows)] for t in held.value), np.zeros(len(rows))) / len(held.value))

        return df.withColumn(prediction, mean(F.array(*[F.col(f).cast("double") for f in self.features])))


def fit_mean_forest(train: DataFrame, features: Sequence[str], label: str, n_estimators: int, rule: Growth, min_fraction: float = 0.0,
                    bootstrap: bool = True, bins: int = 32) -> MeanForest:
    """Trees of least squares. Nodes of more than ``NODE_ROWS`` rows are split level by level from histograms of all partitions;
    the rows under a smaller node meet in one task, which grows the rest of its tree. The driver holds the finished trees.
    """
    features, size = list(features), len(features)
    edges = split_edges(train, features, bins)
    bins = max(len(edges[f]) for f in features) + 1
    rows = spread(with_bins(train.select(F.col(label).cast("double").alias("_y"), *features), features, edges)).select(
        F.array(*[F.col(f"_b_{f}").cast("int") for f in features]).alias("bins"), F.array(-F.col("_y")).alias("g"), F.array(F.lit(1.0)).alias("h"),
        F.xxhash64(F.lit(rule.seed), F.monotonically_increasing_id()).alias("u")).persist()
    n, parts = rows.count(), rows.rdd.getNumPartitions()
    rule = replace(rule, min_child_weight=max(rule.min_child_weight, 1.0, min_fraction * n))
    drawn = bootstrap_copies if bootstrap else lambda u, member: np.ones(len(u))

    tops = [Tree() for _ in range(n_estimators)]
    level, small = [(t, 1) for t in range(n_estimators)], []
    if n <= NODE_ROWS:
        level, small = [], level
    wave = max(1, LEVEL_CELLS // (size * bins))
    for _ in range(rule.max_depth):
        flat, below = [FlatTree.of(t, features, edges) for t in tops], []
        for first in range(0, len(level), wave):
            some = level[first:first + wave]
            for r in sorted(_level(rows, flat, some, size, bins, rule, [0] * n_estimators, parts, drawn), key=lambda r: r["slot"]):
                t, node = some[r["slot"]]
                tops[t].values[node] = -r["G"] / r["H"]
                if r["gain"] is None:
                    continue
                feature = features[int(r["f"])]
                tops[t].splits[node] = (feature, edges[feature][int(r["b"])])
                tops[t].gains[feature] = tops[t].gains.get(feature, 0.0) + r["gain"]
                del tops[t].values[node]
                for child, g, h in ((2 * node, r["lg"], r["lh"]), (2 * node + 1, r["G"] - r["lg"], r["H"] - r["lh"])):
                    tops[t].values[child] = -g / h
                    (small if h <= NODE_ROWS else below).append((t, child))
        level = sorted(below)
        if not level:
            break
    small.sort()
    flat = [FlatTree.of(t, features, edges) for t in tops]
    group_of = [np.full(len(f.names), -1) for f in flat]
    for group, (t, node) in enumerate(small):
        group_of[t][flat[t].names.index(node)] = group

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            x, y = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1), -batch.column("g").flatten().to_numpy()
            groups, packed = [], []
            for t in range(n_estimators):
                copies, group = drawn(batch.column("u").to_numpy(), t), group_of[t][flat[t].leaves(x)]
                keep = np.flatnonzero((copies > 0) & (group >= 0))
                keep = keep[np.argsort(group[keep], kind="stable")]
                own, begin = np.unique(group[keep], return_index=True)
                for name, i in zip(own, np.split(keep, begin[1:])):
                    groups.append(int(name))
                    packed.append(y[i].tobytes() + x[i].astype(np.int32).tobytes() + copies[i].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(np.full(len(groups), at)), pa.array(packed, pa.binary())], names=["group", "at", "rows"])
            at += 1

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        group, ys, xs, ws = int(pdf["group"].iloc[0]), [], [], []
        for raw in pdf.sort_values("at")["rows"]:
            k = len(raw) // (9 + 4 * size)
            ys.append(np.frombuffer(raw, np.float64, k))
            xs.append(np.frombuffer(raw, np.int32, k * size, 8 * k).reshape(k, size))
            ws.append(np.frombuffer(raw, np.uint8, k, (8 + 4 * size) * k))
        depth = rule.max_depth - (small[group][1].bit_length() - 1)
        grown = grow_rows(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws).astype(float), bins, depth, rule, np.random.default_rng([rule.seed, group]))
        return pd.DataFrame({"group": [group], **{c: [v.tobytes()] for c, v in zip(_GROWN, grown)}})

    found = {}
    if small:
        tasks = min(len(small), max(4 * rows.sparkSession.sparkContext.defaultParallelism, n * n_estimators // 1_000_000))
        dealt = rows.mapInArrow(deal, "group int, at bigint, rows binary").repartition(tasks, "group")
        grown = dealt.groupBy("group").applyInPandas(finish, "group int, " + ", ".join(f"{c} binary" for c in _GROWN))
        found = {r["group"]: [np.frombuffer(r[c], kind) for c, kind in _GROWN.items()] for r in grown.collect()}
    rows.unpersist()
    trees, gains = [], np.zeros((n_estimators, size))
    for t, top in enumerate(tops):
        gains[t] = [top.gains.get(f, 0.0) for f in features]
        whole = FlatTree.of(top, features)
        columns = [[c] for c in (whole.feature, whole.threshold, whole.left, whole.right, whole.value)]
        end = len(whole.names)
        for place, group in enumerate(group_of[t]):
            if group < 0 or group not in found:
                continue
            feature, cut, left, value, gain = found[group]
            gains[t] += gain
            inner = feature >= 0
            threshold = np.zeros(len(feature))
            threshold[inner] = [edges[features[f]][b] for f, b in zip(feature[inner], cut[inner])]
            left = np.where(inner, left + end - 1, 0)  # the first node takes the place of the top's leaf, the others follow
            under = (feature, threshold, left, np.where(inner, left + 1, 0), np.where(inner, 0.0, value))
            for column, part in zip(columns, under):
                column[0][place] = part[0]
                column.append(part[1:])
            end += len(feature) - 1
        trees.append(FlatTree(*(np.concatenate(c) for c in columns), []))
    return MeanForest(features, trees, gains)


_GROWN = {"feature": np.int16, "cut": np.int32, "left": np.int32, "value": np.float64, "gains": np.float64}

"""The naive Bayes family in closed form: one grouped aggregate each, scored as column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import total
from tablewright.session import fits_broadcast

ALPHA_FLOOR = 1e-10  # fixed value: least smoothing unless force_alpha


@dataclass(frozen=True)
class ScoreModel:
    """A score expression per class; the prediction is the class with the largest score."""

    classes: list[float]
    scores: list[Column]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        scores = F.array(*self.scores)
        # the first of equal scores wins
        at = F.array_position(scores, F.array_max(scores)).cast("int")
        return df.withColumn(prediction, F.element_at(F.array(*[F.lit(c) for c in self.classes]), at))

    def transform_scores(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"score_{c:g}": s for c, s in zip(self.classes, self.scores)})


def _alpha(alpha: float, force: bool) -> float:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return alpha if force else max(alpha, ALPHA_FLOOR)


def _priors(counts: Sequence[float], fit_prior: bool) -> list[float]:
    n = sum(counts)
    return [math.log(c / n) if fit_prior else -math.log(len(counts)) for c in counts]


def fit_gaussian(train: DataFrame, features: Sequence[str], label: str = "label", var_smoothing: float = 1e-9) -> ScoreModel:
    """Per-class mean and variance; ``var_smoothing`` times the largest feature variance is added."""
    largest = train.agg(F.greatest(*[F.var_pop(f) for f in features], F.lit(0.0)).alias("v")).first()["v"]
    rows = train.groupBy(label).agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)]).orderBy(label).collect()
    priors = _priors([r["n"] for r in rows], True)
    scores = []
    for r, prior in zip(rows, priors):
        terms = []
        for i, f in enumerate(features):
            v = r[f"v{i}"] + var_smoothing * largest
            d = F.col(f) - F.lit(r[f"m{i}"])
            terms.append(F.lit(-0.5 * math.log(2 * math.pi * v)) - d * d / F.lit(2 * v))
        scores.append(F.lit(prior) + total(terms))
    return ScoreModel([float(r[label]) for r in rows], scores)


def _class_sums(train: DataFrame, features: Sequence[str], label: str, expr=F.col) -> list:
    return train.groupBy(label).agg(
        F.count("*").alias("n"), *[F.sum(expr(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)]
    ).orderBy(label).collect()


def _require_non_negative(train: DataFrame, features: Sequence[str]) -> None:
    low = train.agg(F.least(*[F.min(f) for f in features], F.lit(0.0))).first()[0]
    if low is not None and low < 0:
        raise ValueError("negative feature values; use min-max scaling or no scaling with this model")


def fit_multinomial(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                    force_alpha: bool = True, fit_prior: bool = True) -> ScoreModel:
    _require_non_negative(train, features)
    a, rows = _alpha(alpha, force_alpha), _class_sums(train, features, label)
    scores = []
    for r, prior in zip(rows, _priors([r["n"] for r in rows], fit_prior)):
        sums = [r[f"s{i}"] + a for i in range(len(features))]
        norm = math.log(sum(sums))
        scores.append(F.lit(prior) + total([F.col(f) * F.lit(math.log(s) - norm) for f, s in zip(features, sums)]))
    return ScoreModel([float(r[label]) for r in rows], scores)


def fit_complement(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                   norm: bool = False, force_alpha: bool = True, fit_prior: bool = True) -> ScoreModel:
    """Weights from the rows outside each class (Rennie 2003); the prior matters only with a single class."""
    _require_non_negative(train, features)
    a, rows = _alpha(alpha, force_alpha), _class_sums(train, features, label)
    overall = [sum(r[f"s{i}"] for r in rows) for i in range(len(features))]
    scores = []
    for r, prior in zip(rows, _priors([r["n"] for r in rows], fit_prior)):
        rest = [overall[i] + a - r[f"s{i}"] for i in range(len(features))]
        logs = [math.log(c / sum(rest)) for c in rest]
        weights = [w / sum(logs) for w in logs] if norm else [-w for w in logs]
        base = F.lit(prior) if len(rows) == 1 else F.lit(0.0)
        scores.append(base + total([F.col(f) * F.lit(w) for f, w in zip(features, weights)]))
    return ScoreModel([float(r[label]) for r in rows], scores)


def fit_bernoulli(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                  binarize: float | None = 0.0, force_alpha: bool = True, fit_prior: bool = True) -> ScoreModel:
    a = _alpha(alpha, force_alpha)

    def bit(f: str) -> Column:
        return F.col(f) if binarize is None else (F.col(f) > binarize).cast("double")

    rows = _class_sums(train, features, label, bit)
    scores = []
    for r, prior in zip(rows, _priors([r["n"] for r in rows], fit_prior)):
        terms = []
        for i, f in enumerate(features):
            p = (r[f"s{i}"] + a) / (r["n"] + 2 * a)
            terms.append(bit(f) * F.lit(math.log(p) - math.log(1 - p)) + F.lit(math.log(1 - p)))
        scores.append(F.lit(prior) + total(terms))
    return ScoreModel([float(r[label]) for r in rows], scores)


@dataclass(frozen=True)
class CategoricalModel:
    """Log frequencies by feature and category as a table ``(f, k, logs)``, an array entry for each class."""

    features: list[str]
    classes: list[float]
    priors: list[float]
    table: DataFrame
    cells: int  # measured rows of the table
    widths: list[int]  # categories of each feature
    unseen: list[list[float]]  # log frequency of a category that no class shows, by feature and class

    def _summed(self, df: DataFrame) -> Column:
        whole = F.array(*[F.lit(v) for v in self.priors])
        for i, (f, width, rest) in enumerate(zip(self.features, self.widths, self.unseen)):
            code = F.col(f).cast("bigint")
            known = (code >= 0) & (code < width)
            error = F.raise_error(F.concat(F.lit(f"column {f} holds a code unseen in training: "), code.cast("string"))).cast("array<double>")
            logs = F.when(code.isNull() | known, F.coalesce(F.col(f"_logs{i}"), F.array(*[F.lit(v) for v in rest]))).otherwise(error)
            whole = F.zip_with(whole, logs, lambda x, y: x + y)
        return whole

    def _joined(self, df: DataFrame) -> DataFrame:
        for i, f in enumerate(self.features):
            side = self.table.filter(F.col("f") == i).select(F.col("k").alias(f"_k{i}"), F.col("logs").alias(f"_logs{i}"))
            side = F.broadcast(side) if fits_broadcast(self.cells, 2 + len(self.classes)) else side
            df = df.join(side, df[f].cast("bigint") == F.col(f"_k{i}"), "left")
        return df

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        scored = self._joined(df).withColumn("_scores", self._summed(df))
        at = F.array_position("_scores", F.array_max("_scores")).cast("int")
        return scored.select(*[c for c in df.columns if c != prediction], F.element_at(F.array(*[F.lit(c) for c in self.classes]), at).alias(prediction))

    def transform_scores(self, df: DataFrame) -> DataFrame:
        scored = self._joined(df).withColumn("_scores", self._summed(df))
        return scored.select(*df.columns, *[F.col("_scores")[i].alias(f"score_{c:g}") for i, c in enumerate(self.classes)])


def fit_categorical(train: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                    min_categories: int | None = None, force_alpha: bool = True, fit_prior: bool = True) -> CategoricalModel:
    """Smoothed category frequencies per class. Features are codes 0..; a code beyond training is an error.

    The frequencies stay a table that scoring joins; only class sizes and the number of categories reach the driver.
    """
    _require_non_negative(train, features)
    a = _alpha(alpha, force_alpha)
    sizes = {float(r[label]): r["count"] for r in train.groupBy(label).count().collect()}
    classes = sorted(sizes)
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("bigint").alias("k")) for i, f in enumerate(features)])
    # one row a category, with its count in every class: groups are combined before the shuffle
    hits = [F.count_if(F.col(label).cast("double") == c).cast("double") for c in classes]
    counts = train.select(label, F.inline(cells)).filter("k IS NOT NULL").groupBy("f", "k").agg(F.array(*hits).alias("n")).persist()
    seen = {r["f"]: (r["w"], r["cells"]) for r in counts.groupBy("f").agg((F.max("k") + 1).alias("w"), F.count("*").alias("cells")).collect()}
    widths = [max(seen.get(i, (1, 0))[0], min_categories or 0) for i in range(len(features))]

    def log_share(hit: float, c: float, i: int) -> float:
        top, bottom = hit + a, sizes[c] + a * widths[i]
        return math.log(top / bottom) if top > 0 else float("-inf")

    unseen = [[log_share(0.0, c, i) for c in classes] for i in range(len(features))]
    bottoms = F.element_at(F.array(*[F.array(*[F.lit(float(sizes[c] + a * w)) for c in classes]) for w in widths]), F.col("f") + 1)
    logs = F.zip_with("n", bottoms, lambda n, b: F.when(n + a > 0, F.log((n + a) / b)).otherwise(float("-inf")))
    return CategoricalModel(list(features), classes, _priors([sizes[c] for c in classes], fit_prior), counts.select("f", "k", logs.alias("logs")),
                            sum(n for _, n in seen.values()), widths, unseen)

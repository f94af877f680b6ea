"""K-fold scores on the training part."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import evaluation, ranking


def with_folds(train: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42, shuffle: bool = False) -> DataFrame:
    """Contiguous folds over the order the split left the rows in, or over a reshuffled order."""
    order = ranking.row_hash(seed + 1 if shuffle else seed, *keys)
    return ranking.assign_folds(train.withColumn(ranking.HASH, order), ranking.HASH, folds).drop(ranking.HASH)


def cross_validate(
    train: DataFrame, fit: Callable[[DataFrame], object], keys: Sequence[str], folds: int = 5, seed: int = 42,
    shuffle: bool = False, classification: bool = True, label: str = "label",
) -> DataFrame:
    """``(fold, n, score)``: accuracy of a classifier or R² of a regressor on each fold."""
    if not 3 <= folds <= 10:
        raise ValueError("use between 3 and 10 folds")
    marked = with_folds(train, keys, folds, seed, shuffle).persist()
    scores = None
    for fold in range(folds):
        model = fit(marked.filter(F.col("fold") != fold).drop("fold"))
        held_out = model.transform(marked.filter(F.col("fold") == fold).drop("fold"))
        metrics = evaluation.classification_metrics(held_out, label) if classification else evaluation.regression_metrics(held_out, label)
        score = metrics.select(F.lit(fold).alias("fold"), F.col("accuracy" if classification else "r2_score").alias("score"))
        scores = score if scores is None else scores.unionByName(score)
    return scores

"""Metrics of classifiers and regressors as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # fixed value: smallest relative step of a double


def confusion_counts(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Every (actual, predicted) pair over the union of both label sets, zeros included."""
    counts = confusion_counts(pred, y, yhat)
    # the labels are the distinct classes, already reduced by the grouping
    labels = counts.agg(F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("labels"))
    grid = labels.select(F.explode("labels").alias("actual"), "labels").select("actual", F.explode("labels").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_metrics(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; a zero division counts as 0."""
    cells = confusion_counts(pred, y, yhat)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("actual").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")))))
    per_class = sides.groupBy("c").agg(*[F.sum(x).cast("double").alias(x) for x in ("support", "guessed", "hit")])
    precision = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("guessed") > 0, 2 * F.col("hit") / (F.col("support") + F.col("guessed"))).otherwise(0.0)

    def weighted(x: Column) -> Column:
        return F.sum(x * F.col("support")) / F.sum("support")

    return per_class.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), weighted(precision).alias("precision"),
        weighted(recall).alias("recall"), weighted(f1).alias("f1_score"))


def class_distribution(pred: DataFrame, y: str = "label") -> DataFrame:
    return pred.groupBy(F.col(y).alias("class")).agg(F.count("*").alias("n"))


def regression_metrics(pred: DataFrame, y: str = "label", yhat: str = "prediction", p: int = 1) -> DataFrame:
    """All error measures and residual statistics in one aggregate. ``p`` is the number of predictors."""
    actual, error = F.col(y).cast("double"), F.col(y) - F.col(yhat)
    row = pred.agg(
        F.count("*").alias("n"), F.avg(actual).alias("mean_y"), F.var_pop(actual).alias("var_y"),
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(error) / F.greatest(F.abs(actual), F.lit(EPSILON))).alias("mape"),
        F.avg(error).alias("residual_mean"), F.stddev_pop(error).alias("residual_std"),
        F.min(error).alias("residual_min"), F.max(error).alias("residual_max"))
    r2 = F.when(F.col("var_y") > 0, 1 - F.col("mse") / F.col("var_y")).otherwise((F.col("mse") == 0).cast("double"))
    n = F.col("n")
    adjusted = F.when(n > p + 1, 1 - (1 - F.col("r2_score")) * (n - 1) / (n - p - 1)).otherwise(0.0)
    return row.withColumn("r2_score", r2).select(
        "r2_score", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("mean_y") != 0, F.sqrt("mse") / F.col("mean_y")).alias("rmse_mean"),
        "mae", "mape", adjusted.alias("adjusted_r2_score"),
        "residual_mean", "residual_std", "residual_min", "residual_max")


def interpret(metrics: DataFrame) -> DataFrame:
    """Quality bands for R², MAPE and RMSE relative to the mean."""
    # fixed values: the band limits
    def band(c: str) -> Column:
        x = F.col(c)
        return F.when(x <= 0.05, "Very Good").when(x <= 0.1, "Good").when(x <= 0.2, "Moderate").otherwise("Weak")

    r2 = F.when(F.col("r2_score") > 0.7, "Good fit").when(F.col("r2_score") > 0.4, "Moderate fit").otherwise("Poor fit")
    return metrics.select(
        r2.alias("r2_band"), F.when(F.col("mape") > 1, "N/A").otherwise(band("mape")).alias("mape_band"),
        band("rmse_mean").alias("rmse_mean_band"))

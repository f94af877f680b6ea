"""A full automatic profile of a table as a handful of small DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import categorical_columns, numeric_columns, unpivot_row, value_counts_long
from tablewright.operators.charts import correlation_matrix
from tablewright.operators.quality import describe_columns
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.rowid import ROW_ID

_NUMERIC = ["mean", "std", "min", "max", "skewness", "kurtosis", "zeros", "negatives"]
_QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


class Profile(NamedTuple):
    columns: DataFrame  # column, dtype, n_rows, n_unique, n_missing
    numbers: DataFrame  # column, mean … negatives, p5 … p95
    texts: DataFrame  # column, min_length, mean_length, max_length
    top_values: DataFrame  # column, rank, value, n
    correlations: DataFrame | None  # a, b, r
    duplicates: DataFrame  # n_rows, n_distinct_rows, n_surplus
    alerts: DataFrame  # column, alert


def number_profile(df: DataFrame) -> DataFrame:
    columns = numeric_columns(df, exclude=[ROW_ID])
    row = df.agg(*[e for c in columns for e in (
        F.avg(c).alias(f"mean__{c}"), F.stddev_samp(c).alias(f"std__{c}"),
        F.min(c).cast("double").alias(f"min__{c}"), F.max(c).cast("double").alias(f"max__{c}"),
        F.skewness(c).alias(f"skewness__{c}"), F.kurtosis(c).alias(f"kurtosis__{c}"),
        F.count_if(F.col(c) == 0).alias(f"zeros__{c}"), F.count_if(F.col(c) < 0).alias(f"negatives__{c}"))])
    marks = exact_quantiles(df, columns, list(_QUANTILES.values()))
    lines = [F.struct(F.lit(c).alias("column"), *[
        F.col(f"{c}_q{i}").cast("double").alias(name) for i, name in enumerate(_QUANTILES)]) for c in columns]
    return unpivot_row(row, columns, _NUMERIC).join(marks.select(F.inline(F.array(*lines))), "column")


def text_profile(df: DataFrame) -> DataFrame:
    columns = categorical_columns(df)
    row = df.agg(*[e for c in columns for e in (
        F.min(F.length(c)).alias(f"min_length__{c}"), F.avg(F.length(c)).alias(f"mean_length__{c}"),
        F.max(F.length(c)).alias(f"max_length__{c}"))])
    return unpivot_row(row, columns, ["min_length", "mean_length", "max_length"])


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; a rank filter Spark applies before the shuffle."""
    counts = value_counts_long(df, [c for c in df.columns if c != ROW_ID]).filter("value IS NOT NULL")
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("column", "rank", "value", "n")


def duplicate_summary(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*[c for c in df.columns if c != ROW_ID]).agg(F.count("*").alias("_size"))
    return groups.agg(F.sum("_size").alias("n_rows"), F.count("*").alias("n_distinct_rows"),
                      (F.sum("_size") - F.count("*")).alias("n_surplus"))


def alerts(df: DataFrame, distinct_share: float = 0.9, missing_share: float = 0.05, zero_share: float = 0.5) -> DataFrame:
    """Constant, almost unique, often missing and often zero columns."""
    numbers = numeric_columns(df, exclude=[ROW_ID])
    zeros = unpivot_row(df.agg(*[F.count_if(F.col(c) == 0).alias(f"zeros__{c}") for c in numbers]), numbers, ["zeros"])
    facts = describe_columns(df).withColumnRenamed("variable", "column").join(zeros, "column", "left")
    rows = F.col("n_rows")
    raised = F.array_compact(F.array(
        F.when(F.col("n_unique") == 1, F.lit("constant")),
        F.when(F.col("n_unique") > rows * distinct_share, F.lit("almost unique")),
        F.when(F.col("n_missing") > rows * missing_share, F.lit("missing")),
        F.when(F.col("zeros") > rows * zero_share, F.lit("zeros"))))
    return facts.select("column", F.explode(raised).alias("alert"))


def profile(df: DataFrame) -> Profile:
    numbers = numeric_columns(df, exclude=[ROW_ID])
    return Profile(
        describe_columns(df), number_profile(df), text_profile(df), top_values(df),
        correlation_matrix(df, numbers) if len(numbers) >= 2 else None, duplicate_summary(df), alerts(df))



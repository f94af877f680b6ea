"""Browsing, summaries and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    any_missing, categorical_columns, is_categorical, numeric_columns, unpivot_row, value_counts_long,
)
from tablewright.operators.groups import join_groups
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.rowid import PAGE_SIZE, ROW_ID

# fixed values: warning and chart thresholds
CARDINALITY_LIMIT = 1000
WRONG_TASK_PERCENT = 50.0
BAR_CATEGORY_LIMIT = 30
BOX_CATEGORY_LIMIT = 29


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(_columns(df))).cast("bigint").alias("n_columns"))


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, percentiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Count, unique/top/freq for text, mean/std/min/percentiles/max for numbers: one line per column."""
    chosen = list(columns or _columns(df))
    numbers = [c for c in chosen if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = [c for c in chosen if is_categorical(df.schema[c].dataType)]
    labels = [f"p{round(p * 100)}" for p in percentiles]
    parts = []
    if numbers:
        basics = df.agg(*[e for c in numbers for e in (
            F.count(c).alias(f"count__{c}"), F.avg(c).alias(f"mean__{c}"), F.stddev_samp(c).alias(f"std__{c}"),
            F.min(c).cast("double").alias(f"min__{c}"), F.max(c).cast("double").alias(f"max__{c}"))])
        table = unpivot_row(basics, numbers, ["count", "mean", "std", "min", "max"])
        marks = exact_quantiles(df, numbers, list(percentiles))
        lines = [F.struct(F.lit(c).alias("column"), *[
            F.col(f"{c}_q{i}").cast("double").alias(p) for i, p in enumerate(labels)]) for c in numbers]
        quartiles = marks.select(F.inline(F.array(*lines)))
        parts.append(table.join(quartiles, "column").select(
            "column", "count", F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("bigint").alias("freq"), "mean", "std", "min", *labels, "max"))
    if texts:
        counts = value_counts_long(df, texts)
        present = F.col("value").isNotNull()
        missing = F.lit(None).cast("double")
        # most frequent value; the smaller text wins a tie
        best = F.min(F.when(present, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("top"))))
        parts.append(
            counts.groupBy("column").agg(
                F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
                F.count_if(present).alias("unique"), best.alias("best"))
            .select("column", "count", "unique", F.col("best.top").alias("top"), (-F.col("best.neg")).alias("freq"),
                    missing.alias("mean"), missing.alias("std"), missing.alias("min"),
                    *[missing.alias(p) for p in labels], missing.alias("max")))
    if not parts:
        raise ValueError("no numeric or text column to describe")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def describe_columns(df: DataFrame) -> DataFrame:
    """Variable, type, rows, unique values (missing counts as one) and missing values."""
    columns = _columns(df)
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields if f.name in columns for x in (f.name, f.dataType.simpleString())])
    return (
        value_counts_long(df, columns).groupBy("column")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"),
             F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))
        .select(F.col("column").alias("variable"), F.element_at(kinds, F.col("column")).alias("dtype"),
                "n_rows", "n_unique", "n_missing")
    )


def missing_percent(df: DataFrame) -> DataFrame:
    columns = _columns(df)
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"percent_missing__{c}") for c in columns])
    return unpivot_row(row, columns, ["percent_missing"])


def rows_with_missing(df: DataFrame) -> DataFrame:
    return df.filter(any_missing(_columns(df)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of every group of equal rows."""
    columns = _columns(df)
    groups = df.groupBy(*columns).agg(F.count("*").alias("_size")).filter("_size > 1")
    return join_groups(df, groups, columns, "_size", df.count()).select(*df.columns)


def unique_values(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Distinct values, missing included, with the row each is first seen in."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("first_row")).orderBy("first_row")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, missing excluded."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"n_distinct__{c}") for c in columns])
        return unpivot_row(row, columns, ["n_distinct"])
    cells = value_counts_long(df, columns)
    return cells.groupBy("column").agg(F.count_if(F.col("value").isNotNull()).alias("n_distinct"))


def value_counts(df: DataFrame, column: str, page: int | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """Counts per value, missing included, most frequent first; ``page`` picks ten at a time."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return ordered if page is None else ordered.offset((page - 1) * size).limit(size)


def quality_report(df: DataFrame) -> DataFrame:
    """``(check, column, ok, detail)``: missing values per column, then emptiness."""
    columns = _columns(df)
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m__{c}") for c in columns])
    lines = [
        F.struct(F.lit("missing").alias("check"), F.lit(c).alias("column"), (F.col(f"m__{c}") == 0).alias("ok"),
                 F.when(F.col(f"m__{c}") > 0, F.concat(F.lit("Missing values: "), F.col(f"m__{c}").cast("string"))).alias("detail"))
        for c in columns
    ]
    lines.append(F.struct(
        F.lit("empty").alias("check"), F.lit(None).cast("string").alias("column"), (F.col("_n") > 0).alias("ok"),
        F.when(F.col("_n") == 0, F.lit("the table is empty")).alias("detail")))
    return row.select(F.inline(F.array(*lines)))


class DataQualityError(ValueError):
    pass


def require_quality(df: DataFrame) -> None:
    """Raise with every offending column named; missing values are reported before emptiness."""
    failed = [r for r in quality_report(df).collect() if not r["ok"]]
    missing = [r["column"] for r in failed if r["check"] == "missing"]
    if missing:
        raise DataQualityError(f"Missing values in columns: {', '.join(missing)}")
    if failed:
        raise DataQualityError("the table is empty")


def cardinality_warnings(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: int = CARDINALITY_LIMIT, approximate: bool = False
) -> DataFrame:
    """Columns with more than ``threshold`` distinct values."""
    chosen = list(columns) if columns is not None else categorical_columns(df)
    return distinct_counts(df, chosen, approximate).filter(F.col("n_distinct") > threshold).select(
        "column", "n_distinct", F.lit(threshold).cast("bigint").alias("threshold"))


def wrong_task_check(df: DataFrame, target: str) -> DataFrame:
    """Does a classification target look continuous: distinct values over half of the rows?"""
    counted = df.agg(F.count_distinct(target).alias("n_distinct"), F.count("*").alias("n_rows"))
    percent = F.round(F.col("n_distinct") / F.col("n_rows") * 100, 2)
    return counted.select("n_distinct", "n_rows", percent.alias("percent"), (percent > WRONG_TASK_PERCENT).alias("suspicious"))


def column_kinds(df: DataFrame) -> DataFrame:
    """``(column, kind, n_distinct, bar_axis, box_axis)``: which columns may serve as categories."""
    columns = _columns(df)
    labels = {c: "categorical" if c in categorical_columns(df) else
              "numeric" if c in numeric_columns(df) else "other" for c in columns}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("column"))
    return distinct_counts(df, columns).select(
        "column", kind.alias("kind"), "n_distinct",
        ((kind == "categorical") | (F.col("n_distinct") <= BAR_CATEGORY_LIMIT)).alias("bar_axis"),
        ((kind == "categorical") | (F.col("n_distinct") <= BOX_CATEGORY_LIMIT)).alias("box_axis"))



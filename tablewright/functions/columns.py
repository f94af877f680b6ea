"""Column classification and small expression helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a decimal number as text; casts alone would also take Java's suffixes, as in 5d or 7f
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def is_categorical(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return sorted(f.name for f in df.schema.fields if is_categorical(f.dataType) and f.name not in exclude)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def any_missing(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns], F.lit(False))


def total(terms: Sequence[Column]) -> Column:
    return reduce(add, terms, F.lit(0.0))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value as text)`` for every cell. Zero has one text, whatever its sign."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        col = F.col(c) + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)
        return col.cast("string")

    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])
    return df.select(F.inline(cells))


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: counts are combined before the shuffle, so no value is hot."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def unpivot_row(row: DataFrame, columns: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One wide aggregate row named ``<metric>__<column>`` into one line per column."""
    lines = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}__{c}").alias(m) for m in metrics]) for c in columns
    ]
    return row.select(F.inline(F.array(*lines)))


def vector_columns(df: DataFrame, column: str, size: int, prefix: str = "f") -> DataFrame:
    """An array column spread into ``size`` double columns ``f0 … f<size-1>``."""
    spread = {f"{prefix}{i}": F.col(column)[i].cast("double") for i in range(size)}
    return df.withColumns(spread).drop(column)

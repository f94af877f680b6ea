"""Scoring new rows, for models that can predict and for clusterings that cannot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import is_categorical, value_counts_long
from tablewright.operators import prepare
from tablewright.operators.rowid import ROW_ID

SMALL_DOMAIN = 20  # fixed value: a numeric column with at most this many values is a choice


def fit_for_scoring(df: DataFrame, target: str, fit: Callable[[DataFrame, list[str]], object], keys: Sequence[str] = (ROW_ID,),
                    **options) -> Callable[[DataFrame], DataFrame]:
    """Train on all rows and return a function that encodes, scales and predicts any new table or stream."""
    ready = prepare.prepare_supervised(df, target, keys, test_size=None, **options)
    model = fit(ready.train, ready.features)
    return lambda new_rows: model.transform(ready.apply(new_rows))


def refit_with(df: DataFrame, new_rows: DataFrame, fit: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """Labels of new rows from clusterings without a predict step: cluster old and new rows together."""
    both = df.unionByName(new_rows.select(*df.columns))
    return fit(both).join(new_rows.select(id_col), id_col, "left_semi")


def input_constraints(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``(column, kind, values)``: the values offered for a column, or NULL where any number is allowed."""
    columns = [c for c in df.columns if c not in exclude and c != ROW_ID]
    fixed = [c for c in columns if is_categorical(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)]
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    counts = value_counts_long(df, [*fixed, *numeric]).filter("value IS NOT NULL")
    sizes = counts.groupBy("column").agg(F.count("*").alias("n_values"))
    kinds = F.create_map(*[F.lit(x) for c in [*fixed, *numeric] for x in (c, "category" if c in fixed else "number")])
    kind = F.element_at(kinds, F.col("column"))
    choice = (kind == "category") | (F.col("n_values") <= SMALL_DOMAIN)
    # a choice is a row per value, so no list grows with the table
    offered = sizes.select("column", kind.alias("kind"), choice.alias("choice"), "n_values")
    values = counts.select("column", "value")
    limited = offered.filter("choice").join(values, "column")
    free = offered.filter("NOT choice").withColumn("value", F.lit(None).cast("string"))
    return limited.select("column", "kind", "n_values", "value").unionByName(free.select("column", "kind", "n_values", "value"))


def violations(new_rows: DataFrame, constraints: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for values of new rows outside the offered choices."""
    given = value_counts_long(new_rows, columns)
    limited = constraints.filter("value IS NOT NULL").select("column").distinct()
    allowed = constraints.filter("value IS NOT NULL").select("column", "value")
    return given.join(F.broadcast(limited), "column", "left_semi").join(allowed, ["column", "value"], "left_anti")

"""Column and row edits. Each takes a DataFrame and returns a new one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import NUMBER
from tablewright.operators.rowid import ROW_ID, reset_row_id

# fixed values: the selectable column types
DTYPES = {
    "object": T.StringType(),
    "string": T.StringType(),
    "category": T.StringType(),
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "datetime64[ns]": T.TimestampNTZType(),
    "timedelta64[ns]": T.DayTimeIntervalType(),
    "bool": T.BooleanType(),
}


def _data_columns(df: DataFrame, row_id: str = ROW_ID) -> list[str]:
    return [c for c in df.columns if c != row_id]


def drop_column(df: DataFrame, column: str) -> DataFrame:
    if column in df.columns and len(_data_columns(df)) == 1:
        raise ValueError("the last column cannot be dropped")
    return df.drop(column)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    new = new.strip()
    return df.withColumnRenamed(old, new) if new else df


def drop_rows(df: DataFrame, ids: int | Iterable[int] | DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Drop rows by id; ids that do not exist change nothing. Gaps stay until a reset."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(row_id), row_id, "left_anti")
    wanted = [ids] if isinstance(ids, int) else list(ids)
    return df.filter(~F.col(row_id).isin(wanted))


def parse_cell(text: str | float | None) -> float | str | None:
    """Typed cell input: a number if it reads as one, missing if blank or "nan", else text."""
    if text is None:
        return None
    if isinstance(text, (int, float)):
        return None if text != text else float(text)
    if text.strip().lower() in ("", "nan"):
        return None
    try:
        return float(text)
    except ValueError:
        return text


def update_cell(df: DataFrame, target: int, column: str, value: str | float | None, row_id: str = ROW_ID) -> DataFrame:
    """Set one cell. Text put into a numeric column turns the column into text."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    parsed = parse_cell(value)
    current = F.col(column)
    if isinstance(parsed, str) or isinstance(df.schema[column].dataType, T.StringType):
        new, current = F.lit(None if parsed is None else str(parsed)).cast("string"), current.cast("string")
    elif parsed is None:
        new = F.lit(None).cast(df.schema[column].dataType)
    elif float(parsed).is_integer() and isinstance(df.schema[column].dataType, T.IntegralType):
        new = F.lit(int(parsed)).cast(df.schema[column].dataType)
    else:
        new, current = F.lit(float(parsed)), current.cast("double")
    return df.withColumn(column, F.when(F.col(row_id) == target, new).otherwise(current))


def apply_cell_edits(df: DataFrame, edits: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Many edits of one column at once: ``edits`` holds ``(row_id, value)``, value may be NULL.

    A cell that is named more than once takes the value of its largest ``order``, if ``edits`` has such a column; values that differ
    without an order between them end the job with an error.
    """
    order = F.col("order") if "order" in edits.columns else F.lit(0)
    last = edits.groupBy(row_id, order.alias("_o")).agg(
        F.max("value").alias("_value"), (F.coalesce(F.min("value") != F.max("value"), F.lit(False)) | ((F.count("value") > 0) & (F.count("value") < F.count("*")))).alias("_torn"))
    newest = last.groupBy(row_id).agg(F.max_by(F.struct("_value", "_torn"), "_o").alias("_e"))
    torn = F.raise_error(F.lit("edits give a cell two values")).cast(edits.schema["value"].dataType)
    patch = newest.select(F.col(row_id), F.when(F.col("_e._torn"), torn).otherwise(F.col("_e._value")).alias("_value"), F.lit(True).alias("_hit"))
    joined = df.join(patch, row_id, "left")
    merged = F.when(F.col("_hit"), F.col("_value").cast(df.schema[column].dataType)).otherwise(F.col(column))
    return joined.withColumn(column, merged).select(*df.columns)


def replace_values(df: DataFrame, column: str, mapping: Mapping[Any, Any]) -> DataFrame:
    """Exact replacement of whole cells; "nan" or None on either side means missing."""
    source = F.col(column)
    kind = df.schema[column].dataType
    result = source
    for old, new in mapping.items():
        old_lit = F.lit(_missing(old)).cast(kind)
        result = F.when(source.eqNullSafe(old_lit), F.lit(_missing(new)).cast(kind)).otherwise(result)
    return df.withColumn(column, result)


def _missing(value: Any) -> Any:
    if isinstance(value, str) and value.lower() == "nan":
        return None
    return None if isinstance(value, float) and value != value else value


_GROUP = re.compile(r"\(\?P<(\w+)>|\(\?P=(\w+)\)|\\.", re.DOTALL)
_REFERENCE = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|([$\\])", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\x0b", "a": "\a"}  # fixed values


def _group_name(name: str) -> str:
    """Java group names hold letters and digits only."""
    return "n" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}" for c in name)


def to_java_pattern(pattern: str) -> str:
    """Named groups and references to them in Java's spelling."""

    def spell(m: re.Match) -> str:
        if m.group(1):
            return f"(?<{_group_name(m.group(1))}>"
        return f"\\k<{_group_name(m.group(2))}>" if m.group(2) else m.group()

    return _GROUP.sub(spell, pattern)


def to_java_replacement(replacement: str) -> str:
    r"""``\1``, ``\g<1>`` and ``\g<name>`` become group references; other escapes and dollars stand for themselves."""
    out, upto = [], 0
    for m in _REFERENCE.finditer(replacement):
        out.append(replacement[upto:m.start()])
        upto = m.end()
        name, number, escaped, mark = m.groups()
        group = number or (name if name and name.isdigit() else None)
        if group is not None:
            out.append(f"${int(group)}")
            if replacement[upto:upto + 1].isdigit():  # a digit that follows is text, not part of the number
                out.append("\\")
        elif name:
            out.append(f"${{{_group_name(name)}}}")
        elif escaped is not None:
            text = _ESCAPES.get(escaped, escaped if not escaped.isalpha() else None)
            if text is None:
                raise ValueError(f"bad escape \\{escaped} in replacement")
            out.append(f"\\{text}" if text in "$\\" else text)
        else:
            out.append(f"\\{mark}")
    return "".join([*out, replacement[upto:]])


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str, null_as: str | None = None) -> DataFrame:
    """Regex replacement inside the text form of a column; missing stays missing unless ``null_as`` is given."""
    text = F.col(column).cast("string")
    if null_as is not None:
        text = F.coalesce(text, F.lit(null_as))
    return df.withColumn(column, F.regexp_replace(text, to_java_pattern(pattern), to_java_replacement(replacement)))


def cast_column(df: DataFrame, column: str, dtype: str) -> Column:
    if dtype not in DTYPES:
        raise ValueError(f"unknown type {dtype}; choose one of {sorted(DTYPES)}")
    source, kind, target = F.col(column), df.schema[column].dataType, DTYPES[dtype]
    if isinstance(target, T.LongType) and isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        lossy = source.isNotNull() & (source != F.floor(source))
        return F.when(lossy, F.raise_error(F.lit(f"column {column} holds fractions"))).otherwise(source.cast("bigint"))
    if isinstance(target, T.BooleanType):
        return F.length(source) > 0 if isinstance(kind, T.StringType) else source.cast("double") != 0
    if isinstance(kind, T.IntegralType) and isinstance(target, T.TimestampNTZType):
        return F.timestamp_micros(F.floor(source / 1000).cast("bigint")).cast(target)
    if isinstance(kind, T.IntegralType) and isinstance(target, T.DayTimeIntervalType):
        return F.make_dt_interval(secs=(source / F.lit(1e9)).cast("decimal(18,6)"))
    if isinstance(target, T.DoubleType) and isinstance(kind, T.StringType):
        wrong = source.isNotNull() & ~F.rlike(source, F.lit(NUMBER))
        return F.when(wrong, F.raise_error(F.lit(f"column {column} holds texts that are no numbers")).cast("double")).otherwise(source.cast(target))
    return source.cast(target)


def convert_dtype(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Convert or fail: a value that does not fit raises when the result is computed."""
    return df.withColumn(column, cast_column(df, column, dtype))


def conversion_failures(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """How many values a text column would lose on conversion: ``(column, dtype, failures)``."""
    source = F.col(column)
    if dtype == "Int64" and isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        bad = source.isNotNull() & (source != F.floor(source))
    else:
        bad = source.isNotNull() & source.try_cast(DTYPES[dtype]).isNull()
        if dtype == "Float64" and isinstance(df.schema[column].dataType, T.StringType):
            bad = bad | (source.isNotNull() & ~F.rlike(source, F.lit(NUMBER)))
    return df.agg(
        F.lit(column).alias("column"), F.lit(dtype).alias("dtype"), F.count_if(bad).alias("failures")
    )


def drop_duplicates(df: DataFrame, row_id: str = ROW_ID, reset: bool = True) -> DataFrame:
    """Keep the first row of each group of equal rows.

    Grouping by every data column and keeping the least id is combined before the
    shuffle, so a row copied a billion times costs one record per task.
    """
    columns = _data_columns(df, row_id)
    kept = df.groupBy(*columns).agg(F.min(row_id).alias(row_id)).select(*df.columns)
    return reset_row_id(kept, row_id) if reset else kept


def drop_missing_rows(df: DataFrame, row_id: str = ROW_ID, reset: bool = True) -> DataFrame:
    kept = df.na.drop("any")
    return reset_row_id(kept, row_id) if reset else kept


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become the column mean: one aggregate row reaches the driver."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")) for c in columns}
    return df.withColumns(filled)


def apply_sql(df: DataFrame, statement: str) -> DataFrame:
    """A custom operation in SQL over ``{df}``, for example ``SELECT * FROM {df} WHERE x > 0``."""
    return df.sparkSession.sql(statement, df=df)


def apply_function(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    result = fn(df)
    if not isinstance(result, DataFrame):
        raise TypeError("a custom operation must return a DataFrame")
    return result


def to_number(column: str | Column) -> Column:
    """The value as a double, or NULL where it is not a number. Texts such as ``5d`` and ``7f`` are none."""
    source = F.col(column) if isinstance(column, str) else column
    number = F.when(F.rlike(source.cast("string"), F.lit(NUMBER)), source.try_cast("double"))
    return F.when(F.isnan(number), F.lit(None).cast("double")).otherwise(number)


def is_number(column: str | Column) -> Column:
    return to_number(column).isNotNull()

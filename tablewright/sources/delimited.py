"""Reading headered CSV with missing-value tokens, and exporting it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import NUMBER
from tablewright.operators.rowid import ROW_ID

# fixed values: texts read as missing
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value past this point."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def infer_types(texts: DataFrame) -> T.StructType:
    """Narrowest type per column (bigint, double, boolean, else string) in one aggregate."""
    checks = []
    for c in texts.columns:
        col = F.col(f"`{c}`")
        checks.append(F.bool_and(col.isNull() | col.try_cast("bigint").isNotNull()).alias(f"l:{c}"))
        checks.append(F.bool_and(col.isNull() | (F.rlike(col, F.lit(NUMBER)) & col.try_cast("double").isNotNull())).alias(f"d:{c}"))
        checks.append(F.bool_and(col.isNull() | col.isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"b:{c}"))
        checks.append(F.count(col).alias(f"n:{c}"))
    seen = texts.agg(*checks).first().asDict()
    fields = []
    for c in texts.columns:
        if not seen[f"n:{c}"]:
            kind: T.DataType = T.DoubleType()
        elif seen[f"b:{c}"]:
            kind = T.BooleanType()
        elif seen[f"l:{c}"]:
            kind = T.LongType()
        elif seen[f"d:{c}"]:
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """A headered CSV file or folder. A given ``schema`` saves the inference pass.

    Files split across tasks unless ``multi_line`` (quoted line breaks) is asked for.
    Undecodable bytes are dropped.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, escape='"', nullValue="", mode="PERMISSIVE"
    )
    texts = raw.select(*[
        F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.translate(F.col(f"`{c}`"), "�", "")).alias(c)
        for c in raw.columns
    ])
    target = schema or infer_types(texts)
    return nan_to_null(texts.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.fields]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def export_name(stem: str, when: datetime | None = None) -> str:
    return f"{stem}-{(when or datetime.now()).strftime('%Y-%m-%d-%H-%M-%S')}.csv"


def export_csv(df: DataFrame, folder: str, stem: str, row_id: str = ROW_ID, when: datetime | None = None) -> str:
    """Write a CSV folder with the row id as first column; returns its path."""
    rest: Sequence[str] = [c for c in df.columns if c != row_id]
    path = f"{folder.rstrip('/')}/{export_name(stem, when)}"
    df.select(row_id, *rest).write.option("header", True).option("escape", '"').csv(path)
    return path

"""Category encoders fitted on the training part, kept as mapping tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import long_form
from tablewright.operators.quality import CARDINALITY_LIMIT
from tablewright.operators.rowid import add_row_id
from tablewright.session import fits_broadcast

UNSEEN_CODE = -1.0
WINDOW_LIMIT = 1_000_000  # distinct values one window task may number
MAPPING_SCHEMA = "column string, value string, code bigint"


class EncodingError(ValueError):
    """``unseen`` and ``expected`` name the first values; ``total`` counts all unseen ones, ``values`` and ``known`` list all of them."""

    def __init__(self, column: str, unseen: list[str], expected: list[str], total: int | None = None, values: DataFrame | None = None,
                 known: DataFrame | None = None):
        self.column, self.unseen, self.expected = column, sorted(unseen), expected
        self.total, self.values, self.known = len(unseen) if total is None else total, values, known
        more = f" and {self.total - len(unseen)} more" if self.total > len(unseen) else ""
        super().__init__(f"column {column} holds values unseen in training: {self.unseen}{more}")


@dataclass(frozen=True)
class Mapping:
    """``(column, value, code)`` with the measured number of values per column, and their length in bytes."""

    table: DataFrame
    cardinality: dict[str, int]
    bytes: dict[str, int] = field(default_factory=dict)

    def of(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column).select("value", "code")

    def hinted(self, column: str) -> DataFrame:
        part = self.of(column)
        return F.broadcast(part) if fits_broadcast(self.cardinality.get(column, 0), 2, text_bytes=self.bytes.get(column, 0)) else part


def _measured(values: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Number and bytes of the values of each column."""
    rows = values.groupBy("column").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("b")).collect()
    return {r["column"]: r["n"] for r in rows}, {r["column"]: r["b"] for r in rows}


def fit_codes(train: DataFrame, columns: Sequence[str]) -> Mapping:
    """Codes 0.. over each column's sorted distinct values, all columns in one pass."""
    spark = train.sparkSession
    if not columns:
        return Mapping(spark.createDataFrame([], MAPPING_SCHEMA), {})
    values = long_form(train, columns).filter("value IS NOT NULL").distinct().persist()
    sizes, lengths = _measured(values)
    if max(sizes.values(), default=0) <= WINDOW_LIMIT:
        order = Window.partitionBy("column").orderBy("value")
        coded = values.withColumn("code", (F.row_number().over(order) - 1).cast("bigint"))
    else:
        numbered = add_row_id(values, ["column", "value"], "_n")
        first = numbered.groupBy("column").agg(F.min("_n").alias("_first"))
        coded = numbered.join(F.broadcast(first), "column").withColumn("code", F.col("_n") - F.col("_first"))
    return Mapping(coded.select("column", "value", "code").persist(), sizes, lengths)


def unseen_values(df: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` pairs that training never saw."""
    present = long_form(df, columns).filter("value IS NOT NULL").distinct()
    known = mapping.table.select("column", "value")
    if fits_broadcast(sum(mapping.cardinality.values()), 2, text_bytes=sum(mapping.bytes.values())):
        known = F.broadcast(known)
    return present.join(known, ["column", "value"], "left_anti")


def require_seen(df: DataFrame, mapping: Mapping, columns: Sequence[str], report: int = 1000) -> None:
    """Raise for the first column with unseen values. The message names ``report`` of them; the error carries all as DataFrames."""
    unseen = unseen_values(df, mapping, columns)
    found = unseen.orderBy("column", "value").limit(report).collect()
    if found:
        column = found[0]["column"]
        values, known = unseen.filter(F.col("column") == column).select("value"), mapping.of(column)
        named = [r["value"] for r in found if r["column"] == column]
        total = values.count() if len(found) == report else len(named)
        raise EncodingError(column, named, [r["value"] for r in known.orderBy("code").limit(report).collect()], total, values, known)


def encode_codes(df: DataFrame, mapping: Mapping, columns: Sequence[str], handle_unseen: str = "error") -> DataFrame:
    """Replace each column by its code. ``keep`` turns unseen values into -1."""
    if handle_unseen not in ("error", "keep"):
        raise ValueError("handle_unseen is 'error' or 'keep'")
    strict = handle_unseen == "error"
    if strict and columns and not df.isStreaming:
        require_seen(df, mapping, columns)
    order = df.columns
    for c in columns:
        codes = mapping.hinted(c).select(F.col("value").alias("_value"), F.col("code").cast("double").alias("_code"))
        df = df.join(codes, df[c].cast("string") == F.col("_value"), "left")
        code = F.coalesce("_code", F.lit(UNSEEN_CODE))
        if strict and df.isStreaming:
            # a stream cannot be checked beforehand, so the offending row itself fails
            message = F.concat(F.lit(f"column {c} holds a value unseen in training: "), F.col(c).cast("string"))
            code = F.when(F.col("_code").isNull() & F.col(c).isNotNull(), F.raise_error(message).cast("double")).otherwise(code)
        df = df.withColumn(c, code).drop("_value", "_code")
    return df.select(*order)


def fit_target_means(train: DataFrame, columns: Sequence[str], label: str, class_value: float | None = None) -> DataFrame:
    """``(column, value, encoded)``: category means shrunk towards the overall mean.

    The weight of a category is n·τ² / (n·τ² + σ²) with τ² the variance of the label and
    σ² its variance inside the category (Micci-Barreca 2001). ``class_value`` encodes
    the frequency of one class instead.
    """
    y = F.col(label).cast("double") if class_value is None else (F.col(label) == class_value).cast("double")
    mean, spread = train.agg(F.avg(y), F.var_pop(y)).first()
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    grouped = (
        train.select(y.alias("_y"), F.inline(cells)).filter("value IS NOT NULL").groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    )
    pull = F.lit(spread) * F.col("n")
    weight = F.when(pull + F.col("v") > 0, pull / (pull + F.col("v"))).otherwise(0.0)
    return grouped.select("column", "value", (weight * F.col("m") + (1 - weight) * F.lit(mean)).alias("encoded"))


@dataclass(frozen=True)
class TargetMeans:
    tables: dict[str, DataFrame]  # suffix -> (column, value, encoded)
    defaults: dict[str, float]
    cardinality: dict[str, int]
    bytes: dict[str, int] = field(default_factory=dict)


def fit_target_encoder(train: DataFrame, columns: Sequence[str], label: str, classes: Sequence[float] = ()) -> TargetMeans:
    """One encoding, or one per class when the label has three or more."""
    sizes, lengths = _measured(long_form(train, columns).distinct())
    targets = {f"_{int(c)}": c for c in classes} if len(classes) > 2 else {"": None}
    tables, defaults = {}, {}
    for suffix, value in targets.items():
        y = F.col(label).cast("double") if value is None else (F.col(label) == value).cast("double")
        defaults[suffix] = train.agg(F.avg(y)).first()[0]
        tables[suffix] = fit_target_means(train, columns, label, value).persist()
    return TargetMeans(tables, defaults, sizes, lengths)


def encode_target(df: DataFrame, means: TargetMeans, columns: Sequence[str]) -> DataFrame:
    """Unseen categories take the overall mean."""
    kept = [c for c in df.columns if c not in columns]
    added = []
    for c in columns:
        for suffix, table in means.tables.items():
            side = table.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("encoded").alias("_enc"))
            side = F.broadcast(side) if fits_broadcast(means.cardinality.get(c, 0), text_bytes=means.bytes.get(c, 0)) else side
            df = df.join(side, df[c].cast("string") == F.col("_value"), "left")
            name = f"_t{len(added)}"
            df = df.withColumn(name, F.coalesce("_enc", F.lit(means.defaults[suffix]))).drop("_value", "_enc")
            added.append((name, f"{c}{suffix}"))
    return df.select(*kept, *[F.col(n).alias(out) for n, out in added])


def one_hot_names(mapping: Mapping, columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """``(column, value, output name)``; a column per category, so categories are bounded by design."""
    wide = [c for c in columns if mapping.cardinality[c] > 10 * CARDINALITY_LIMIT]
    if wide:
        raise ValueError(f"one-hot encoding would add more than {10 * CARDINALITY_LIMIT} columns for {wide}; use encode_one_hot_vector")
    names = []
    for c in columns:
        names += [(c, r["value"], f"{c}_{r['value']}") for r in mapping.of(c).orderBy("code").collect()]
    return names


def encode_one_hot(df: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """Other columns first, then ``col_value`` indicators; an unknown value gives zeros."""
    flags = [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)).alias(name)
             for c, v, name in one_hot_names(mapping, columns)]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def encode_one_hot_vector(df: DataFrame, mapping: Mapping, columns: Sequence[str]) -> DataFrame:
    """Each column becomes a sparse vector of one indicator per category, however many; an unknown value gives an empty vector."""
    from pyspark.ml.feature import OneHotEncoder

    coded = encode_codes(df, mapping, columns, "keep")
    for c in columns:
        size = mapping.cardinality[c]
        codes = df.sparkSession.createDataFrame([(float(size),)], f"`{c}` double")  # one code past the last is the unknown one
        model = OneHotEncoder(inputCols=[c], outputCols=["_hot"], dropLast=True).fit(codes)
        known = coded.withColumn(c, F.when(F.col(c) >= 0, F.col(c)).otherwise(F.lit(float(size))))
        coded = model.transform(known).drop(c).withColumnRenamed("_hot", c)
    return coded.select(*df.columns)


def encoding_info(mapping: Mapping, threshold: int = CARDINALITY_LIMIT) -> DataFrame:
    """The mapping with each column's cardinality and whether it deserves a warning."""
    sizes = mapping.table.groupBy("column").agg(F.count("*").alias("cardinality"))
    return mapping.table.join(F.broadcast(sizes), "column").withColumn("warning", F.col("cardinality") > threshold)


def mapping_to_json(mapping: Mapping) -> str:
    """The encoding state as text; a mapping is small enough for the driver by the one-hot and warning limits."""
    state: dict[str, Any] = {}
    for r in mapping.table.orderBy("column", "code").toLocalIterator():
        state.setdefault(r["column"], {})[r["value"]] = r["code"]
    return json.dumps({"encodings": state, "cardinality": mapping.cardinality}, ensure_ascii=False)


def mapping_from_json(spark: SparkSession, text: str) -> Mapping:
    state = json.loads(text)
    rows = [(c, v, k) for c, codes in state["encodings"].items() for v, k in codes.items()]
    return Mapping(spark.createDataFrame(rows, MAPPING_SCHEMA), state["cardinality"])

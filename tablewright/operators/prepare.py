"""Leakage-free preparation: everything is fitted on the training part only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import categorical_columns
from tablewright.operators import encoding, quality, ranking, scaling
from tablewright.operators.rowid import ROW_ID

LABEL = "label"


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame | None
    features: list[str]
    keys: list[str]
    mapping: encoding.Mapping
    labels: encoding.Mapping | None
    scaler: scaling.Scaler
    warnings: list[str] = field(default_factory=list)
    encode: object = None  # DataFrame -> DataFrame, for scoring new rows

    def apply(self, new_rows: DataFrame) -> DataFrame:
        return self.encode(new_rows)


def _numeric_ready(df: DataFrame, skip: Sequence[str]) -> DataFrame:
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)):
            raise ValueError(f"column {f.name} holds times; convert it before preparing features")
        if isinstance(f.dataType, T.BooleanType):
            df = df.withColumn(f.name, F.col(f.name).cast("double"))
    return df


def _encoders(train: DataFrame, categorical: list[str], how: str, skip: Sequence[str], label: str | None,
              classes: Sequence[float], handle_unseen: str):
    """The fitted mapping and a function that turns rows into purely numeric features."""
    mapping = encoding.fit_codes(train, categorical)
    if how in ("ordinal", "label"):
        # the training part was seen by construction, so only new rows are checked
        return mapping, lambda df, known=False: encoding.encode_codes(
            df, mapping, categorical, "keep" if known else handle_unseen)
    if how == "onehot":
        return mapping, lambda df, known=False: encoding.encode_one_hot(df, mapping, categorical)
    if how == "target":
        if label is None:
            raise ValueError("target encoding needs a target")
        means = encoding.fit_target_encoder(train, categorical, label, classes)
        return mapping, lambda df, known=False: encoding.encode_target(df, means, categorical)
    raise ValueError("encoder is ordinal, label, onehot or target")


def encode_label(df: DataFrame, target: str) -> tuple[DataFrame, encoding.Mapping | None]:
    """The target as a numeric ``label``: text classes get codes over the sorted classes of all rows."""
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    if target not in categorical_columns(df):
        return df.withColumnRenamed(target, LABEL).withColumn(LABEL, F.col(LABEL).cast("double")), None
    labels = encoding.fit_codes(df, [target])
    return encoding.encode_codes(df, labels, [target], "keep").withColumnRenamed(target, LABEL), labels


def prepare_supervised(
    df: DataFrame,
    target: str,
    keys: Sequence[str] = (ROW_ID,),
    encoder: str = "ordinal",
    scaler: str | None = "standard",
    test_size: float | None = 0.2,
    seed: int = 42,
    classification: bool = True,
    handle_unseen: str = "error",
    check_quality: bool = True,
) -> Prepared:
    """Target, quality gate, split, encoders, scaler: in that order. ``test_size=None`` trains on all rows."""
    keys = list(keys)
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    if check_quality:
        quality.require_quality(df)
    labelled, labels = encode_label(_numeric_ready(df, [*keys, target]), target)
    # several passes read these rows: split, codes, scaling, fit
    labelled = labelled.persist()
    skip = [*keys, LABEL]
    categorical = categorical_columns(labelled, exclude=skip)
    if test_size is None:
        train, test = labelled, None
    else:
        train, test = ranking.train_test_split(labelled, keys, test_size, seed)
    classes: list[float] = []
    if encoder == "target" and classification:
        classes = sorted(r[0] for r in train.select(LABEL).distinct().collect())
    mapping, encode = _encoders(train, categorical, encoder, skip, LABEL, classes, handle_unseen)
    warned = [f"column {c} has {n} distinct values" for c, n in mapping.cardinality.items() if n > quality.CARDINALITY_LIMIT]
    encoded = encode(train, known=True)
    features = [c for c in encoded.columns if c not in skip]
    encoded = encoded.withColumns({c: F.col(c).cast("double") for c in features})
    fitted = scaling.fit_scaler(encoded, features, scaler)

    def ready(rows: DataFrame, known: bool = False) -> DataFrame:
        out = fitted.transform(encode(rows, known).withColumns({c: F.col(c).cast("double") for c in features}))
        return out.select(*[k for k in skip if k in out.columns], *features)

    def new_rows(rows: DataFrame) -> DataFrame:
        return ready(_numeric_ready(rows, skip))

    return Prepared(ready(train, True), ready(test) if test is not None else None, features, keys, mapping, labels, fitted,
                    warned, new_rows)


def prepare_unsupervised(
    df: DataFrame, keys: Sequence[str] = (ROW_ID,), encoder: str = "ordinal", scaler: str | None = "standard",
    check_quality: bool = True,
) -> Prepared:
    """The same without a split or a target, over the whole table."""
    keys = list(keys)
    if check_quality:
        quality.require_quality(df)
    ready_df = _numeric_ready(df, keys)
    categorical = categorical_columns(ready_df, exclude=keys)
    mapping, encode = _encoders(ready_df, categorical, encoder, keys, None, (), "error")
    ready_df = ready_df.persist()
    encoded = encode(ready_df, known=True)
    features = [c for c in encoded.columns if c not in keys]
    encoded = encoded.withColumns({c: F.col(c).cast("double") for c in features})
    fitted = scaling.fit_scaler(encoded, features, scaler)

    def ready(rows: DataFrame, known: bool = False) -> DataFrame:
        out = fitted.transform(encode(_numeric_ready(rows, keys), known).withColumns({c: F.col(c).cast("double") for c in features}))
        return out.select(*[k for k in keys if k in out.columns], *features)

    return Prepared(ready(ready_df, True), None, features, keys, mapping, None, fitted, [], ready)


class PopulationScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scaling of a vector column by the population deviation.

    Spark's scaler divides by the sample deviation; the fitted model multiplies its result by sqrt(n / (n - 1)).
    """

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in (("inputCol", inputCol), ("outputCol", outputCol)) if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        middle = f"{self.getOutputCol()}_sample"
        scaler = StandardScaler(inputCol=self.getInputCol(), outputCol=middle, withMean=True, withStd=True).fit(dataset)
        n, width = dataset.count(), len(scaler.mean)
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        return PipelineModel([scaler, ElementwiseProduct(scalingVec=Vectors.dense([factor] * width), inputCol=middle, outputCol=self.getOutputCol())])


def column_stages(encoded: Sequence[str], numeric: Sequence[str], scale: str | bool | None = "standard") -> list:
    """Stages giving ``features``: encoded categories first, then scaled numbers, the rest dropped.

    ``scale`` is ``"standard"`` (or True), ``"minmax"``, or None (or False).
    """
    if not encoded and not numeric:
        raise ValueError("no columns to transform")
    how = {True: "standard", False: None, "none": None}.get(scale, scale)
    scalers = {"standard": PopulationScaler, "minmax": MinMaxScaler}
    if how is not None and how not in scalers:
        raise ValueError("scale is standard, minmax or None")
    stages, parts = [], list(encoded)
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="_numbers"))
        if how is not None:
            stages.append(scalers[how](inputCol="_numbers", outputCol="_scaled"))
        parts.append("_scaled" if how is not None else "_numbers")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def full_stages(encoded: Sequence[str], numeric: Sequence[str], estimator, scale: str | bool | None = "standard") -> Pipeline:
    """Preparation and estimator as one object to fit, save and load."""
    return Pipeline(stages=[*column_stages(encoded, numeric, scale), estimator])

"""Feature scaling fitted in one aggregate and applied as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / scale per feature; constant features have scale 1 and become 0."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.shift})


def fit_scaler(train: DataFrame, features: Sequence[str], how: str | None) -> Scaler:
    if how in (None, "none"):
        return Scaler({}, {})
    first, second = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}[how]
    row = train.agg(*[e for i, c in enumerate(features) for e in (
        first(F.col(c).cast("double")).alias(f"a{i}"), second(F.col(c).cast("double")).alias(f"b{i}"))]).first()
    shift = {c: row[f"a{i}"] or 0.0 for i, c in enumerate(features)}
    width = {c: (row[f"b{i}"] or 0.0) - (shift[c] if how == "minmax" else 0.0) for i, c in enumerate(features)}
    # deviations at rounding level count as constant
    return Scaler(shift, {c: w if w > 1e-12 * max(abs(shift[c]), 1.0) else 1.0 for c, w in width.items()})

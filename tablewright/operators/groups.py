"""Joining per-group results back to the rows when one group may hold much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a group above total/HOT_SHARE rows is hot, so there are at most HOT_SHARE of them


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """``rows`` inner-joined to one row per group, null-safe on ``keys``.

    ``size`` is the row count of each group. Hot groups number at most ``HOT_SHARE`` by
    arithmetic, so they are broadcast; what is left has no large key and takes a
    shuffle join. Every row passes exactly one of the two.
    """
    threshold = max(total // HOT_SHARE, 1)
    small = rows.alias("r")

    def on(side: DataFrame) -> DataFrame:
        other = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in side.columns if c not in keys])
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"_k_{k}"))
        return small.join(F.broadcast(other) if side is hot else other, cond).drop(*[f"_k_{k}" for k in keys])

    hot = groups.filter(F.col(size) > threshold)
    cold = groups.filter(F.col(size) <= threshold)
    return on(hot).unionByName(on(cold))

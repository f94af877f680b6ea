"""Exact interpolated quantiles whose memory does not grow with a group's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import fits_broadcast

DIRECT_LIMIT = 2_000_000  # distinct values the built-in percentile may hold in one task
_ACCURACY = 10_000
_MARGIN = 2.5 / _ACCURACY  # beyond the sketch's own rank error


def exact_quantiles(
    df: DataFrame,
    values: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    direct_limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """One row per group with ``<value>_q<i>`` for every value column and probability.

    Small groups use ``percentile`` directly. It keeps every distinct value of a group
    in one buffer, so beyond ``direct_limit`` distinct values the rank is first bracketed
    with a bounded sketch and counted exactly, until what is left fits.
    """
    distinct = df.groupBy(*by).agg(*[F.approx_count_distinct(v).alias(v) for v in values])
    widest = distinct.agg(F.count("*").alias("groups"), *[F.max(v).alias(v) for v in values]).first()
    direct = [v for v in values if (widest[v] or 0) <= direct_limit]
    large = [v for v in values if v not in direct]
    # one call per column: each call keeps its own buffer of distinct values
    marks = [F.percentile(v, F.array(*[F.lit(float(p)) for p in probs])).alias(f"_{v}") for v in direct]
    result = df.groupBy(*by).agg(*(marks or [F.count("*").alias("_n")]))
    result = result.select(*by, *[F.col(f"_{v}")[i].alias(f"{v}_q{i}") for v in direct for i in range(len(probs))],
                           *([] if marks else ["_n"]))
    for v in large:
        refined = _bracketed(df, v, probs, by, direct_limit, widest["groups"])
        result = _attach(result, refined, by, widest["groups"])
    return result.drop("_n")


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str], groups: int) -> DataFrame:
    """Join on the group columns, null-safe; the right side holds one row per group."""
    names = [f"_g{i}" for i in range(len(by))]
    side = right.select(*[F.col(c).alias(n) for c, n in zip(by, names)], *[c for c in right.columns if c not in by])
    cond = F.lit(True)
    for c, n in zip(by, names):
        cond = cond & left[c].eqNullSafe(side[n])
    if fits_broadcast(groups, len(right.columns)):
        side = F.broadcast(side)
    return left.join(side, cond).drop(*names)


def _bracketed(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], direct_limit: int, groups: int
) -> DataFrame:
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    state = rows.groupBy(*by).agg(
        F.count("*").alias("_n"),
        *[c for i in range(len(probs)) for c in (F.min("_v").alias(f"_lo{i}"), F.max("_v").alias(f"_hi{i}"))],
    )
    # 0-based positions of the two neighbours each quantile is interpolated from
    state = state.select("*", *[c for i, p in enumerate(probs) for c in (
        ((F.col("_n") - 1) * F.lit(float(p))).alias(f"_h{i}"), F.lit(0).cast("bigint").alias(f"_below{i}"),
        F.col("_n").alias(f"_in{i}"))])
    indices = range(len(probs))
    while True:
        joined = _attach(rows, state, by, groups)
        inside = {i: F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in indices}
        widths = joined.groupBy(*by).agg(*[
            F.approx_count_distinct(F.when(inside[i], F.col("_v"))).alias(f"_d{i}") for i in indices])
        most = widths.agg(*[F.max(f"_d{i}").alias(f"_d{i}") for i in indices]).first()
        if max(most) <= direct_limit:
            break
        # sketch inside each bracket, then move the bracket to the neighbourhood of the rank
        sketch = joined.groupBy(*by).agg(*[
            F.percentile_approx(F.when(inside[i], F.col("_v")), [k / 200 for k in range(201)], F.lit(_ACCURACY)).alias(f"_s{i}")
            for i in indices])
        moved = _attach(state, sketch, by, groups)
        for i in indices:
            spot = (F.col(f"_h{i}") - F.col(f"_below{i}")) / F.greatest(F.col(f"_in{i}") - 1, F.lit(1))
            low = F.greatest(F.floor((spot - _MARGIN) * 200), F.lit(0)).cast("int") + 1
            high = F.least(F.ceil((spot + _MARGIN) * 200) + 1, F.lit(200)).cast("int") + 1
            moved = moved.withColumns({
                f"_lo{i}": F.when(low == 1, F.col(f"_lo{i}")).otherwise(F.element_at(f"_s{i}", low)),
                f"_hi{i}": F.when(high == 201, F.col(f"_hi{i}")).otherwise(F.element_at(f"_s{i}", high)),
            })
        narrowed = moved.select(*by, "_n", *[c for i in indices for c in (f"_lo{i}", f"_hi{i}", f"_h{i}")])
        counted = _attach(rows, narrowed, by, groups).groupBy(*by).agg(*[c for i in indices for c in (
            F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}"),
            F.count_if(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))).alias(f"_in{i}"))])
        state = _attach(narrowed, counted, by, groups).persist()
    final = _attach(rows, state, by, groups)
    # the bracket is small now: count its values and read the two neighbours of the rank
    counts = [
        final.filter(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")))
        .groupBy(*by, "_v").agg(F.count("*").alias("_c"), F.first(F.col(f"_h{i}") - F.col(f"_below{i}")).alias("_rank"))
        for i in indices
    ]
    result = state.select(*by)
    for i, c in zip(indices, counts):
        result = _attach(result, _pick(c, by, f"{value}_q{i}"), by, groups)
    return result


def _pick(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    runs = counts.withColumn("_cum", F.sum("_c").over(order))
    low, high = F.floor("_rank"), F.ceil("_rank")

    def covers(r: Column) -> Column:
        return (F.col("_cum") - F.col("_c") <= r) & (r < F.col("_cum"))

    ends = runs.groupBy(*by).agg(
        F.max(F.when(covers(low), F.col("_v"))).alias("_a"), F.max(F.when(covers(high), F.col("_v"))).alias("_b"),
        F.first("_rank").alias("_r"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_r") - F.floor("_r"))).alias(name))

"""Chart-ready aggregates: what a plot needs, never the raw rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import numeric_columns
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.ranking import row_hash
from tablewright.session import fits_broadcast

# fixed values: aggregates offered for bars
BAR_AGGREGATES = ("sum", "count", "mean", "median", "min", "max")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins appear with zero."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        raise ValueError(f"column {column} holds no values")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    spot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("left_edge"),
        (F.lit(low) + (F.col("id") + 1) * width).alias("right_edge"))
    return edges.join(counts, "bin", "left").select("bin", "left_edge", "right_edge", F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid of at most 200 points.

    Equal values are counted first. The grid is fixed and the sums are combined before
    the shuffle, so each task sends on at most ``points`` rows.
    """
    if not 2 <= points <= 200:
        raise ValueError("use between 2 and 200 grid points")
    n, low, high, spread = df.agg(
        F.count(column), F.min(column).cast("double"), F.max(column).cast("double"), F.stddev_samp(column)).first()
    if n < 2 or not spread:
        raise ValueError("a density needs two different values")
    h = spread * n ** (-0.2)
    step = (high - low) / (points - 1)
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    scale = 1.0 / (n * h * (2 * math.pi) ** 0.5)
    x = F.lit(low) + F.col("point") * F.lit(step)
    spread_out = values.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    kernel = F.exp(-0.5 * F.pow((x - F.col("v")) / F.lit(h), F.lit(2.0)))
    return (spread_out.groupBy("point").agg((F.sum(F.col("c") * kernel) * scale).alias("density"))
            .select("point", x.alias("x"), "density"))


def _box_bounds(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    quartiles = exact_quantiles(df, [value], [0.25, 0.5, 0.75], by)
    q1, q3 = F.col(f"{value}_q0"), F.col(f"{value}_q2")
    return quartiles.select(*by, q1.alias("q1"), F.col(f"{value}_q1").alias("median"), q3.alias("q3"),
                            (q1 - 1.5 * (q3 - q1)).alias("_low"), (q3 + 1.5 * (q3 - q1)).alias("_high"))


def _with_bounds(df: DataFrame, value: str, by: str | None) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull())
    rows = rows.withColumn("_g", F.lit("all") if by is None else F.col(by)).filter(F.col("_g").isNotNull())
    bounds = _box_bounds(rows, value, ["_g"])
    groups = bounds.count()
    return rows.join(F.broadcast(bounds) if fits_broadcast(groups, 6) else bounds, "_g")


def box_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (last value inside) and the number of outliers per category."""
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    grouped = _with_bounds(df, value, by).groupBy("_g").agg(
        F.count("*").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    return grouped.withColumnRenamed("_g", by or "category")


def box_outliers(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    bounded = _with_bounds(df, value, by)
    return bounded.filter(~F.col(value).between(F.col("_low"), F.col("_high"))).select(*df.columns)


def bar(df: DataFrame, x: str, y: str, how: str = "sum") -> DataFrame:
    """One aggregate of ``y`` per ``x``, largest first; missing keys are dropped."""
    if how not in BAR_AGGREGATES:
        raise ValueError(f"choose one of {BAR_AGGREGATES}")
    rows = df.filter(F.col(x).isNotNull())
    if how == "median":
        result = exact_quantiles(rows, [y], [0.5], [x]).withColumnRenamed(f"{y}_q0", "value")
    else:
        aggregate = {"sum": F.coalesce(F.sum(y), F.lit(0)), "count": F.count(y), "mean": F.avg(y),
                     "min": F.min(y), "max": F.max(y)}[how]
        result = rows.groupBy(x).agg(aggregate.alias("value"))
    return result.orderBy(F.desc("value"), x)


def pie(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their share in percent; missing values are dropped."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    rows = df.agg(F.count(column).alias("total")).first()["total"]
    return counts.withColumn("percent", F.col("n") * 100.0 / F.lit(rows)).orderBy(F.desc("n"), "value")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are present."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        raise ValueError("a correlation needs two numeric columns")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    lines = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    lines += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs if a != b]
    return row.select(F.inline(F.array(*lines)))


def correlation_with(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every other column with one, strongest positive first."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    row = df.agg(*[F.corr(c, target).alias(c) for c in names])
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in names])
    return row.select(F.inline(lines)).orderBy(F.desc("r"), "column")


def scatter(df: DataFrame, x: str, y: str, *extra: str) -> DataFrame:
    """The points with all chosen columns present."""
    return df.select(x, y, *[c for c in extra if c not in (x, y)]).na.drop("any")


def scatter_sample(df: DataFrame, x: str, y: str, share: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A reproducible thinning for plots of very many points, asked for by its share."""
    limit = format(int(share * 16**8), "08x")
    return scatter(df.filter(F.substring(row_hash(seed, *keys), 1, 8) < limit), x, y)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Two-dimensional bin counts: the whole point cloud in at most ``bins``² rows."""
    x0, x1, y0, y1 = df.agg(*[f(c).cast("double") for c in (x, y) for f in (F.min, F.max)]).first()

    def spot(c: str, low: float, high: float) -> Column:
        width = ((high - low) or 1.0) / bins
        return F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("int")

    rows = df.select(x, y).na.drop("any")
    return rows.groupBy(spot(x, x0, x1).alias("x_bin"), spot(y, y0, y1).alias("y_bin")).agg(F.count("*").alias("n"))

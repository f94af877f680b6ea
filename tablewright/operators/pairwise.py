"""Work over close pairs of points without a cross join and without writing pairs out.

The right side is divided into cells around pivots. The triangle inequality tells for
each left row which cells can matter; only those are visited. Large cells are cut into
sub-blocks on both sides, so a task holds two bounded blocks however skewed the data is,
and a kernel reduces each pair of blocks to a few numbers per left row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.distances import MANY_DIMENSIONS, Space
from tablewright.operators.ranking import row_hash

BLOCK = 4096  # rows of one side held by a task
STRIP_CELLS = 1 << 21  # distances held at a time, where a kernel takes left rows one by one
TASK_PAIRS = 200_000_000  # distances that a task should compute at most
MOST_TASKS = 4000
FEW_PAIRS = 50_000_000  # below this the session's own number of partitions serves
STRIP_ROWS = 64  # left rows that share a window of the right block
OWN_REACH = 512  # right rows on either side of a strip that a first look takes
WORTH = 0.5  # cells are visited one by one if that spares at least this share of the pairs
_SMALL = 4096  # below this one cell suffices
_MAX_PIVOTS = 1024

Kernel = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame]


def as_points(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``vec``, the features as one array of doubles."""
    return df.select(*keep, F.array(*[F.col(f).cast("double") for f in features]).alias("vec"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _numbers(values: Sequence[int], cell) -> Column:
    """The number of a cell, from one literal however many cells there are."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), cell + 1)


def _spread(counts: dict[int, int], cells: int):
    """Blocks per cell as an expression over the cell number."""
    blocks = [max(-(-counts.get(c, 0) // BLOCK), 1) for c in range(cells)]
    return blocks, lambda cell: _numbers(blocks, cell)


@dataclass(frozen=True)
class Cells:
    """The right side, each row with its nearest pivot: ``cell`` and ``_far``, and each cell's rows and radius.

    With ``apart``, a column of both sides, only rows of different values matter: a cell whose rows all share the value that
    ``sole`` gives is not visited by rows of that value.
    """

    rows: int
    pivots: np.ndarray | None
    placed: DataFrame
    stats: dict[int, tuple[int, float]]
    apart: str | None = None
    sole: dict[int, int] | None = None


def divide(right: DataFrame, id_col: str, space: Space, prune: bool = True) -> Cells:
    # fresh column identities, so that one table may stand on both sides
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    rows = right.count()
    pivots = _pick_pivots(right, id_col, rows, space) if space.prunable and prune else None
    placed = _place(right, pivots, space)
    if pivots is None:
        return Cells(rows, None, placed, {0: (rows, np.inf)})
    placed = placed.persist()
    return Cells(rows, pivots, placed, {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("_far").alias("radius")).collect()})


def near_blocks(
    left: DataFrame,
    right: DataFrame | Cells,
    id_col: str,
    kernel: Kernel,
    schema: str,
    space: Space,
    radius: float | None = None,
    nearest: int | None = None,
    bound: str | None = None,
    own_cell: bool = False,
    by_row: bool = True,
    quick: bool = False,
    flags: bool = False,
) -> DataFrame:
    """Apply ``kernel(left block, right block, distances)`` to every pair of blocks that matters.

    ``radius`` asks for all right rows within that distance, ``nearest`` for the k
    nearest ones, ``bound`` for those within the distance that a left column names; with none
    of them, every block pair is visited. ``own_cell`` visits only the nearest cells that hold ``nearest`` rows.
    Both inputs carry ``id_col`` and ``vec``. The kernel must reduce: its rows are later merged per id.

    A kernel that looks at each left row by itself (``by_row``) is handed a strip of the left block at a time, in few dimensions with
    those right rows alone that one coordinate leaves within reach. ``quick`` allows
    distances of eleven digits, which compare with ``radius`` as exact ones do. ``flags`` hands it ``distance <= radius`` for the whole
    block in place of distances.
    """
    asks = radius is not None or nearest or bound is not None
    side = right if isinstance(right, Cells) else divide(right, id_col, space, bool(asks))
    limit = None if radius is None else space.inward(radius)
    left_rows = None
    if side.pivots is not None:
        left = left.persist()
        asked = _asked(left, side, space, limit, nearest, bound, own_cell)
        pairs = sum(n * side.stats[c][0] for c, n in asked.items())
        if not own_cell:
            left_rows = left.count()
            if pairs > (1 - WORTH) * left_rows * side.rows:
                # cells that almost every row must visit only multiply the rows
                side = Cells(side.rows, None, side.placed.withColumns({"cell": F.lit(0), "_far": F.lit(0.0)}), {0: (side.rows, np.inf)}, side.apart)
    if side.pivots is None:
        wanted, asked = left.withColumn("cell", F.lit(0)), {0: left.count() if left_rows is None else left_rows}
        pairs = asked[0] * side.rows
    else:
        wanted = _candidates(left, side, space, limit, nearest, bound, own_cell)
    cells = 1 if side.pivots is None else len(side.pivots)
    right_counts, right_blocks = _spread({c: s[0] for c, s in side.stats.items()}, cells)
    left_counts, left_blocks = _spread(asked, cells)
    salt = F.xxhash64(id_col)
    lefts = (
        wanted.withColumn("_lb", F.pmod(salt, left_blocks(F.col("cell"))).cast("int"))
        .withColumn("_rb", F.explode(F.sequence(F.lit(0), right_blocks(F.col("cell")) - 1)))
    )
    visited = sorted(asked)
    rights = (
        side.placed.drop("_far").filter(_numbers([int(c in asked) for c in range(cells)], F.col("cell")) == 1 if len(visited) < cells else F.lit(True))
        .withColumn("_rb", F.pmod(salt, right_blocks(F.col("cell"))).cast("int"))
        .withColumn("_lb", F.explode(F.sequence(F.lit(0), left_blocks(F.col("cell")) - 1)))
    )
    key = ["cell", "_lb", "_rb"]
    if pairs > FEW_PAIRS:
        # few bytes stand for much work here, so tasks are dealt by the distances to compute and not by size
        block_pairs = sum(left_counts[c] * right_counts[c] for c in visited)
        tasks = int(min(block_pairs, max(-(-pairs // TASK_PAIRS), 64), MOST_TASKS))
        lefts, rights = lefts.repartition(tasks, *key), rights.repartition(tasks, *key)
    empty = pd.DataFrame({f.name: [] for f in T.StructType.fromDDL(schema).fields})
    windows = by_row and not flags and space.by_coordinate and (limit is not None or bound is not None or own_cell)
    measure = space.quick if quick else (lambda x, y, _=None: space.between(x, y))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty
        x, y = space.rows(matrix(a["vec"])), space.rows(matrix(b["vec"]))
        if windows:
            a, b, x, y, strips = _windows(a, b, x, y, space, limit, bound, max(OWN_REACH, nearest or 0) if own_cell else None)
        else:
            step = max(1, STRIP_CELLS // len(b))
            strips = [(i, i + step, 0, len(b)) for i in range(0, len(a), step)]
        if flags:
            return kernel(a, b, np.concatenate([space.outward(measure(x[i:j], y, limit)) <= radius for i, j, _, _ in strips]))
        if not by_row:
            return kernel(a, b, space.outward(measure(x, y, limit)))
        out = [kernel(a.iloc[i:j], b.iloc[k:m], space.outward(measure(x[i:j], y[k:m], limit))) for i, j, k, m in strips if k < m]
        out = [part for part in out if len(part)]
        return pd.concat(out, ignore_index=True) if out else empty

    return lefts.groupBy(*key).cogroup(rights.groupBy(*key)).applyInPandas(run, schema)


def _windows(a: pd.DataFrame, b: pd.DataFrame, x: np.ndarray, y: np.ndarray, space: Space, limit: float | None, bound: str | None, reach: int | None):
    """Both blocks in the order of their widest coordinate, and strips ``(first, end, first right, end right)`` of left rows.

    No right row outside its window is within the asked distance of the strip, since points differ no more in one coordinate than in all.
    With ``reach`` a window is that many rows on either side.
    """
    if x.shape[1] >= MANY_DIMENSIONS:
        step = max(1, STRIP_CELLS // len(b))
        return a, b, x, y, [(i, min(i + step, len(a)), 0, len(b)) for i in range(0, len(a), step)]
    axis = int(np.ptp(y, axis=0).argmax())
    left, right = np.argsort(x[:, axis], kind="stable"), np.argsort(y[:, axis], kind="stable")
    a, b, x, y = a.iloc[left], b.iloc[right], x[left], y[right]
    at, to = x[:, axis], y[:, axis]
    most = None
    if reach is None:
        most = np.full(len(a), limit, dtype=float) if bound is None else np.array([space.inward(v) for v in a[bound]])
        most = most + 1e-9 * (1.0 + np.abs(most) + np.abs(at))
    strips = []
    for i in range(0, len(a), STRIP_ROWS):
        j = min(i + STRIP_ROWS, len(a))
        if most is None:
            k, m = np.searchsorted(to, at[i]) - reach, np.searchsorted(to, at[j - 1], side="right") + reach
            m = max(m, 2 * reach)
            k = min(k, len(b) - 2 * reach)
        else:
            k, m = np.searchsorted(to, (at[i:j] - most[i:j]).min()), np.searchsorted(to, (at[i:j] + most[i:j]).max(), side="right")
        k, m = max(int(k), 0), min(int(m), len(b))
        step = max(1, STRIP_CELLS // max(m - k, 1))
        strips += [(n, min(n + step, j), k, m) for n in range(i, j, step)]
    return a, b, x, y, strips


def _pick_pivots(right: DataFrame, id_col: str, rows: int, space: Space) -> np.ndarray | None:
    if rows <= _SMALL:
        return None
    wanted = int(min(_MAX_PIVOTS, max(8, rows // _SMALL * 4)))
    share = min(1.0, 4.0 * wanted / rows)
    limit = format(int(share * (16**8 - 1)), "08x")
    # a hash-chosen handful: at most a few thousand vectors whatever the table size
    picked = (right.withColumn("_h", row_hash(7, id_col)).filter(F.substring("_h", 1, 8) <= limit)
              .orderBy("_h").limit(wanted).select("vec").collect())
    return np.unique(space.rows(np.array([r["vec"] for r in picked], dtype=float)), axis=0)


def least_reach(left: DataFrame, side: Cells, space: Space, core: str | None = None, cores: dict[int, float] | None = None) -> DataFrame:
    """``(value, most)``: for each value of ``side.apart`` a distance within which one of its rows meets a row of another value.

    Any row of a cell is within the cell's radius of its pivot. ``core`` and each cell's largest (``cores``) raise distances.
    """
    used = np.array(sorted(side.stats))
    reach = np.array([side.stats[c][1] for c in used])
    sole = np.array([c in side.sole for c in used])
    held = np.array([side.sole.get(c, 0) for c in used])
    tops = None if cores is None else np.array([cores[c] for c in used])
    centres, apart = side.pivots[used], side.apart

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches, len(used)):
            if not len(pdf):
                continue
            value = pdf[apart].to_numpy()
            d = space.outward(space.quick(space.rows(matrix(pdf["vec"])), centres) + reach)
            if core:
                d = np.maximum(d, np.maximum(pdf[core].to_numpy()[:, None], tops))
            d[sole & (held == value[:, None])] = np.inf
            yield pd.DataFrame({"value": value, "most": d.min(axis=1)}).groupby("value", as_index=False).min()

    kept = ["vec", apart, *([core] if core else [])]
    return left.select(*kept).mapInPandas(run, "value bigint, most double").groupBy("value").agg(F.min("most").alias("most"))


def _place(right: DataFrame, pivots: np.ndarray | None, space: Space) -> DataFrame:
    """Each right row with its nearest pivot and the distance to it."""
    if pivots is None:
        return right.withColumn("cell", F.lit(0)).withColumn("_far", F.lit(0.0))
    schema = T.StructType([*right.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches, len(pivots)):
            if len(pdf):
                d = space.quick(space.rows(matrix(pdf["vec"])), pivots)
                at = d.argmin(axis=1)
                yield pdf.assign(cell=at.astype("int32"), _far=d[np.arange(len(d)), at])

    return right.mapInPandas(place, schema)


def _chooser(side: Cells, space: Space, limit: float | None, nearest: int | None, bound: str | None, own_cell: bool):
    """A function of some left rows: the place of a row and the number of a cell that can hold a match, for each such pair."""
    used = np.array(sorted(side.stats))
    counts = np.array([side.stats[c][0] for c in used])
    reach = np.array([side.stats[c][1] for c in used])
    centres = side.pivots[used]
    sole = np.array([c in (side.sole or {}) for c in used])
    held = np.array([(side.sole or {}).get(c, 0) for c in used])
    apart = side.apart

    def choose(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        d = space.quick(space.rows(matrix(pdf["vec"])), centres)
        if apart is not None:
            d[sole & (held == pdf[apart].to_numpy()[:, None])] = np.inf
        if bound is not None:
            most = np.array([space.inward(v) for v in pdf[bound]])
        elif limit is not None:
            most = np.full(len(d), limit)
        else:
            if own_cell and counts.min() >= nearest:
                return np.arange(len(d)), used[d.argmin(axis=1)]
            # farthest any row of a cell can be; enough cells for k rows bound the k-th distance
            far = d + reach
            order = (d if own_cell else far).argsort(axis=1, kind="stable")
            enough = np.cumsum(counts[order], axis=1) >= nearest
            first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(used) - 1)
            if own_cell:
                rows, at = np.nonzero(np.arange(len(used)) <= first[:, None])
                return rows, used[order[rows, at]]
            most = far[np.arange(len(d)), order[np.arange(len(d)), first]]
        slack = 1e-9 * (1.0 + np.abs(most))
        rows, at = np.nonzero((d - reach <= (most + slack)[:, None]) & np.isfinite(d))
        return rows, used[at]

    return choose


def _pieces(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Batches cut so that their distances to all cells stay few."""
    step = max(1, STRIP_CELLS // cells)
    for pdf in batches:
        for i in range(0, len(pdf), step):
            yield pdf.iloc[i:i + step]


def _asked(left: DataFrame, side: Cells, *how) -> dict[int, int]:
    """How many left rows visit each cell, counted within partitions first."""
    choose, cells = _chooser(side, *how), len(side.pivots)
    kept = ["vec", *([how[3]] if how[3] else []), *([side.apart] if side.apart else [])]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(cells, dtype="int64")
        for pdf in _pieces(batches, cells):
            n += np.bincount(choose(pdf)[1], minlength=cells)
        held = np.flatnonzero(n)
        yield pd.DataFrame({"cell": held.astype("int32"), "n": n[held]})

    rows = left.select(*kept).mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}


def _candidates(left: DataFrame, side: Cells, *how) -> DataFrame:
    """One row per left row and cell that can hold a match."""
    choose, cells = _chooser(side, *how), len(side.pivots)
    schema = T.StructType([*left.schema.fields, T.StructField("cell", T.IntegerType())])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches, cells):
            rows, at = choose(pdf)
            for i in range(0, len(rows), 10_000):
                yield pdf.iloc[rows[i:i + 10_000]].assign(cell=at[i:i + 10_000].astype("int32"))

    return left.mapInPandas(find, schema)

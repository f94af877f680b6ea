"""Exact rank selection on a hash order: splits, folds and samples without a sort."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "_hash"
_DIGITS = 3  # hex digits examined per pass: at most 4096 counters reach the driver
_FETCH = 20_000  # hashes fetched once a bucket is this small


def row_hash(seed: int, *keys: str) -> Column:
    """A seeded pseudo-random order over rows, the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_cutoffs(df: DataFrame, hash_col: str, ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, str]]:
    """The number of rows, and the hash standing at each 0-based rank ``ranks(n)`` asks for.

    Found by counting hash prefixes. Every pass is one map-side-combined count over the hash column; rows are never sorted
    or moved. Hashes spread evenly, so a bucket shrinks 4096-fold per pass.
    """
    hashes = df.select(hash_col)
    found: dict[int, str] = {}
    sizes = _prefix_counts(hashes, hash_col, _DIGITS)
    total = sum(sizes.values())
    open_targets = {r: ("", r) for r in set(ranks(total))}
    width = 0
    while open_targets:
        width += _DIGITS
        prefixes = sorted({p for p, _ in open_targets.values()})
        if width > _DIGITS:
            sizes = _prefix_counts(hashes.filter(F.substring(hash_col, 1, width - _DIGITS).isin(prefixes)), hash_col, width)
        small: dict[str, list[tuple[int, int]]] = {}
        later: dict[int, tuple[str, int]] = {}
        for rank, (prefix, rest) in open_targets.items():
            for bucket in sorted(b for b in sizes if b.startswith(prefix)):
                if rest < sizes[bucket]:
                    break
                rest -= sizes[bucket]
            else:
                raise ValueError(f"rank {rank} lies beyond the rows")
            if sizes[bucket] <= _FETCH or width >= 30:
                small.setdefault(bucket, []).append((rank, rest))
            else:
                later[rank] = (bucket, rest)
        if small:
            # at most _FETCH hashes per asked rank come back, whatever the table size
            near = hashes.filter(F.substring(hash_col, 1, width).isin(sorted(small))).collect()
            for bucket, wanted in small.items():
                values = sorted(r[0] for r in near if r[0].startswith(bucket))
                for rank, rest in wanted:
                    found[rank] = values[rest]
        open_targets = later
    return total, found


def _prefix_counts(hashes: DataFrame, hash_col: str, width: int) -> dict[str, int]:
    return {r["p"]: r["count"] for r in hashes.groupBy(F.substring(hash_col, 1, width).alias("p")).count().collect()}


def held_out_rows(total: int, test_size: float) -> int:
    return math.ceil(test_size * total)


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """A shuffled split with exact sizes: the ``ceil(test_size * n)`` smallest hashes are the test part."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    hashed = df.withColumn(HASH, row_hash(seed, *keys))
    total, cuts = hash_cutoffs(hashed, HASH, lambda n: [held_out_rows(n, test_size) - 1] if n else [])
    if not total:
        return hashed.drop(HASH), hashed.drop(HASH)
    cut = cuts[held_out_rows(total, test_size) - 1]
    return (hashed.filter(F.col(HASH) > cut).drop(HASH), hashed.filter(F.col(HASH) <= cut).drop(HASH))


def sample_rows(df: DataFrame, keys: Sequence[str], k: int = 1, seed: int = 42) -> DataFrame:
    """``k`` rows picked at random, the same ones for the same seed."""
    hashed = df.withColumn(HASH, row_hash(seed, *keys))
    return hashed.orderBy(HASH).limit(k).drop(HASH)


def fold_starts(total: int, folds: int) -> list[int]:
    """First position of each contiguous fold; the first ``total % folds`` are one row longer."""
    if not 2 <= folds <= total:
        raise ValueError("need between 2 and n folds")
    size, longer = divmod(total, folds)
    return [f * size + min(f, longer) for f in range(folds)]


def assign_folds(df: DataFrame, hash_col: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous folds over the hash order, cut at exact ranks."""
    total, cuts = hash_cutoffs(df, hash_col, lambda n: fold_starts(n, folds)[1:])
    starts = fold_starts(total, folds)
    fold = F.lit(0)
    for number, start in enumerate(starts[1:], start=1):
        fold = F.when(F.col(hash_col) >= cuts[start], F.lit(number)).otherwise(fold)
    return df.withColumn(name, fold)

"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.components import components, union_find
from tablewright.llm.shared import lean, whole_groups
from tablewright.llm.texts import mix
from tablewright.session import cut_lineage

TABLES, FUNCTIONS, PROBES = 8, 3, 2  # hash tables, cross-polytope functions joined in a table, further buckets a vector enters
BLOCK = 256  # members of a bucket compared in one group
PAIRS = 1 << 16  # pairs compared at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def bucket_codes(x: np.ndarray, salt: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES,
                 seed: int = 7) -> np.ndarray:
    """The buckets of unit rows ``x``, ``tables * (1 + probes)`` for each; ``salt`` separates groups that never meet.

    A function is the signed axis nearest to the vector after three rounds of random signs and Hadamard transform. A probe
    replaces the one choice that was made by the smallest margin, then the next.
    """
    width = 1 << max(x.shape[1] - 1, 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng, out = np.random.default_rng([seed, width]), []
    rows = np.arange(len(x))
    for t in range(tables):
        first, second, margin = [], [], []
        for _ in range(functions):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
            size = np.abs(y)
            a = size.argmax(axis=1)
            top = size[rows, a].copy()
            size[rows, a] = -1
            b = size.argmax(axis=1)
            first.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
            margin.append(top - size[rows, b])
        first, second, margin = np.array(first), np.array(second), np.array(margin)
        order = margin.argsort(axis=0, kind="stable")
        for p in range(min(probes, functions) + 1):
            axes = first.copy()
            if p:
                axes[order[p - 1], rows] = second[order[p - 1], rows]
            code = mix(salt + np.uint64(t + 1))
            for k in range(functions):
                with np.errstate(over="ignore"):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + axes[k].astype(np.uint64))
            out.append(code)
    return np.stack(out, axis=1).view(np.int64) if out else np.zeros((len(x), 0), dtype=np.int64)


def _coded(tables: int, functions: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                lists, groups = part.column("vector"), part.column("grp").to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy().astype(np.float64)
                ends = np.cumsum(sizes)
                codes = np.zeros((part.num_rows, tables * (min(probes, functions) + 1)), dtype=np.int64)
                for size in np.unique(sizes):  # vectors of another length are never linked
                    at = np.flatnonzero(sizes == size)
                    x = flat[(ends[at] - size)[:, None] + np.arange(size)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    codes[at] = bucket_codes(x, mix(groups[at].astype(np.int64).view(np.uint64) + np.uint64(size)), tables, functions, probes)
                yield part.append_column("codes", pa.FixedSizeListArray.from_arrays(
                    pa.array(codes.reshape(-1)), codes.shape[1]).cast(pa.list_(pa.int64())))

    return run


def _pairs(heads: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside each group, in bounded portions."""
    left = np.concatenate([np.arange(h, h + s - 1) for h, s in zip(heads, sizes)]) if len(heads) else heads
    ends = np.repeat(heads + sizes, np.maximum(sizes - 1, 0))
    many = ends - left - 1
    total = np.cumsum(many)
    first = 0
    while first < len(left):
        last = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, side="right")), first + 1)
        n = many[first:last]
        a = np.repeat(left[first:last], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        first = last


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, heads in whole_groups(batches, ("bucket", "i", "j")):
            bucket, side, key, copies = (batch.column(c).to_numpy() for c in ("bucket", "side", "key", "copies"))
            lists = batch.column("vector")
            starts, length = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.float64)
            codes = batch.column("codes").flatten().to_numpy().reshape(len(key), -1)
            found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for a, b in _pairs(heads, np.diff(np.append(heads, len(key)))):
                ok = (length[a] == length[b]) & ((side[a] != side[b]) | (side[a] == 2))
                a, b = a[ok], b[ok]
                for size in np.unique(length[a]):
                    at = np.flatnonzero(length[a] == size)
                    x, y = (flat[starts[r[at]][:, None] + np.arange(size)] for r in (a, b))
                    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                    cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                    near = at[cosine >= least]
                    for k in range(0, len(near), 1 << 13):  # a pair counts in the least bucket that both enter
                        p, q = a[near[k:k + (1 << 13)]], b[near[k:k + (1 << 13)]]
                        own = bucket[p][:, None]
                        mine = np.where(codes[p] < own, codes[p], own)
                        shared = ((mine[:, :, None] == codes[q][:, None, :]).any(axis=2) & (mine != own)).any(axis=1)
                        found_a.append(p[~shared])
                        found_b.append(q[~shared])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            count = np.bincount(a, weights=copies[b], minlength=len(key)) + np.bincount(b, weights=copies[a], minlength=len(key))
            names, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, weights=count, minlength=len(names)).astype(np.int64)
            root = names.copy()
            v, r = union_find(key[a], key[b])
            root[np.searchsorted(names, v)] = r
            has = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[has]), pa.array(total[has]), pa.array(root[has])], names=["key", "n", "root"])

    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = 0.98,
                 tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES) -> DataFrame:
    """``(key, n_links, component_id, kept)``: one row for every row of ``df``.

    Rows of one ``group`` are linked at a cosine of ``least`` or more, taken in double precision; pairs come from the buckets
    two vectors share in any table. ``n_links`` counts the other rows linked directly, copies included. Rows whose group is NULL
    and vectors that are NULL, empty, zero, or hold a NULL, NaN or infinite component are linked with nothing, as are vectors of
    different lengths. A NULL key keeps its row without links. Other columns are ignored; rows with equal keys count as rows.

    Equal vectors are one entry with a count. Large buckets are cut into blocks of bounded size, and pairs of blocks are
    compared inside tasks, which put out counts and union-find edges, at most one of each for a vector, never pairs.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(group).cast("bigint").alias("grp"), F.col(vector).alias("vector"))
    usable = (F.col("key").isNotNull() & F.col("grp").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
              & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
              & F.exists("vector", lambda v: v != 0))
    rows = cut_lineage(rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("digest", F.when(
        F.col("ok"), F.sha2(F.concat_ws(",", "grp", F.col("vector").cast("array<string>")), 256))))
    real = rows.filter("ok")
    classes = real.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    classes = cut_lineage(classes)
    one = real.join(classes.select("digest", F.col("rep").alias("key"), "copies"), ["digest", "key"]).dropDuplicates(["digest"])
    coded = one.select("key", "grp", "vector", "copies")
    schema = T.StructType([*coded.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])
    coded = cut_lineage(coded.mapInArrow(lean(_coded(tables, functions, probes)), schema))
    entries = coded.select("key", F.explode(F.array_distinct("codes")).alias("bucket"))
    buckets = cut_lineage(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(
        "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    mates = entries.join(buckets, "bucket").withColumn("own", F.pmod(F.xxhash64("key", "bucket"), "blocks").cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"),
        F.when(F.col("own") < j, F.lit(0)).when(F.col("own") == j, F.lit(2)).otherwise(F.lit(1)).alias("side")))
    spread = cut_lineage(mates.select("key", "bucket", F.explode(at).alias("at")).select("key", "bucket", "at.*"))
    full = spread.join(coded.select("key", "vector", "copies", "codes"), "key")
    full = full.select("bucket", "i", "j", "side", "key", "copies", "vector", "codes")
    full = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut_lineage(full.mapInArrow(lean(_linked(least)), "key bigint, n bigint, root bigint"))
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    stats = classes.join(links.withColumnRenamed("key", "rep"), "rep", "left").join(
        groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    stats = cut_lineage(stats.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                     F.coalesce("component", "rep").alias("component_id")))
    named = real.select("key", "digest").join(stats, "digest").select("key", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    out = named.unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))

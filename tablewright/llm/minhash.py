"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash draws, for each element, one random permutation of the signature's slots, and offers the element's k-th random
number plus k to the k-th slot of it. Numbers of later steps are larger than all numbers of earlier steps, so a text stops as
soon as every slot is filled; slots of one element have different ranks, which lowers the variance of the estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components, union_find
from tablewright.llm.shared import broadcast_if_small, lean, small_batches, whole_groups
from tablewright.llm.texts import mix, slices, split_words, window_hashes
from tablewright.session import cut_lineage

WORDS = 5
SLOTS, BANDS = 128, 32  # 4 slots a band: a pair at similarity 0.75 shares no band with probability 5e-6
BLOCK = 256  # texts on one side of a comparison that is one group of rows
COLUMNS = 4096  # shingles counted at once when blocks are compared

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``n``-word shingles of each text, sorted within the text, and where each text begins."""
    words = split_words(data, bounds, lower=True)
    hashes, counts = words.hashes(), words.counts()
    start = np.arange(len(hashes))
    whole = start + n <= len(hashes)
    whole[whole] = words.doc[start[whole]] == words.doc[start[whole] + n - 1]
    values, owner = window_hashes(hashes, n)[start[whole]] if whole.any() else np.zeros(0, dtype=np.uint64), words.doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    first = np.cumsum(counts) - counts
    for size in range(1, n):  # a text of fewer words is one shingle
        of = short[counts[short] == size]
        values = np.append(values, window_hashes(hashes, size)[first[of]] if len(of) else values[:0])
        owner = np.append(owner, of)
    by = np.lexsort((values, owner))
    values, owner = values[by], owner[by]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(words.docs + 1))


def signatures(values: np.ndarray, heads: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set; row i for ``values[heads[i]:heads[i + 1]]``. Empty sets give zeros."""
    docs, sizes = len(heads) - 1, np.diff(heads)
    sign = np.full((docs, slots), np.inf)
    owner = np.repeat(np.arange(docs), sizes)
    seeds, perm = values, np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(values), slots))
    for step in range(slots):
        if not len(owner):
            break
        with np.errstate(over="ignore"):
            draw = mix(seeds + np.uint64(2 * step + 1) * _STEP)
            pick = mix(seeds + np.uint64(2 * step + 2) * _STEP)
        number = step + (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        at = step + ((pick >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(owner))
        if step == 0:
            slot = at
            perm = perm.copy() if slots > 1 else perm
            if slots > 1:
                perm[row, at] = 0
        else:
            slot = perm[row, at].astype(np.int64)
            perm[row, at] = perm[row, step]
        np.minimum.at(sign.reshape(-1), owner * slots + slot, number)
        open_docs = np.isinf(sign).any(axis=1)
        going = open_docs[owner]
        if not going.all():
            owner, seeds, perm = owner[going], seeds[going], perm[going]
    sign[sizes == 0] = 0
    return sign


def _digests(values: np.ndarray, heads: np.ndarray) -> list[bytes]:
    import hashlib

    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() for a, b in zip(heads[:-1].tolist(), heads[1:].tolist())]


def sign_texts(df: DataFrame, key: str, text: str, words: int = WORDS, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """``(key, n_shingles, digest, bands)``: one row per row of ``df``; no shuffle."""
    rows = slots // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column(1), 1 << 19):
                values, heads = shingle_sets(data, bounds, words)
                bits = np.ascontiguousarray(signatures(values, heads, slots)).view(np.uint64)
                with np.errstate(over="ignore"):
                    band = np.full((last - first, bands), 0, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for k in range(rows):
                        band = mix(band * _STEP + bits[:, k::rows])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(np.diff(heads)), pa.array(_digests(values, heads), pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(band.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))],
                    names=["key", "n_shingles", "digest", "bands"])

    plain = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return small_batches(plain).mapInArrow(lean(run), "key bigint, n_shingles bigint, digest binary, bands array<bigint>")


def shingle_arrays(df: DataFrame, words: int = WORDS) -> DataFrame:
    """``(key, shingles)`` of ``df(key, text)``: the full sets, as arrays of bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column(1)):
                values, heads = shingle_sets(data, bounds, words)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(values.view(np.int64)))], names=["key", "shingles"])

    return small_batches(df).mapInArrow(lean(run), "key bigint, shingles array<bigint>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of ``left`` with each of ``right``."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    names = np.intersect1d(np.concatenate(left), np.concatenate(right))  # only these can be common
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for each in (left, right):
        values, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(s) for s in each])
        at = np.minimum(np.searchsorted(names, values), max(len(names) - 1, 0))
        hit = names[at] == values if len(names) else np.zeros(len(values), dtype=bool)
        by = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][by], owner[hit][by]))
    for first in range(0, len(names), COLUMNS):
        width = min(COLUMNS, len(names) - first)
        marks = []
        for (at, owner), each in zip(sides, (left, right)):
            a, b = np.searchsorted(at, [first, first + width])
            mark = np.zeros((len(each), width), dtype=np.float32)
            mark[owner[a:b], at[a:b] - first] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return np.rint(out).astype(np.int64)


def _linked(percent: int):
    """Compares, in each group, side 0 with side 1, and the texts of side 2 with each other, if their components differ.

    Puts out links enough to connect what is linked: a link for each text and group at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, heads in whole_groups(batches, ("unit", "kind", "i", "j")):
            key, side, comp = (batch.column(c).to_numpy() for c in ("key", "side", "comp"))
            lists = batch.column("shingles")
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            sizes, found = np.diff(ends), []
            for a, b in zip(heads, np.append(heads[1:], len(key))):
                rows = np.arange(a, b)
                left, right = rows[side[a:b] != 1], rows[side[a:b] != 0]
                if not len(left) or not len(right):
                    continue
                common = common_counts([flat[ends[r]:ends[r + 1]] for r in left], [flat[ends[r]:ends[r + 1]] for r in right])
                near = (100 * common >= percent * (sizes[left][:, None] + sizes[right] - common)) & (comp[left][:, None] != comp[right])
                x, y = np.nonzero(near)
                if len(x):
                    v, root = union_find(key[left[x]], key[right[y]])
                    found.append(np.stack([root, v])[:, root != v])
            if found:
                pairs = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _compare(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` of ``rows(unit, kind, i, j, side, key, comp)``, whose groups are bounded, on the full sets."""
    full = rows.join(sets, "key").select("unit", "kind", "i", "j", "side", "key", "comp", "shingles")
    full = full.repartition("unit", "kind", "i", "j").sortWithinPartitions("unit", "kind", "i", "j")
    return full.mapInArrow(lean(_linked(percent)), "a bigint, b bigint")


def _stars(mates: DataFrame) -> DataFrame:
    """Rows that compare every member of a bucket with the bucket's least member."""
    pairs = cut_lineage(mates.filter("key <> first").select("first", "key").distinct())
    blocks = pairs.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks)
    zero = F.lit(0).cast("bigint")
    members = pairs.join(blocks, "first").select(
        F.col("first").alias("unit"), F.lit(0).alias("kind"), zero.alias("i"), F.pmod(F.xxhash64("key"), "blocks").alias("j"), F.lit(1).alias("side"), "key")
    centers = blocks.select(F.col("first").alias("unit"), F.lit(0).alias("kind"), zero.alias("i"), F.explode(
        F.sequence(zero, F.col("blocks").cast("bigint") - 1)).alias("j"), F.lit(0).alias("side"), F.col("first").alias("key"))
    return members.unionByName(centers).withColumn("comp", F.col("key"))


def _crossings(mates: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows that compare all members of a bucket that are in different components.

    The largest component of a bucket meets the others, and the others meet each other. Buckets with the same largest
    component are compared together if that is no more work than one by one, as for a group whose texts share most bands.
    """
    placed = mates.join(groups.withColumnRenamed("id", "key"), "key", "left")
    placed = cut_lineage(placed.select("bucket", "key", F.coalesce("component", "key").alias("comp")))
    parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    mixed = cut_lineage(mixed.filter("n_all > n_main"))
    rows = cut_lineage(placed.join(mixed.select("bucket", "main"), "bucket"))

    def work(n_main, n_all):
        other = F.col(n_all) - F.col(n_main)
        return F.col(n_main) * other + other * other / 2

    single = mixed.groupBy("main").agg(F.sum(work("n_main", "n_all")).alias("alone"))
    wide = rows.select("main", "key", "comp").distinct().groupBy("main").agg(
        F.sum((F.col("comp") == F.col("main")).cast("bigint")).alias("n_main"), F.count("*").alias("n_all"))
    together = cut_lineage(wide.join(single, "main").select("main", (work("n_main", "n_all") <= F.col("alone")).alias("wide")))
    units = rows.join(broadcast_if_small(together), "main").select(
        F.when(F.col("wide"), F.col("main")).otherwise(F.col("bucket")).alias("unit"), F.when(F.col("wide"), 0).otherwise(2).alias("kind"),
        "main", "key", "comp").distinct()
    units = cut_lineage(units)
    sizes = units.groupBy("unit", "kind").agg(
        F.ceil(F.sum((F.col("comp") == F.col("main")).cast("bigint")) / BLOCK).cast("bigint").alias("main_blocks"),
        F.ceil(F.sum((F.col("comp") != F.col("main")).cast("bigint")) / BLOCK).cast("bigint").alias("other_blocks"))
    units = units.join(cut_lineage(sizes), ["unit", "kind"])
    is_main, turn, one = F.col("comp") == F.col("main"), F.xxhash64("key", "unit"), F.lit(1).cast("bigint")
    own = F.when(is_main, F.pmod(turn, "main_blocks")).otherwise(F.pmod(turn, "other_blocks"))
    # kind + 0: a block of the largest component, i, with a block of others, j; kind + 1: two blocks of others, i <= j
    with_others = F.transform(F.sequence(one - 1, F.col("other_blocks") - 1), lambda j: F.struct(
        F.when(is_main, F.col("kind")).otherwise(F.col("kind") + 1).alias("kind"), F.when(is_main | (own <= j), own).otherwise(j).alias("i"),
        F.when(is_main | (own <= j), j).otherwise(own).alias("j"), F.when(is_main | (own < j), 0).when(own == j, 2).otherwise(1).alias("side")))
    with_main = F.transform(F.sequence(one - 1, F.col("main_blocks") - 1), lambda i: F.struct(
        F.col("kind").alias("kind"), i.alias("i"), own.alias("j"), F.lit(1).alias("side")))
    meets = F.explode(F.when(is_main, with_others).otherwise(F.concat(with_others, with_main)))
    return units.select("unit", meets.alias("at"), "key", "comp").select("unit", "at.*", "key", "comp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, words: int = WORDS,
                    slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``: one row for every row of ``df``.

    Texts are compared whole, by their distinct ``words``-word shingles; two are linked if ``percent`` % of their union is
    common, and a component is named by its least key. NULL and empty texts, and texts without a word, have an empty set and
    are linked with nothing; a NULL key keeps its row, with a NULL component. Rows with equal keys are one document and share a
    component. Other columns are ignored. An empty table gives no rows.

    Equal sets become one class. The classes of a band bucket are first compared with its least member, one comparison a
    member. Bucket mates that this leaves in different components are then compared in blocks of bounded size, all of them, on
    their full sets. So every pair that shares a band is known to be connected or has been compared, however large the bucket,
    and tasks put out links that connect, never pairs.
    """
    plain = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    signed = cut_lineage(sign_texts(df, key, text, words, slots, bands))
    real = signed.filter("n_shingles > 0 AND key IS NOT NULL")
    classes = cut_lineage(real.groupBy("digest").agg(F.min("key").alias("rep")))
    member = cut_lineage(real.select("key", "n_shingles", "digest").join(classes, "digest").select("key", "n_shingles", "rep"))
    reps = real.join(classes.select(F.col("rep").alias("key")).distinct(), "key", "left_semi")
    entries = reps.select("key", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    mates = cut_lineage(entries.join(cut_lineage(buckets.select("bucket", "first")), "bucket").distinct())

    needed = cut_lineage(mates.select("key").distinct())
    texts = plain.join(broadcast_if_small(needed), "key", "left_semi")
    sets = cut_lineage(shingle_arrays(texts, words))
    links = cut_lineage(_compare(_stars(mates), sets, percent))
    groups = cut_lineage(components(links))
    more = _compare(_crossings(mates, groups), sets, percent)
    joined = cut_lineage(components(links.unionByName(more)))

    named = member.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "key", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.filter("n_shingles = 0 OR key IS NULL").select("key", "n_shingles", F.col("key").alias("component_id"))
    return named.unionByName(alone).select(
        F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

A shard holds the lists of some consecutive documents in blocks of ``BLOCK`` postings, each block compressed for itself.
Beside a block stand its pairs of occurrences and document length that no other pair of the block outdoes, so the largest
score of a block is exact for any corpus statistics, and an index stays usable when documents are added.

A query splits its lists by their bounds: documents that occur only in the lists with the least bounds, whose sum stays
below the score of the current k-th document, cannot rank. The other, essential lists give the candidates. On the remaining
lists the maxima of the blocks a candidate would be in reject it, or it is looked up in the blocks that survive; no other
block is decompressed. Each task keeps one heap for each query over all its shards, and Spark merges the heaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.llm.shared import lean, small_batches
from tablewright.llm.texts import hash_spans, slices, split_terms
from tablewright.session import scratch_path

BLOCK = 64  # postings of a block
SHARD_BYTES = 8 << 20  # text of a shard, about
QUERY_TERMS = 200_000  # distinct terms of the queries answered in one pass over the index
MERGE_SALTS = 64  # heaps of a query are merged in so many groups first

INDEX_SCHEMA = T.StructType([
    T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("df", T.ArrayType(T.IntegerType())),
    T.StructField("block_last", T.ArrayType(T.IntegerType())), T.StructField("block_end", T.ArrayType(T.LongType())),
    T.StructField("peak_end", T.ArrayType(T.LongType())), T.StructField("peak_tf", T.ArrayType(T.LongType())),
    T.StructField("peak_length", T.ArrayType(T.LongType())), T.StructField("postings", T.BinaryType())])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, lowest first, the high bit set on all but the last; and where each ends."""
    values = values.astype(np.int64)
    size = np.ones(len(values), dtype=np.int64)
    for shift in range(7, 63, 7):
        size += values >> shift > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size)[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    last = data < 128
    begin = np.append(0, np.flatnonzero(last)[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin) if len(data) else np.zeros(0, dtype=np.int64)


def build_shard(ids: pa.Array, data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> dict:
    """The index of some texts, as a row of ``INDEX_SCHEMA``; ``wanted``, sorted term hashes, leaves other terms out."""
    words = split_terms(data, bounds)
    lengths = words.counts()
    hashes, doc, at = words.hashes(), words.doc, np.arange(len(words.doc))
    if wanted is not None:
        near = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
        at = np.flatnonzero(wanted[near] == hashes) if len(wanted) else at[:0]
    has = np.flatnonzero(lengths)  # documents without a term are not part of the collection
    number = np.zeros(words.docs, dtype=np.int64)
    number[has] = np.arange(len(has))
    order = at[np.argsort(hashes[at], kind="stable")]  # by term, then by document
    h, d = hashes[order], number[doc[order]]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    h, d = h[first], d[first]
    term_first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else first
    df = np.diff(np.append(term_first, len(h)))
    raw = words.data.tobytes()
    spans = order[first[term_first]]
    terms = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[spans], words.ends[spans])]
    inside = np.arange(len(h)) - np.repeat(term_first, df)
    starts_block = inside % BLOCK == 0
    block_first = np.flatnonzero(starts_block)
    block = np.cumsum(starts_block) - 1
    gap = np.diff(d, prepend=0)
    gap[starts_block] = d[starts_block]
    packed, ends = pack(np.column_stack([gap, tf]).ravel())
    block_stop = np.append(block_first[1:], len(h)) if len(h) else first
    # the pairs of a block that no other outdoes: fewer words, or more occurrences than any shorter document has
    n = lengths[has][d] if len(h) else d
    rank = np.lexsort((-tf, n, block))
    level = tf[rank] + (block[rank].astype(np.int64) << 40)
    best = np.maximum.accumulate(level) if len(level) else level
    peak = rank[np.append(True, level[1:] > best[:-1])] if len(level) else rank
    return {"docs": ids.take(pa.array(has)), "lengths": lengths[has], "terms": terms, "df": df, "block_last": d[block_stop - 1],
            "block_end": ends[2 * block_stop - 1], "peak_end": np.cumsum(np.bincount(block[peak], minlength=len(block_first))),
            "peak_tf": tf[peak], "peak_length": n[peak], "postings": packed.tobytes()}


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The index of ``docs``, a row for each shard, written to ``path`` (else to the shared folder) and read again.

    Terms are the runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Each row is a document, also
    where keys repeat or are NULL; those without a term are left out. ``key`` must be an integer column. ``terms`` leaves other
    terms out of the lists, never out of the lengths. An empty table gives an index without rows. Terms are told apart by 64-bit
    hashes. No shuffle; a shard holds whole texts of about ``SHARD_BYTES`` or one longer text.
    """
    wanted = None if terms is None else term_hashes(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column("text"), SHARD_BYTES):
                row = build_shard(batch.column("key").slice(first, last - first), data, bounds, wanted)
                if len(row["docs"]):
                    yield pa.RecordBatch.from_arrays([_cell(row[f.name], t) for f, t in zip(INDEX_SCHEMA.fields, INDEX_TYPES)], names=INDEX_SCHEMA.names)

    path = path or scratch_path(docs.sparkSession, "index")
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    small_batches(texts).mapInArrow(lean(run), INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


INDEX_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), None]


def _cell(values: object, kind: pa.DataType | None) -> pa.Array:
    """One row: a binary value, or a list of ``kind``."""
    if kind is None:
        return pa.array([values], pa.binary())
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind))


def term_hashes(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([0, *map(len, raw)])
    return np.unique(hash_spans(np.frombuffer(b"".join(raw), dtype=np.uint8), ends[:-1], ends[1:]))


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count gives for each unit of a term's weight, in a document of ``length`` terms."""
    m = 75 + 25 * length.astype(np.int64) * n_docs // n_terms
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf + 12 * m)


class Shard:
    """A row of the index, with the scores of its blocks under the statistics of the whole collection."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        self.row, self.total = row, (n_docs, n_terms)
        df = row["df"].astype(np.int64)
        self.first = np.append(0, np.cumsum(df))  # postings of each list
        self.first_block = np.append(0, np.cumsum(-(-df // BLOCK)))
        self.n_blocks = int(self.first_block[-1])
        term = np.repeat(np.arange(len(df)), np.diff(self.first_block))
        self.block_from = self.first[term] + (np.arange(self.n_blocks) - self.first_block[term]) * BLOCK
        self.block_stop = np.append(self.block_from[1:], self.first[-1])
        self.last = term * len(row["docs"]) + row["block_last"]  # ascending over all lists
        peaks = impact(row["peak_tf"], row["peak_length"], n_docs, n_terms)
        self.peak = np.append(np.maximum.reduceat(peaks, np.append(0, row["peak_end"][:-1])) if len(peaks) else peaks, 0)
        self.highest = np.maximum.reduceat(self.peak, self.first_block[:-1]) if len(df) else peaks
        self.bytes = np.frombuffer(row["postings"], dtype=np.uint8)
        self.byte_from = np.append(0, row["block_end"][:-1])
        # what is decompressed stays for the other queries of the shard
        self.doc, self.value = np.full(self.first[-1] + BLOCK, -1), np.zeros(self.first[-1] + BLOCK, dtype=np.int64)
        self.opened = np.zeros(self.n_blocks, dtype=bool)

    def open(self, blocks: np.ndarray) -> None:
        """Decompress those of ``blocks``, ascending, that are not yet."""
        blocks = blocks[~self.opened[blocks]]
        if not len(blocks):
            return
        self.opened[blocks] = True
        size = self.row["block_end"][blocks] - self.byte_from[blocks]
        at = np.repeat(self.byte_from[blocks] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
        values = unpack(self.bytes[at])
        gap, tf = values[::2], values[1::2]
        count = self.block_stop[blocks] - self.block_from[blocks]
        begin = np.append(0, np.cumsum(count)[:-1])
        total = np.cumsum(gap)
        doc = total - np.repeat(total[begin] - gap[begin], count)  # a block's first gap is its document: sums restart there
        to = np.repeat(self.block_from[blocks] - begin, count) + np.arange(len(doc))
        self.doc[to], self.value[to] = doc, impact(tf, self.row["lengths"][doc], *self.total)

    def find(self, blocks: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The impact of each document in its block; 0 where it is not there."""
        self.open(np.unique(blocks))
        at = self.block_from[blocks][:, None] + np.arange(BLOCK)
        hit = (self.doc[at] == docs[:, None]) & (at < self.block_stop[blocks][:, None])
        return (self.value[at] * hit).sum(axis=1)


@dataclass
class Heap:
    """The ``k`` best documents so far: highest score, then least key."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @property
    def least(self) -> int:
        """The score below which no document can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.append(self.scores, scores), np.append(self.keys, keys)
        best = np.lexsort((keys, -scores))[:self.k]
        self.scores, self.keys = scores[best], keys[best]


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, heap: Heap, keys: np.ndarray) -> None:
    """Bring the documents of ``shard`` that rank for a query into ``heap``; ``terms`` are list numbers in the shard."""
    highest = weights * shard.highest[terms]
    order = np.argsort(highest, kind="stable")
    terms, weights = terms[order], weights[order]
    below = np.cumsum(highest[order])
    split = int(np.searchsorted(below, heap.least, side="left"))  # lists before it cannot lift a document into the heap
    if split == len(terms):
        return
    needed = terms[split:]
    shard.open(np.concatenate([np.arange(shard.first_block[t], shard.first_block[t + 1]) for t in np.sort(needed)]))
    sums = np.zeros(len(keys), dtype=np.int64)
    for t, w in zip(needed, weights[split:]):
        own = slice(shard.first[t], shard.first[t + 1])
        sums[shard.doc[own]] += w * shard.value[own]
    found = np.flatnonzero(sums >= heap.least - (below[split - 1] if split else 0))
    found = found[sums[found] > 0]
    bound = sums[found]
    if split and len(found):
        # the block of each remaining list that a candidate would be in, and what it adds at most
        block = np.searchsorted(shard.last, terms[:split, None] * len(keys) + found)
        block = np.where(block < shard.first_block[terms[:split] + 1][:, None], block, shard.n_blocks)
        top = weights[:split, None] * shard.peak[block]
        bound = bound + top.sum(axis=0)
        size, upto = 1, split
        while upto:  # lists with the highest bounds first; ever more at a time, as ever fewer candidates are left
            alive = bound >= heap.least
            if not alive.all():
                found, bound, block, top = found[alive], bound[alive], block[:, alive], top[:, alive]
            own = slice(max(upto - size, 0), upto)
            i, c = np.nonzero(top[own])
            if len(i):
                more = weights[own][i] * shard.find(block[own][i, c], found[c]) - top[own][i, c]
                np.add.at(bound, c, more)
            size, upto = 2 * size, own.start
    heap.add(bound[bound >= heap.least], keys[found[bound >= heap.least]])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            cell = batch.column(name)[i]
            if name == "postings":
                row[name] = cell.as_buffer()
            elif name == "terms":
                row[name] = cell.values
            else:
                values = cell.values
                row[name] = (values.fill_null(NO_KEY) if values.null_count else values).to_numpy()
        yield row


NO_KEY = np.iinfo(np.int64).max  # stands for a NULL key, which ranks after all others


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(key, term, times)`` for each distinct query."""
    runs = F.regexp_extract_all(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    asked = items.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    return asked.select("key", F.md5("text").alias("which"), F.explode(runs).alias("term")).groupBy("key", "which", "term").agg(F.count("*").alias("times"))


def asked_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> list[str] | None:
    """The distinct terms of all queries, if they are at most ``QUERY_TERMS``; else None, for an index of all terms."""
    terms = query_terms(items, key, text).select("term").distinct().limit(QUERY_TERMS + 1).collect()
    return sorted(r["term"] for r in terms) if len(terms) <= QUERY_TERMS else None


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * df + 1))).cast("bigint")


def search(index: DataFrame, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``(key, rank, doc, score)``: the ``k`` highest-scoring documents above 0 of each query, ties by ascending document.

    NULL and empty queries, and those whose terms occur nowhere, give no rows; a query that comes twice with the same text is
    answered once. A document with a NULL key ranks after others of its score. Any number of queries: ``QUERY_TERMS`` distinct
    terms are answered in one pass over the index, and more in as many passes as they need.
    """
    total = index.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("l")).first()
    asked = query_terms(items, key, text)
    parts = max(1, -(-asked.count() // QUERY_TERMS))
    key_type = items.schema[key].dataType
    answers = []
    for part in range(parts):
        own = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("key", "which"), F.lit(parts)) == part)
        lists = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
        held = lists.join(F.broadcast(own.select("term").distinct()), F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("df").alias("df"))
        # QUERY_TERMS rows at most, but for one query with more terms than that
        rows = own.join(held, "term").withColumn("weight", F.col("times") * weight(total["n"] or 0, F.col("df"))).orderBy("key", "which", "term").collect()
        answers.append(_search_part(index, rows, k, total["n"] or 0, total["l"] or 1, key, key_type, doc))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def _search_part(index: DataFrame, rows: list, k: int, n_docs: int, n_terms: int, key: str, key_type: T.DataType, doc: str) -> DataFrame:
    spark = index.sparkSession
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    at = {}
    for r in rows:
        at.setdefault((r["key"], r["which"]), []).append((number[r["term"]], r["weight"]))
    names = list(at)
    plan = spark.sparkContext.broadcast((vocabulary, [tuple(np.array(c, dtype=np.int64) for c in zip(*at[n])) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, queries = plan.value
        words = pa.array(words, pa.string())
        heaps = [Heap(k) for _ in queries]
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row, n_docs, n_terms)
                where = pc.index_in(words, value_set=row["terms"].cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
                for (terms, weights), heap in zip(queries, heaps):
                    here = where[terms]
                    if (here >= 0).any():
                        search_shard(shard, here[here >= 0], weights[here >= 0], heap, row["docs"])
        flat = [(q, int(d), int(s)) for q, heap in enumerate(heaps) for d, s in zip(heap.keys, heap.scores)]
        q, d, s = zip(*flat) if flat else ((), (), ())
        keys = pa.array(d, pa.int64(), mask=np.array(d, dtype=np.int64) == NO_KEY)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), keys, pa.array(s, pa.int64())], names=["q", "doc", "score"])

    heaps = small_batches(index).mapInArrow(lean(run), "q int, doc bigint, score bigint")
    ranked = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = Window.partitionBy("q", "salt").orderBy(*ranked)
    some = heaps.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(MERGE_SALTS))).withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*ranked))).filter(F.col("rank") <= k)
    asked = spark.createDataFrame([(i, n[0]) for i, n in enumerate(names)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField(key, key_type)]))
    return last.join(F.broadcast(asked), "q").select(key, "rank", F.col("doc").alias(doc), "score")


def search_sql(k: int = 20) -> str:
    """SQL for the ranking of ``documents`` by each item of ``benchmark``."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH words AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM lengths),
spread AS (SELECT doc_id, 75 + (25 * n * nd) // nt AS m FROM lengths, total),
held AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL),
asked AS (SELECT item_id, unnest({terms}) AS term FROM benchmark),
weights AS (SELECT item_id, term, count(*) * floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1)))::BIGINT AS w
            FROM asked JOIN held USING (term), total GROUP BY item_id, term, nd, df),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM weights JOIN counts USING (term) JOIN spread USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""

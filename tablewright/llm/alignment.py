"""Alignment of the tokens of two tokenizers over the same bytes, as an Arrow pipeline.

Texts are taken in blocks of bounded bytes. In a block, list arrays of ids are flattened beside the positions of their texts,
cumulative sums over the lengths of the token bytes give the offset at which each token ends, and a hash join on (text, end)
finds the offsets where tokens of both end. Those cut a text into groups; a join on the group gives the linked tokens, and
grouping gives each text's distinct pairs of ids and each block's partial counts. Spark merges the partial counts to the
number of documents that hold a pair, brings them back to the blocks, and each block adds them up for its texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import lean, small_batches, whole_groups
from tablewright.llm.texts import slices
from tablewright.session import scratch_path

BLOCK_BYTES = 1 << 20  # text of a block, about
PAIR_ROWS = 4_000_000  # linked pairs expanded at a time
LONG_RUN = 20_000
FILE_BLOCKS = 16  # blocks of a file: a reader takes the rows of a file's row group at once, and a row is some MB
TASK_BLOCKS = 8  # blocks of a task that adds up, about

EMPTY_PAIRS = pa.table({"doc": pa.array([], pa.int32()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "times": pa.array([], pa.int64())})
BLOCK_SCHEMA = ("block bigint, keys array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, "
                "pair_a array<int>, pair_b array<int>, pair_docs array<int>, link_end array<bigint>, link_pair array<int>, link_times array<int>")


@dataclass
class Tokenizer:
    """``encode`` gives the ids of texts; ``pieces`` holds the bytes of each id."""

    encode: Callable[[list[str]], list]
    pieces: pa.Array


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# fixed value: how byte-level vocabularies of this kind cut a text before merging
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file. Strings of special tokens inside a text are plain text.

    Where ids follow the order of the merges, as usual, tiktoken applies them, several times faster than the file's own library,
    which takes any other file, and texts with a run of ``LONG_RUN`` white space. Both give the same ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    import tiktoken
    import tokenizers

    tool = tokenizers.Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    alphabet = byte_alphabet()
    names = [tool.id_to_token(i) or "" for i in range(tool.get_vocab_size(with_added_tokens=True))]
    pieces = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names]
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    vocabulary = spec["model"]["vocab"]
    plain = {**spec["pre_tokenizer"], "trim_offsets": None} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True}
    fast = None
    if plain and spec["normalizer"] is None and [vocabulary["".join(m)] for m in merges] == list(range(256, 256 + len(merges))):
        fast = tiktoken.Encoding("bytes", pat_str=WORD_PATTERN, mergeable_ranks={pieces[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [encode_one(" " + t) for t in texts]

    def encode_one(text: str) -> list[int]:
        # its regular expressions end in a panic on very long runs of white space
        if fast is not None and (len(text) <= LONG_RUN or not re.search(rf"\s{{{LONG_RUN}}}", text)):
            return fast.encode_ordinary(text)
        return tool.encode(text, add_special_tokens=False).ids

    return Tokenizer(encode, pa.array(pieces, pa.large_binary()))


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Tokenizer:
    """A model of the sentencepiece library, which adds the space before a text itself."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(tool.get_piece_size()):
        name = tool.id_to_piece(i)
        pieces.append(bytes([int(name[3:5], 16)]) if tool.is_byte(i) else name.replace("\u2581", " ").encode())
    return Tokenizer(lambda texts: tool.encode(texts, num_threads=1), pa.array(pieces, pa.large_binary()))


def flat_ids(lists: list) -> tuple[pa.Array, np.ndarray]:
    """Ids of all texts, one after another, and where each text's end."""
    ends = np.cumsum([0, *map(len, lists)])
    return pa.array(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))), ends


def same_bytes(ids: pa.Array, ends: np.ndarray, pieces: pa.Array, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts' joined token bytes are ``data[bounds[i]:bounds[i + 1]]``, and the bytes of each token."""
    joined = pieces.take(ids)
    length = pc.binary_length(joined).to_numpy()
    at = np.append(0, np.cumsum(length))
    raw = joined.buffers()[2].to_pybytes() if len(joined) else b""
    same = [raw[at[a]:at[b]] == data[c:d] for a, b, c, d in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:])]
    return np.array(same, dtype=bool), length


def kept_lists(ids: pa.Array, ends: np.ndarray, length: np.ndarray, keep: np.ndarray) -> tuple[pa.ListArray, pa.Array]:
    """Lists of the texts in ``keep``, empty for others, and the bytes of their tokens."""
    size = np.where(keep, np.diff(ends), 0)
    token = pa.array(np.repeat(keep, np.diff(ends)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), ids.filter(token)), pa.array(length).filter(token)


def token_ends(lists: pa.ListArray, length: pa.Array) -> pa.Table:
    """A row for each token: its text, its id, its number, and the byte of the text at which it ends."""
    total = pc.cumulative_sum(pc.cast(length, pa.int64()))
    doc = pc.list_parent_indices(lists)
    # what ran up before a text began is taken off: a cumulative sum for each text
    start = lists.offsets.to_numpy()[:-1]
    before = pa.array(np.append(0, total.to_numpy())[start]) if len(lists) else pa.array([], pa.int64())
    return pa.table({"doc": doc.cast(pa.int32()), "id": lists.flatten().cast(pa.int32()), "end": pc.subtract(total, before.take(doc)),
                     "at": pa.array(np.arange(len(total), dtype=np.int64))})


def cut_groups(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of either side that end where one of the other ends too, ascending: the ends of the groups."""
    both = a.select(["doc", "end", "at"]).join(b.select(["doc", "end", "at"]).rename_columns(["doc", "end", "at_b"]), ["doc", "end"], join_type="inner", use_threads=False)
    left, right = np.sort(both["at"].to_numpy()), np.sort(both["at_b"].to_numpy())
    return left, right


def group_texts(ids: pa.ChunkedArray, cuts: np.ndarray) -> pa.Array:
    words = pc.cast(ids.combine_chunks(), pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, cuts + 1), pa.int32()), words), ",")


def linked_pairs(a: pa.Table, b: pa.Table, cuts_a: np.ndarray, cuts_b: np.ndarray) -> pa.Table:
    """``(doc, a, b, times)``: how often each text links a pair of ids. About ``PAIR_ROWS`` links are expanded at a time."""
    size_a, size_b = np.diff(np.append(-1, cuts_a)), np.diff(np.append(-1, cuts_b))
    group = np.arange(len(cuts_a))
    left = pa.table({"group": pa.array(np.repeat(group, size_a)), "doc": a["doc"], "a": a["id"], "times": pa.array(np.ones(len(a), dtype=np.int64))})
    right = pa.table({"group": pa.array(np.repeat(group, size_b)), "b": b["id"], "times_b": pa.array(np.ones(len(b), dtype=np.int64))})
    total, parts, first = np.cumsum(size_a * size_b), [], 0
    while first < len(total):
        last = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIR_ROWS, side="right")), first + 1)
        x = left.slice(int(cuts_a[first - 1]) + 1 if first else 0, int(size_a[first:last].sum()))
        y = right.slice(int(cuts_b[first - 1]) + 1 if first else 0, int(size_b[first:last].sum()))
        if size_a[first] * size_b[first] > PAIR_ROWS:  # one very long group: equal ids are one row before the join
            x = x.group_by(["group", "doc", "a"], use_threads=False).aggregate([("times", "sum")]).rename_columns(x.column_names)
            y = y.group_by(["group", "b"], use_threads=False).aggregate([("times_b", "sum")]).rename_columns(y.column_names)
        pairs = x.join(y, "group", join_type="inner", use_threads=False)
        times = pc.multiply(pairs["times"], pairs["times_b"])
        pairs = pairs.select(["doc", "a", "b"]).append_column("times", times)
        parts.append(pairs.group_by(["doc", "a", "b"], use_threads=False).aggregate([("times", "sum")]).rename_columns(EMPTY_PAIRS.column_names))
        first = last
    if len(parts) < 2:
        return parts[0] if parts else EMPTY_PAIRS
    return pa.concat_tables(parts).group_by(["doc", "a", "b"], use_threads=False).aggregate([("times", "sum")]).rename_columns(EMPTY_PAIRS.column_names)


def align_block(texts: list[str], first: Tokenizer, second: Tokenizer) -> dict:
    """Numbers of each text of a block, its groups' digest, and the block's distinct pairs with each text's links to them."""
    raw = [(" " + t).encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    data = b"".join(raw)
    full = np.array([bool(t) for t in texts], dtype=bool)
    sides = []
    for tool in (first, second):
        ids, ends = flat_ids(tool.encode(texts))
        same, length = same_bytes(ids, ends, tool.pieces, data, bounds)
        full &= same
        sides.append((ids, ends, length))
    lists = [kept_lists(*s, full) for s in sides]
    a, b = (token_ends(*s) for s in lists)
    cuts_a, cuts_b = cut_groups(a, b)
    docs = len(texts)
    group_doc = a["doc"].combine_chunks().take(pa.array(cuts_a)).to_numpy()
    n_groups = np.bincount(group_doc, minlength=docs)
    links = np.bincount(group_doc, np.diff(np.append(-1, cuts_a)) * np.diff(np.append(-1, cuts_b)).astype(float), minlength=docs).astype(np.int64)
    shown = pc.binary_join_element_wise(group_texts(a["id"], cuts_a), group_texts(b["id"], cuts_b), "|")
    shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)), pa.int32()), shown), ";")
    digests = [hashlib.sha256(t.encode()).hexdigest() if k else "" for t, k in zip(shown.to_pylist(), full)]
    pairs = linked_pairs(a, b, cuts_a, cuts_b)
    partial = pairs.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "docs"])
    partial = partial.append_column("pair", pa.array(np.arange(len(partial), dtype=np.int32)))
    of_doc = pairs.join(partial.select(["a", "b", "pair"]), ["a", "b"], join_type="inner", use_threads=False).sort_by("doc")
    per_doc = np.bincount(of_doc["doc"].to_numpy(), minlength=docs)
    return {"n_a": np.diff(lists[0][0].offsets.to_numpy()), "n_b": np.diff(lists[1][0].offsets.to_numpy()), "n_groups": n_groups, "n_links": links,
            "digests": digests, "pair_a": partial["a"], "pair_b": partial["b"], "pair_docs": partial["docs"],
            "link_end": np.cumsum(per_doc), "link_pair": of_doc["pair"], "link_times": of_doc["times"]}


def _list(values: object, kind: pa.DataType) -> pa.Array:
    flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind))


def align_blocks(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each block of texts: what ``align_block`` finds. Written to ``path`` (else to the shared folder) and read again.

    A block's number is made in the task that writes it; what is written does not change, so later stages can rely on it.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    names = ["block", "keys", "n_a", "n_b", "n_groups", "n_links", "digests", "pair_a", "pair_b", "pair_docs", "link_end", "link_pair", "link_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = byte_level(first), sentence_pieces(second)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, _, _ in slices(batch.column("text"), BLOCK_BYTES):
                found = align_block([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()], *tools)
                columns = [pa.array([number], pa.int64()), _list(batch.column("key").slice(a, b - a), pa.int64())]
                columns += [_list(found[n], k) for n, k in zip(names[2:], kinds)]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=names)
                pa.default_memory_pool().release_unused()

    path = path or scratch_path(docs.sparkSession, "aligned")
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    small_batches(texts).mapInArrow(lean(run), BLOCK_SCHEMA).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(a, b, docs, best)``: how many documents hold a pair linked, and whether no other pair of ``a`` is held by more."""
    rows = blocks.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("p"))
    counts = rows.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_docs").alias("docs"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of ``docs``.

    Byte offsets at which tokens of ``first`` (a byte-level BPE file) and ``second`` (a sentencepiece model file) both end cut a
    text into groups; tokens of a group are linked. A pair's count is the number of rows that hold it linked; ``n_best`` counts
    links whose pair has the highest count of its first id, ``count_sum`` adds up the counts over links. Texts that are NULL or
    empty, or that either tokenizer does not give back byte for byte, have zeros and an empty digest. Repeated rows count as
    documents of their own; NULL keys stay. ``key`` must be an integer column. Whole texts: a block holds about ``BLOCK_BYTES``
    of them, or one longer text.
    """
    blocks = align_blocks(docs, first, second, key, text)
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("pair", "p")).select("block", "pair", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    # pairs come back to their block in order and are packed one block after another; a task's batches hold few blocks however many there are
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // TASK_BLOCKS))
    held = asked.join(counts, ["a", "b"]).select("block", "pair", "docs", "best").repartition(tasks, "block").sortWithinPartitions("block", "pair")
    packed = small_batches(held).mapInArrow(lean(_packed), "block bigint, docs array<bigint>, best array<boolean>").repartition(tasks, "block")
    whole = blocks.drop("pair_a", "pair_b", "pair_docs").repartition(tasks, "block").join(packed, "block", "left").drop("block")
    return small_batches(whole).mapInArrow(lean(_summed), f"{key} bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, with what belongs to its pairs in their order."""
    for batch, heads in whole_groups(batches, ("block",)):
        ends = pa.array(np.append(heads, batch.num_rows), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, batch.column(n)) for n in ("docs", "best")]
        yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(heads)), *lists], names=["block", "docs", "best"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].values for n in batch.schema.names}
            pair, times = row["link_pair"].to_numpy(), row["link_times"].to_numpy().astype(np.int64)
            ends = np.append(0, row["link_end"].to_numpy())
            sums = []
            for name in ("best", "docs"):
                values = row[name].cast(pa.int64()).to_numpy() if len(pair) else times
                total = np.append(0, np.cumsum(times * values[pair] if len(pair) else times))
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([row["keys"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["digests"]],
                                             names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

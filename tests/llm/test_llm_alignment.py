"""Alignment of two tokenizers against plain loops over the bytes of each text."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tablewright.llm import alignment, queries

COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def byte_of():
    """The stated byte-level alphabet, written out as its definition."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table, extra = {}, 256
    for b in range(256):
        if b in shown:
            table[chr(b)] = b
        else:
            table[chr(extra)] = b
            extra += 1
    return table


@pytest.fixture(scope="module")
def tools():
    first = tokenizers.Tokenizer.from_file(queries.byte_model())
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def plain_groups(text, first, second, table):
    """Groups as pairs of id lists, or None."""
    if not text:
        return None
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(table[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    groups, i, j, x, y, begin = [], 0, 0, 0, 0, (0, 0)
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x, i = x + len(bytes_a[i]), i + 1
        else:
            y, j = y + len(bytes_b[j]), j + 1
        if x == y:
            groups.append((a[begin[0]:i], b[begin[1]:j]))
            begin = (i, j)
    return groups


def plain_alignment(docs, first, second):
    table, found = byte_of(), [(k, plain_groups(t, first, second, byte_of())) for k, t in docs]
    held = Counter()
    for _, groups in found:
        held.update({(p, q) for ga, gb in groups or [] for p in ga for q in gb})
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for key, groups in found:
        if groups is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((key, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links),
                    sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def rows(df):
    return sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [3_000, 1 << 20])
def test_alignment_equals_plain_loops(spark, sf, tools, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = plain_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], *tools)
    assert rows(queries.QUERIES["op11_alignment"](spark, sf)) == sorted(plain, key=str)


def test_odd_texts(spark, tools):
    texts = ["", None, "   ", "<|endoftext|> a <s> b </s> <0x41>", "a▁b", "\x00\x01", "naïve café 😀😀 漢字", "a\r\nb\tc", "word " * 50_000, " " * 60_000 + "x", "same same", "same same", "ﬁ ﬃ ½", "🏳️‍🌈" * 40]
    docs = [(i, t) for i, t in enumerate(texts)] + [(10, "same same"), (None, "lost key")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", *[F.lit(1).alias(n) for n in "key block keys pair a b docs best counts n_a link_end".split()])
    paths = queries.byte_model(), queries.piece_model()
    assert rows(alignment.align(table, *paths)) == sorted(plain_alignment(docs, *tools), key=str)
    assert rows(alignment.align(table.filter("false"), *paths)) == []


def test_very_long_group_is_grouped_before_the_join(monkeypatch):
    """Links of one group beyond the limit: equal ids become one row, and the counts stay those of all links."""
    monkeypatch.setattr(alignment, "PAIR_ROWS", 100)
    a = pa.table({"doc": pa.array([0] * 60, pa.int32()), "id": pa.array([1, 2] * 30, pa.int32())})
    b = pa.table({"doc": pa.array([0] * 40, pa.int32()), "id": pa.array([7] * 39 + [8], pa.int32())})
    found = alignment.linked_pairs(a, b, np.array([57, 59]), np.array([38, 39]))
    got = {(r["a"], r["b"]): r["times"] for r in found.to_pylist()}
    assert got == {(1, 7): 29 * 39, (2, 7): 29 * 39, (1, 8): 1, (2, 8): 1}


def test_fast_encoder_equals_the_files_own_library(tools):
    fast = alignment.byte_level(queries.byte_model()).encode
    texts = ["it's  we'll　x  y", "١٢٣ ⅷ 漢字かな", "tab\t\tnew\n\n line ", "é Ǆ ß", "'S 's 're'RE", "‍﻿\u0085 z"]
    assert fast(texts) == [tools[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_a_task_holds_few_blocks(spark, sf, monkeypatch):
    """Files, and the batches that are added up, hold a bounded number of blocks; a row of a block is some MB."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    paths = queries.byte_model(), queries.piece_model()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").coalesce(1)
    blocks = alignment.align_blocks(docs, *paths)
    files = [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 50 and max(files) <= alignment.FILE_BLOCKS
    found = alignment.align(docs, *paths)
    assert found.rdd.getNumPartitions() >= sum(files) // alignment.TASK_BLOCKS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and found.count() == docs.count()

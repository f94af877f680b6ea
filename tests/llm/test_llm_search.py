"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    """``{(item, rank): (doc, score)}`` by the formula, one document after another."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in set(items):
        scored = []
        for doc, bag in bags:
            m = 100 - 25 + 25 * sum(bag.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (None if doc == math.inf else doc, -score)
    return out


def results(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_numbers_packed_and_read_again():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 5], dtype=np.int64)
    packed, ends = search.pack(values)
    assert (search.unpack(packed) == values).all() and ends[-1] == len(packed) and list(ends[:4]) == [1, 2, 3, 5]
    assert len(search.unpack(packed[:0])) == 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([3, 20, 90, 400]))) for _ in range(1500)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[7]) for i in range(40)]  # forty ties
    items = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(30)] + [(30, texts[7]), (31, "w299 w298 nowhere")]
    return docs, items


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("shard", [20_000, 8 << 20])
def test_search_equals_plain_scoring(spark, corpus, monkeypatch, whole, shard):
    docs, items = corpus
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    index = search.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), terms=None if whole else search.asked_terms(asked))
    assert results(search.search(index, asked, 20)) == plain_search(docs, items, 20)


def test_search_in_several_passes(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(search, "QUERY_TERMS", 60)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert search.asked_terms(asked) is None
    index = search.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert results(search.search(index, asked, 5)) == plain_search(docs, items, 5)


def test_blocks_are_rejected_before_they_are_opened(corpus):
    """With a full heap, a query of a rare and a common term leaves most blocks of the common one closed."""
    rng = np.random.default_rng(1)
    texts = ["common " * int(rng.integers(1, 3)) + ("rare rare rare" if i % 1000 == 7 else "other") for i in range(20_000)]
    import pyarrow as pa

    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    row = search.build_shard(pa.array(range(len(texts))), np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    keys = np.arange(len(texts))
    shard = search.Shard(row, len(texts), int(row["lengths"].sum()))
    at = [row["terms"].index("common"), row["terms"].index("rare")]
    heap = search.Heap(10)
    search.search_shard(shard, np.array(at), np.array([1, 8000]), heap, keys)
    assert len(heap.keys) == 10
    shard.opened[:] = False
    search.search_shard(shard, np.array(at), np.array([1, 8000]), heap, keys)
    assert shard.opened[shard.first_block[at[0]]:shard.first_block[at[0] + 1]].mean() < 0.15


def test_odd_documents_and_queries(spark):
    long = "alpha " * 200_000 + "omega"
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, ""), (3, None), (4, "... --- \x01"), (5, long), (6, "Änderung ÄNDERUNG änderung"), (7, "ALPHA, Beta!")]
    items = [(1, "alpha omega alpha"), (2, None), (3, ""), (4, "nowhere"), (None, "beta"), (5, "änderung ÄNDERUNG"), (1, "alpha omega alpha")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", *[F.lit("x").alias(n) for n in "key docs terms q which rank score salt place df".split()])
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("y")).withColumn("weight", F.lit(1))
    index = search.build_index(table)
    assert results(search.search(index, asked)) == plain_search(docs, [i for i in items if i[1]], 20)
    none = search.build_index(table.filter("false"))
    assert search.search(none, asked).count() == 0 and search.search(index, asked.filter("false")).count() == 0

"""The queries of the corpus operators, over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import alignment, licenses, minhash, mixing, pages, pii, quality, repetition, search, sharding, subwords, toxicity, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The place of the SentencePiece model: ``PIECE_MODEL``, else that of the installed tokenizer files."""
    if path := os.environ.get("PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


KEEP_FROM = 0.3  # score from which a document counts as good


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """The fifth of the documents whose labels are never learnt from; or another share."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)) == part, F.lit(False))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


@query
def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def token_digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = subwords.encode_pieces(docs, piece_model()).drop("text")
    return token_digests(subwords.decode_pieces(ids, piece_model()))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot and shard among 64 shards."""
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", sharding.SHARDS)


ORACLES["op5_sharding"] = sharding.shard_sql()


@query
def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of 60 % of all tokens, of at most two epochs: one row for each document and epoch."""
    docs = table(spark, sf_dir, "documents").withColumn("n_tokens", mixing.word_count("text")).drop("text")
    levels = mixing.corpus_levels()
    mixed = mixing.mix_sources(docs, levels, mixing.WEIGHTS, percent=60, epochs=2, seed=1, tokens=F.col("n_tokens"))
    names = {n: F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()}
    return mixed.select("doc_id", *names.values(), "n_tokens", "epoch")


ORACLES["op8_mixing"] = mixing.mixture_sql(percent=60, epochs=2, seed=1)


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.withColumn("licenses", F.array_join("licenses", ","))


ORACLES["op10_licenses"] = licenses.license_sql()


def byte_model() -> str:
    """The place of the byte-level BPE file: ``BYTE_MODEL``, else that of the installed tokenizer files."""
    if path := os.environ.get("BYTE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), byte_model(), piece_model())


@query
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item; the index holds the lists of the items' terms."""
    items = table(spark, sf_dir, "benchmark")
    index = search.build_index(table(spark, sf_dir, "documents"), terms=search.asked_terms(items))
    return search.search(index, items)


ORACLES["op12_search"] = search.search_sql()


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out(parts=4, part=2)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~apart))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))

"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import minhash, mixing, pii, quality, subwords
from tablewright.llm.queries import KEEP_FROM, held_out, piece_model, table, token_digests
from tablewright.llm.shared import private_names
from tablewright.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out.

    NULL and empty texts are judged as texts without words, long ones whole; equal texts get equal verdicts.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(~held_out()))
    (score,) = private_names(docs.columns, "_score")
    return quality.score_quality(docs, model, score=score).filter(F.col(score) >= KEEP_FROM).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one row of each ``doc_id``. A row without an id stays."""
    kept = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return first.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data and secrets, in texts of any length. NULL and empty texts stay as they are."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """90 % of the tokens, in the shares of the target weights as far as one pass over each leaf can meet them.

    A NULL language or source is a leaf of its own; texts without words go with their place in the order, and rows of one id go together.
    """
    return mixing.mix_sources(docs, mixing.corpus_levels(), mixing.WEIGHTS, percent=90, epochs=1, seed=1).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, for each document. NULL and empty texts hold the end id only."""
    ids = subwords.encode_pieces(docs.select("doc_id", "text"), piece_model()).drop("text")
    return token_digests(subwords.decode_pieces(ids, piece_model()))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None  # classifier, signatures and tokens have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

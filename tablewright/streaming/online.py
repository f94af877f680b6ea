"""Scoring a stream and keeping k-means centres up to date on one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.kmeans import CenterModel, update_centers
from tablewright.session import scratch_path


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply a scorer to a stream and append the result as parquet; stateless, so any batch size works."""
    return (score(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def score_available(spark: SparkSession, stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score everything the stream holds now and return what was written."""
    target = scratch_path(spark, "scored")
    score_stream(stream, score, target, scratch_path(spark, "scored-progress")).awaitTermination()
    return spark.read.parquet(target)


def _saved_centers(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, CenterModel] | None:
    """The centres after the last micro-batch, or after the last one before a given number."""
    try:
        saved = spark.read.schema("features array<string>, k int, center array<double>, weight double, batch bigint").parquet(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    if before is not None:
        saved = saved.filter(F.col("batch") < before)
    last = saved.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    rows = saved.filter(F.col("batch") == last).orderBy("k").collect()  # one row a centre
    return last, CenterModel(list(rows[0]["features"]), [list(r["center"]) for r in rows], [r["weight"] for r in rows])


def update_on_stream(stream: DataFrame, model: CenterModel, checkpoint: str) -> CenterModel:
    """Mini-batch k-means over the micro-batches available now; returns the moved centres.

    Each micro-batch is aggregated on the executors; the centres, a few numbers per cluster, are written beside the stream's
    checkpoint under the number of the batch before it is committed. A restart goes on from the last of them, and a batch
    that is run again starts from the centres before it, so it counts once.
    """
    spark, folder = stream.sparkSession, f"{checkpoint.rstrip('/')}-centers"
    at, current = _saved_centers(spark, folder) or (-1, model)
    state = {"at": at, "model": current}

    def absorb(batch: DataFrame, number: int) -> None:
        if number <= state["at"]:
            state["at"], state["model"] = _saved_centers(spark, folder, number) or (-1, model)
        moved = update_centers(state["model"], batch)
        rows = [(list(moved.features), k, [float(v) for v in c], float(w)) for k, (c, w) in enumerate(zip(moved.centers, moved.weights))]
        spark.createDataFrame(rows, "features array<string>, k int, center array<double>, weight double").coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/batch={number}")
        state["at"], state["model"] = number, moved

    query = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state["model"]

"""Session helpers: building a session, shared scratch space, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tablewright", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one machine, falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: bounds the plan of a loop and survives a lost executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


ROWS_A_TASK = 50_000


def spread(df: DataFrame, each: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt over so many partitions that a task holds about ``each`` rows; up to that many rows stay as they are.

    A small file, or one with a single row group, is read by one task, and whatever is iterated over its rows would stay there.
    """
    wanted = -(-df.count() // each)
    return df if wanted <= 1 else df.repartition(wanted)


def fits_broadcast(rows: int, columns: int = 2, limit_mb: int = 64, text_bytes: int = 0) -> bool:
    """Size check behind every explicit broadcast: ``rows`` and, where cells are texts, ``text_bytes`` must be measured."""
    return rows * max(columns, 1) * 32 + 2 * text_bytes <= limit_mb * 1024 * 1024

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 500_000  # about 100 MB as a hashed table

# Runtime settings the operators rely on; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages may be large or small: Arrow batches are bounded in bytes, so a Python worker holds few large ones.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "shelfwatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, on storage every executor can reach.

    The cluster names that storage in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder; elsewhere a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="shelfwatch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def joinable(counted: DataFrame, part: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``counted``, a table that is quickly counted, or ``part`` of it as a join's side: up to ``rows`` rows the optimizer may
    broadcast it, more are joined by sorting, as the size of packed files says little of the memory that rows take in the driver."""
    part = counted if part is None else part
    return part if counted.count() <= (BROADCAST_ROWS if rows is None else rows) else part.hint("merge")

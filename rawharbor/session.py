"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Sized for a cluster; everything here can be overridden by the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str = "rawharbor", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster
    a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="rawharbor-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, never used path below the shared folder."""
    return os.path.join(shared_dir(spark), "rawharbor", f"{label}-{uuid.uuid4().hex}")


# Rows and bytes of one Arrow batch between the JVM and a Python worker: long texts
# must not add up to gigabytes in a worker.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare_python(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound their batches unless the user has."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    for key, value in ARROW_BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table held in the plan itself. Its size is then known before the query
    runs, so a join with it needs neither a hint nor a shuffle of the other side."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(fields))]
    return spark.createDataFrame(pa.table(arrays, names=fields.names), fields)

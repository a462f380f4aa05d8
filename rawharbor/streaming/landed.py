"""Incremental load of landed CSV files, one file group per micro-batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rawharbor.operators.quality import MAX_NULL_DENSITY, assess, null_counts
from rawharbor.plans.layout import RAW_CSV_READ
from rawharbor.sources.delimited import QUOTING


def load_landed(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    table: str,
    checkpoint: str,
    files_per_batch: int = 100,
    threshold: float = MAX_NULL_DENSITY,
    multiline: bool = True,
) -> StreamingQuery:
    """Load whatever has landed, then stop; run again to load what is new.

    A batch overwrites its own ``batch=<id>`` folder and verdict, so a batch that
    is delivered again replaces itself and no row is lost or doubled. The gate
    reads the columnar copy, not the CSV a second time.
    """
    rows_dir, verdicts_dir = os.path.join(table, "rows"), os.path.join(table, "verdicts")

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        target = os.path.join(rows_dir, f"batch={batch_id}")
        batch.write.mode("overwrite").parquet(target)
        copied = session.read.schema(schema).parquet(target)
        verdict = assess(null_counts(copied), threshold).drop("profile")
        verdict.write.mode("overwrite").parquet(os.path.join(verdicts_dir, f"batch={batch_id}"))

    stream = (
        spark.readStream.schema(schema)
        .options(**QUOTING, **RAW_CSV_READ)
        .option("multiLine", multiline)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(source)
    )
    return (
        stream.writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_verdicts(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(table, "verdicts"))


def read_accepted(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the batches that passed; other batch folders are not read."""
    rows = spark.read.parquet(os.path.join(table, "rows"))
    passed = read_verdicts(spark, table).where(F.col("status") == "passed").select("batch")
    return rows.join(passed, "batch", "left_semi")

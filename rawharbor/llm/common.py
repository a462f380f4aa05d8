"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawharbor.operators.joins import join_reduced
from rawharbor.session import fresh_dir, small_table

#: A word, in every operator: the longest run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and row ids or
    partition ids made before stay what they are if an executor is lost."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then all second ones, and so on: high bytes compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(content: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(content, np.uint8).reshape(width, -1).T).view(kind).ravel()


#: Rows up to which a reduced table becomes part of the plan.
ROWS_IN_PLAN = 10_000


def encoded(value: Column) -> Column:
    """A text key that keeps null apart from every text."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), value.cast("string")))


def attach(rows: DataFrame, reduced: DataFrame, key: str) -> DataFrame:
    """Left join of wide rows to a table with one row per key.

    Up to ``ROWS_IN_PLAN`` rows are fetched and put into the plan, so that the wide
    rows are not shuffled; more are joined by a shuffle that splits hot keys.
    """
    few = reduced.limit(ROWS_IN_PLAN + 1).collect()
    if len(few) > ROWS_IN_PLAN:
        return join_reduced(rows, reduced, [key], "left")
    table = small_table(rows.sparkSession, [tuple(r) for r in few], reduced.schema.simpleString()[7:-1])
    return rows.join(table, key, "left")


def running_total(values: Column, combine) -> Column:
    """Prefix totals of an array by an associative function, first value first.

    Arrays are immutable, so appending one by one costs the square of the length.
    Blocks of 256 are totalled on their own and then raised by what stands before.
    """
    block = 256

    def append(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.when(last.isNull(), x).otherwise(combine(last, x))))

    empty = F.array().cast("array<bigint>")

    def scan(array):
        return F.aggregate(array, empty, append)

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0))),
        lambda b: scan(F.slice(values, b * block + 1, block)),
    )
    before = scan(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0).cast("bigint"))))
    raised = F.zip_with(
        blocks,
        F.concat(F.array(F.lit(None).cast("bigint")), before),
        lambda b, base: F.when(base.isNull(), b).otherwise(F.transform(b, lambda x: combine(base, x))),
    )
    return F.flatten(F.filter(raised, lambda b: b.isNotNull()))

"""Joins of rows whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.functions.nulls import column


def join_reduced(rows: DataFrame, reduced: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows to a side that an aggregate has reduced to one row per key.

    A small reduced side is broadcast. A large one is sort-merged, and then a hot
    key can be split at run time only if both sides are shuffled for the join. An
    aggregate's output is not: it already lies by key, so all rows of a hot key
    would have to come to it. A hash of the keys as one more join column makes the
    planner move the reduced side once more, which lets it split the other.
    """
    if any(rows.schema[k].dataType != reduced.schema[k].dataType for k in keys):
        raise TypeError(f"keys differ in type, so would their hashes: {list(keys)}")
    hashed = F.xxhash64(*[column(k) for k in keys])
    name, taken = "_hash", {c.lower() for c in rows.columns + reduced.columns}
    while name in taken:
        name = "_" + name
    return rows.withColumn(name, hashed).join(reduced.withColumn(name, hashed), [*keys, name], how).drop(name)

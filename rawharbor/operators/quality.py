"""Null counts, the null-density gate and the outcome of a batch.

One grouped aggregate with map-side partial counts feeds all of it, so a hot
dataset costs each task one counter row, whatever its share of the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.functions.nulls import is_missing
from rawharbor.functions.text import percent_text
from rawharbor.operators.joins import join_reduced

MAX_NULL_DENSITY = 0.8
# Generated aggregate code stays compilable; wider tables take several passes,
# each of which reads only its own columns.
COLUMNS_PER_PASS = 400


def null_counts(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``by..., rows, profile`` where profile is ``array<struct<ordinal, column, nulls>>``."""
    names = [c for c in df.columns if c not in by] if columns is None else list(columns)
    if len(names) <= COLUMNS_PER_PASS:
        return _count_pass(df, by, names, 1)
    passes = [
        _count_pass(df, by, names[i : i + COLUMNS_PER_PASS], i + 1) for i in range(0, len(names), COLUMNS_PER_PASS)
    ]
    return (
        reduce(DataFrame.unionByName, passes)
        .groupBy(*by)
        .agg(F.max("rows").alias("rows"), F.sort_array(F.flatten(F.collect_list("profile"))).alias("profile"))
    )


def _count_pass(df: DataFrame, by: Sequence[str], names: Sequence[str], first: int) -> DataFrame:
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"_nulls{i}") for i, c in enumerate(names)],
    )
    entries = [
        F.struct(
            F.lit(first + i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"_nulls{i}").alias("nulls")
        )
        for i, c in enumerate(names)
    ]
    profile = F.array(*entries) if entries else F.expr("cast(array() as array<struct<ordinal:int,column:string,nulls:bigint>>)")
    return counted.select(*by, "rows", profile.alias("profile"))


def assess(counts: DataFrame, threshold: float = MAX_NULL_DENSITY) -> DataFrame:
    """Add ``nulls, columns, density, status, message`` to null counts.

    No rows or no columns is ``empty``; a density strictly above the threshold is
    ``rejected``; everything else has ``passed``.
    """
    nulls = F.aggregate("profile", F.lit(0).cast("bigint"), lambda total, entry: total + entry["nulls"])
    width = F.size("profile")
    cells = F.col("rows") * F.col("columns")
    blank = F.coalesce(cells, F.lit(0)) == 0
    sized = counts.withColumns({"nulls": nulls, "columns": width})
    rated = sized.withColumn("density", F.when(~blank, F.col("nulls") / cells))
    status = (
        F.when(F.col("density").isNull(), "empty").when(F.col("density") > threshold, "rejected").otherwise("passed")
    )
    message = F.when(F.col("status") == "empty", F.lit("dataset is completely empty")).when(
        F.col("status") == "rejected",
        F.concat(F.lit(f"null density exceeds {threshold:.0%} ("), percent_text(F.col("density")), F.lit(")")),
    )
    return rated.withColumn("status", status).withColumn("message", message)


def gate(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str] | None = None,
    threshold: float = MAX_NULL_DENSITY,
    expected: DataFrame | None = None,
) -> DataFrame:
    """One verdict per dataset. ``expected`` lists the datasets that should exist,
    so that one without a single row is reported as empty instead of vanishing."""
    verdicts = assess(null_counts(df, by, columns), threshold)
    if expected is None:
        return verdicts.drop("profile")
    joined = expected.select(*by).distinct().join(verdicts.drop("profile"), list(by), "left")
    return joined.withColumns(
        {
            "rows": F.coalesce("rows", F.lit(0)),
            "nulls": F.coalesce("nulls", F.lit(0)),
            "columns": F.coalesce("columns", F.lit(0)),
            "status": F.coalesce("status", F.lit("empty")),
            "message": F.when(F.col("status").isNull(), F.lit("dataset is completely empty")).otherwise(F.col("message")),
        }
    )


def keep_passed(df: DataFrame, verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of the datasets that passed."""
    return join_reduced(df, verdicts.where(F.col("status") == "passed").select(*by), by, "left_semi")


def outcome(verdicts: DataFrame) -> DataFrame:
    """Totals of a batch; one bad dataset never hides the good ones."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("datasets"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "rejected", "empty")],
    )


def require_success(verdicts: DataFrame) -> int:
    """The number of datasets that passed; none at all is an error."""
    passed = outcome(verdicts).first()["passed"]
    if not passed:
        raise ValueError("no dataset passed")
    return passed

"""Checks that nothing was lost, doubled, changed or overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.functions.nulls import column
from rawharbor.functions.text import topic_slug
from rawharbor.session import small_table


# Fingerprints that two tables are compared by first; each is one row of five numbers.
BUCKETS = 1 << 16


def _row_hashes(columns: Sequence[Column]) -> list[Column]:
    """Two hashes of a row; a hash passes over nulls, so where they stand is hashed too."""
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit("second"), *columns, nulls)]


def differing_buckets(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Numbers of the buckets of rows in which two tables of the same columns differ as bags.

    A bucket's fingerprint is its number of rows and the sums of both halves of two hashes of
    them, so neither order nor repetition matters, and a table is combined to one row
    per bucket before anything is shuffled.
    """
    names, half = left.columns, F.lit((1 << 32) - 1)

    def prints(df: DataFrame, sign: int) -> DataFrame:
        first, second = _row_hashes([column(c) for c in names])
        rows = df.select(first.alias("a"), second.alias("b"))
        parts = [F.col(h).bitwiseAND(half) for h in "ab"] + [F.shiftrightunsigned(h, 32) for h in "ab"] + [F.lit(1).cast("bigint")]
        sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]
        counted = rows.groupBy(F.pmod("a", F.lit(buckets)).cast("int").alias("bucket")).agg(*sums)
        return counted.select("bucket", *[(F.col(f"s{i}").cast("decimal(38,0)") * sign).alias(f"s{i}") for i in range(len(parts))])

    both = prints(left, 1).unionByName(prints(right, -1)).groupBy("bucket").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)])
    return [r["bucket"] for r in both.where(" OR ".join(f"s{i} <> 0" for i in range(5))).select("bucket").collect()]


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``surplus`` = copies left - right.
    Tables whose columns differ in name or type are an error, in whatever order they stand.

    Fingerprints of buckets of rows are compared first, which shuffles one row per bucket;
    only rows of buckets that differ are read again and shuffled. Both directions
    come from that one shuffle, and copies are summed before it, so a row that is
    repeated very often is moved once per task. Tables that differ go unnoticed only where
    the sums of two 64-bit hashes and the numbers of rows agree.
    """
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise ValueError(f"columns differ: {sorted(set(left.dtypes) ^ set(right.dtypes))}")
    columns = [column(c) for c in left.columns]
    right = right.select(*columns)
    differing = small_table(left.sparkSession, [(b,) for b in differing_buckets(left, right)], "_bucket int")
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    bucket = F.pmod(_row_hashes(columns)[0], F.lit(BUCKETS)).cast("int")
    return (
        signed.withColumn("_bucket", bucket)
        .join(differing, "_bucket", "left_semi")
        .groupBy(*columns)
        .agg(F.sum("_sign").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def slug_collisions(df: DataFrame, query: Column) -> DataFrame:
    """Slugs that more than one query would write to."""
    named = df.select(query.alias("_query"))
    distinct = named.where(F.col("_query").isNotNull()).distinct()
    return (
        distinct.groupBy(topic_slug(F.col("_query")).alias("slug"))
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.min("_query").alias("first_query"),
            F.max("_query").alias("last_query"),
        )
        .where(F.col("queries") > 1)
    )

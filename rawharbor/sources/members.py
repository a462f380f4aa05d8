"""Listings of landed file trees; file contents are never read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where tabular files of a code repository are looked for.
DATA_FOLDERS = ("/data/", "/datasets/", "/raw/")
TABULAR_SUFFIXES = (".csv", ".xlsx")


def csv_members(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """``path, size`` of every ``*.csv`` below the root, hidden paths skipped.

    Only ``path`` and ``length`` are selected, so ``content`` is pruned from the scan.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
    )
    return listing.select("path", F.col("length").alias("size"))


def in_data_folder(path: Column) -> Column:
    folders = "|".join(DATA_FOLDERS)
    suffixes = "|".join(s.replace(".", r"\.") for s in TABULAR_SUFFIXES)
    return F.rlike(path, F.lit(f"(?:{folders})")) & F.rlike(path, F.lit(f"(?:{suffixes})$"))


def user_table(name: Column, system_prefix: str = "dolt_") -> Column:
    """False for a system table."""
    return ~F.startswith(name, F.lit(system_prefix))

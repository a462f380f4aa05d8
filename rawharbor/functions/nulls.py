"""What counts as a missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The spellings a raw CSV scan reads as a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def column(name: str) -> Column:
    """A column by its literal name, which may hold dots and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL or, for floating columns, NaN."""
    value = column(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def presence(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every column but those to keep as true, or null where its value is missing. What counts
    nulls behind a join then moves one bit per value instead of whole texts."""
    return df.select(*[column(c) if c in keep else F.when(~is_missing(df, c), F.lit(True)).alias(c) for c in df.columns])


def na_to_null(value: Column) -> Column:
    """Turn the textual missing-value spellings of a string column into NULL."""
    return F.when(~value.isin(*NA_TOKENS), value)

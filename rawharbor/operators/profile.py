"""Data dictionary, display widths and column types, one aggregate pass each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rawharbor.functions.nulls import column, is_missing
from rawharbor.functions.text import float_text
from rawharbor.operators.quality import null_counts

MAX_WIDTH = 100
COLUMNS_PER_PASS = 100
# Spellings taken for each type; a suffix such as 1d or 1f is text, not a number.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
FLOATING = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(?:inity)?\s*$"
LONG_BIT, DOUBLE_BIT, BOOLEAN_BIT, TEXT_BIT, LARGE_BIT = 1, 2, 4, 8, 16
LARGE = "decimal(38,0)"
BOOLEAN = r"^(?:true|True|TRUE|false|False|FALSE)$"


def data_dictionary(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``by..., ordinal, column, nulls, rows, columns`` in schema order."""
    counts = null_counts(df, by, columns)
    return counts.select(
        *by, "rows", F.size("profile").cast("bigint").alias("columns"), F.inline("profile")
    ).select(*by, F.col("ordinal").cast("bigint").alias("ordinal"), "column", "nulls", "rows", "columns")


def render_dictionary(dictionary: DataFrame, topic: Column, by: Sequence[str] = ()) -> DataFrame:
    """One description text per dataset; as long as the dataset has columns, not rows."""
    line = F.concat(F.lit("- "), F.col("column"), F.lit(" (Nulls: "), F.col("nulls").cast("string"), F.lit(")"))
    gathered = dictionary.groupBy(*by).agg(
        F.max("rows").alias("rows"),
        F.max("columns").alias("columns"),
        F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Dataset Topic: "), topic),
        F.concat(F.lit("Total Rows: "), F.col("rows").cast("string")),
        F.concat(F.lit("Total Columns: "), F.col("columns").cast("string")),
        F.lit("Format: Raw CSV"),
        F.lit(""),
        F.lit("Columns present:"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
    )
    return gathered.select(*by, text.alias("value"))


def column_widths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``ordinal, column, width``: longest printed value or header plus 2, at most 100.

    A missing number prints as ``nan`` and makes the whole column print as floats;
    a missing text prints as ``None``, as does every value of an all-missing column.
    Booleans print as the 0 and 1 that a SQL table keeps of them.
    """
    return in_passes(df, df.columns if columns is None else list(columns), _width_pass)


def _width_pass(df: DataFrame, names: Sequence[str], first: int) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~is_missing(df, c)).alias(f"_present{i}") for i, c in enumerate(names)],
        *[F.max(F.length(_printed(df, c))).alias(f"_longest{i}") for i, c in enumerate(names)],
    )
    entries = []
    for i, name in enumerate(names):
        kind = df.schema[name].dataType
        present, longest = F.col(f"_present{i}"), F.coalesce(F.col(f"_longest{i}"), F.lit(0))
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            with_gaps = F.greatest(longest + 2, F.lit(3))
        elif isinstance(kind, T.NumericType):
            with_gaps = F.greatest(longest, F.lit(3))
        else:
            with_gaps = F.greatest(longest, F.lit(4))
        data = (
            F.when(F.col("_rows") == 0, F.lit(0))
            .when(present == 0, F.lit(4))
            .when(present < F.col("_rows"), with_gaps)
            .otherwise(longest)
        )
        width = F.least(F.greatest(data, F.lit(len(name))) + 2, F.lit(MAX_WIDTH))
        entries.append(_entry(first + i, name, width.alias("width")))
    return counted.select(F.inline(F.array(*entries)))


def in_passes(df: DataFrame, names: Sequence[str], one_pass) -> DataFrame:
    """One aggregate for a table of usual width; a wider one is split by columns,
    as generated code has a size limit, and each pass reads only its own columns."""
    starts = range(0, max(len(names), 1), COLUMNS_PER_PASS)
    return reduce(
        DataFrame.unionByName, [one_pass(df, names[i : i + COLUMNS_PER_PASS], i + 1) for i in starts]
    )


def _entry(ordinal: int, name: str, *values: Column) -> Column:
    return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("column"), *values)


def _printed(df: DataFrame, name: str) -> Column:
    value = column(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), float_text(value))
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return value.cast("int").cast("string")
    return value.cast("string")


def infer_types(text: DataFrame) -> DataFrame:
    """``ordinal, column, type`` for a table of strings: the narrowest of bigint,
    decimal(38,0), double and boolean that reads every present value, else string.
    Whole numbers beyond bigint are never read as doubles, which would lose digits."""
    return in_passes(text, text.columns, _type_pass)


def _type_pass(text: DataFrame, names: Sequence[str], first: int) -> DataFrame:
    # A value is looked at once and leaves one bit; the bits seen decide the type.
    bits = [_type_bit(column(name)).alias(f"_bit{i}") for i, name in enumerate(names)]
    seen = text.select(*bits).agg(*[F.bit_or(f"_bit{i}").alias(f"_bits{i}") for i in range(len(names))])
    entries = []
    for i, name in enumerate(names):
        found = F.col(f"_bits{i}")
        kind = (
            F.when(found == LONG_BIT, "bigint")
            .when(found.isin(LARGE_BIT, LONG_BIT | LARGE_BIT), LARGE)
            .when(found.isin(DOUBLE_BIT, LONG_BIT | DOUBLE_BIT), "double")
            .when(found == BOOLEAN_BIT, "boolean")
            .otherwise("string")
        )
        entries.append(_entry(first + i, name, kind.alias("type")))
    return seen.select(F.inline(F.array(*entries)))


def _type_bit(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(F.rlike(value, F.lit(WHOLE)) & F.trim(value).try_cast("bigint").isNotNull(), LONG_BIT)
        .when(F.rlike(value, F.lit(WHOLE)), F.when(F.trim(value).try_cast(LARGE).isNotNull(), LARGE_BIT).otherwise(TEXT_BIT))
        .when(F.rlike(value, F.lit(FLOATING)), DOUBLE_BIT)
        .when(F.rlike(value, F.lit(BOOLEAN)), BOOLEAN_BIT)
        .otherwise(TEXT_BIT)
    )

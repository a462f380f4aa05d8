"""Where raw datasets and their descriptions are written, and how."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rawharbor.functions.nulls import column
from rawharbor.functions.text import float_text, host_key, topic_slug
from rawharbor.operators.profile import data_dictionary, render_dictionary

# Nothing about a value may change on its way to disk: quotes are doubled, outer
# blanks stay and timestamps keep their microseconds.
RAW_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
# Overwrite the folders that are written, leave those of other datasets alone.
ONLY_OWN_FOLDERS = {"partitionOverwriteMode": "dynamic"}
RAW_CSV_READ = {key: RAW_CSV[key] for key in ("timestampFormat", "timestampNTZFormat")}


def dataset_dir(outdir: str, dir_name: str, topic: str, root: str = "datasets", file_format: str = "csv") -> str:
    """``<outdir>/<root>/<source>/<FORMAT>/<topic>`` for a single dataset."""
    slug = re.sub(r"[^a-zA-Z0-9_-]+", "_", topic).lower()
    return os.path.join(outdir, root, dir_name, file_format.upper(), slug)


def printed(df: DataFrame) -> DataFrame:
    """A double as the shortest text that reads back as it, without a needless exponent; one
    that is no number is an empty field, as a missing one is."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType)]
    shown = {c: F.when(~F.isnan(column(c)), float_text(column(c))) for c in doubles}
    shown |= {c: F.when(~F.isnan(column(c)), column(c)) for c in floats}
    return df.select(*[shown.get(c, column(c)).alias(c) for c in df.columns])


def write_raw(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Overwrite a folder of raw CSV part files."""
    writer = printed(df).write.mode("overwrite").options(**RAW_CSV)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_raw_batch(df: DataFrame, outdir: str, source: str, topic: str, file_format: str = "csv") -> None:
    """Write many datasets of one schema below ``source=/format=/topic=`` folders.

    Rows are rebalanced on the folder columns, so a small dataset is one file and
    one that holds much of the input is split over many tasks.
    """
    partitions = ["source", "format", "topic"]
    kept = [c for c in df.columns if c not in (source, topic)]
    if clash := set(kept) & set(partitions):
        raise ValueError(f"columns named like a folder level: {sorted(clash)}")
    shaped = df.select(
        *kept,
        host_key(F.col(source)).alias("source"),
        F.lit(file_format.upper()).alias("format"),
        topic_slug(F.col(topic)).alias("topic"),
    )
    writer = printed(shaped).hint("rebalance", *partitions).write.mode("overwrite").options(**RAW_CSV, **ONLY_OWN_FOLDERS)
    writer.partitionBy(*partitions).csv(outdir)


def write_description(df: DataFrame, path: str, topic: str, by: Sequence[str] = ()) -> None:
    """Write the data dictionary as text, in a ``by=`` folder for each dataset."""
    text = render_dictionary(data_dictionary(df, by), F.lit(topic), by)
    writer = text.write.mode("overwrite")
    (writer.options(**ONLY_OWN_FOLDERS).partitionBy(*by) if by else writer).text(path)


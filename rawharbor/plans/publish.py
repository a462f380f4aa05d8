"""From a raw CSV to a SQL table and its export, whole or capped."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawharbor.functions.nulls import column
from rawharbor.functions.text import dataset_name, sheet_name
from rawharbor.operators.profile import column_widths
from rawharbor.operators.ranking import EXPORT_CAP, capped, numbered
from rawharbor.plans.layout import RAW_CSV, printed, write_raw
from rawharbor.sources.delimited import scan_csv_inferred


def publish_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Replace a table, a managed one unless a path is given; the column types come
    from the whole dataset."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def export_sheets(df: DataFrame, path: str, keys: Sequence[str], rows_per_sheet: int = EXPORT_CAP) -> int:
    """Write all rows as numbered, sorted CSV sheets of at most ``rows_per_sheet`` rows, one
    file each in a ``sheet=`` folder, beside their display widths. Returns their number."""
    placed = numbered(df, keys, "_rank").withColumn("sheet", F.floor(F.col("_rank") / rows_per_sheet) + 1)
    sheets = placed.repartition("sheet").sortWithinPartitions("sheet", "_rank").drop("_rank")
    printed(sheets).write.mode("overwrite").options(**RAW_CSV).partitionBy("sheet").csv(os.path.join(path, "rows"))
    write_raw(column_widths(df).repartition(1), os.path.join(path, "widths"))
    return placed.agg(F.coalesce(F.max("sheet"), F.lit(0))).first()[0]


def export(df: DataFrame, path: str, keys: Sequence[str], cap: int) -> bool:
    """Write at most ``cap`` rows as one sorted CSV file beside their display widths,
    and say whether rows were left out. The single file is bounded by the cap."""
    rows = capped(df, keys, cap)
    truncated = rows.select("truncated").limit(1).collect()
    sheet = rows.drop("truncated").repartition(1).sortWithinPartitions(*[column(k) for k in keys])
    write_raw(sheet, os.path.join(path, "rows"))
    write_raw(column_widths(sheet).repartition(1), os.path.join(path, "widths"))
    return bool(truncated and truncated[0]["truncated"])


def publish(
    spark: SparkSession, csv_path: str, keys: Sequence[str], table: str | None = None, outdir: str | None = None
) -> dict:
    """Load a raw CSV into a table named after it and export that table, all of its rows.

    A missing path fails in the scan, a CSV without a row is an error.
    """
    named = spark.range(1).select(dataset_name(F.lit(csv_path.rstrip("/"))).alias("n"))
    name = table or named.first()["n"]
    sheet = spark.range(1).select(sheet_name(F.lit(name))).first()[0]
    rows = scan_csv_inferred(spark, csv_path, stage=True)
    if rows.isEmpty():
        raise ValueError(f"CSV is empty: {csv_path}")
    publish_table(rows, f"`{name}`")
    target = os.path.join(outdir or os.path.dirname(csv_path.rstrip("/")), f"{name}_export", sheet)
    sheets = export_sheets(spark.table(f"`{name}`"), target, keys)
    return {"table": name, "export": target, "sheet": sheet, "sheets": sheets}

"""Landed payloads derived from flat tables, to feed the payload scans.

A document covers one key and one block of ids. Ids are unique, so no document
holds more than 1,024 rows, however many of the rows belong to one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.session import fresh_dir

BLOCK_BITS = 10


def block(key: Column) -> Column:
    return F.shiftright(key, BLOCK_BITS)


def land(documents: DataFrame, label: str) -> DataFrame:
    """Write payloads to shared storage and scan them from there. Without this the
    optimizer cancels a parse against the rendering it was made by."""
    spark = documents.sparkSession
    path = fresh_dir(spark, label)
    documents.write.parquet(path)
    return spark.read.parquet(path)


def gather_map(df: DataFrame, by: list[str], key: str, value: Column | str) -> DataFrame:
    entries = F.collect_list(F.struct(F.col(key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value")))
    return df.groupBy(*by).agg(F.map_from_entries(entries).alias("_value"))


def facts_documents(events: DataFrame) -> DataFrame:
    """``user_id, payload``: event type -> day -> unit -> observations."""
    day = F.date_format("ts", "yyyy-MM-dd")
    observation = F.struct(
        F.col("value").alias("val"),
        F.year("ts").cast("bigint").alias("fy"),
        F.concat(F.lit("Q"), F.quarter("ts").cast("string")).alias("fp"),
        F.col("event_type").alias("form"),
        day.alias("filed"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("end"),
        F.col("event_id").alias("accn"),
    )
    unit = F.concat(F.lit("unit-"), F.get_json_object("props", "$.k"))
    doc = ["user_id", "_block"]
    # One shuffle on the document key serves all four levels of grouping.
    rows = events.select(
        "user_id", block(F.col("event_id")).alias("_block"), "event_type", day.alias("_day"), unit.alias("_unit"),
        observation.alias("_obs"),
    ).repartition(*doc)
    units = rows.groupBy(*doc, "event_type", "_day", "_unit").agg(F.collect_list("_obs").alias("_value"))
    concepts = gather_map(units, [*doc, "event_type", "_day"], "_unit", "_value")
    taxonomies = gather_map(concepts, [*doc, "event_type"], "_day", F.struct(F.col("_value").alias("units")))
    documents = gather_map(taxonomies, doc, "event_type", "_value")
    return documents.select("user_id", F.to_json(F.struct(F.col("_value").alias("facts"))).alias("payload"))


def observation_documents(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """``user_id, block, payload``: the observations of a user, of one event type if given."""
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.format_string("%.2f", "value").alias("value"),
        F.col("event_type").alias("realtime_start"),
    )
    wanted = entry if event_type is None else F.when(F.col("event_type") == event_type, entry)
    gathered = events.groupBy("user_id", block(F.col("event_id")).alias("block")).agg(
        F.collect_list(wanted).alias("observations")
    )
    return gathered.select("user_id", "block", F.to_json(F.struct("observations")).alias("payload"))


def index_documents(customers: DataFrame) -> DataFrame:
    """``payload``: position -> {cik_str, ticker, title}, many positions sharing a ticker."""
    entry = F.struct(
        F.col("c_custkey").cast("string").alias("cik_str"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("title"),
    )
    rows = customers.select(
        block(F.col("c_custkey")).alias("_block"), F.col("c_custkey").cast("string").alias("_key"), entry.alias("_entry")
    )
    return gather_map(rows, ["_block"], "_key", "_entry").select(F.to_json("_value").alias("payload"))


def html_documents(parts: DataFrame) -> DataFrame:
    """``block, html``: parts as table rows, the brand left blank for small sizes."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    brand = F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.lit(""))
    row = F.concat(F.lit("<tr>"), cell(F.col("p_partkey").cast("string")), cell(F.col("p_name")), cell(brand), F.lit("</tr>"))
    return parts.groupBy(block(F.col("p_partkey")).alias("block")).agg(
        F.concat(
            F.lit("<table class='multisort'><!-- <tr><td>hidden</td></tr> -->"),
            F.array_join(F.collect_list(row), "\n"),
            F.lit("</table>"),
        ).alias("html")
    )

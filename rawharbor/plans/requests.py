"""Retrieval requests as a table: parse, default, fan out, check, warn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.functions.matching import unrelated_topic
from rawharbor.functions.text import default_topic, host_key, parse_list, raw_file_name, strip, topic_slug
from rawharbor.sources.registry import ALL_SOURCES

FALLBACK_SOURCE = "kaggle"
# The source whose data has nothing to do with entertainment topics.
FILINGS_SOURCE = "sec"


def parse_requests(requests: DataFrame, drop_unrelated: bool = False) -> DataFrame:
    """``request_id, sources, topic, warned`` from ``request_id, sources, topic`` texts.

    A blank source list falls back to the default source. A request for company filings on an entertainment topic is warned about; with
    ``drop_unrelated`` that source is taken out, and an emptied list falls back.
    """
    blank = strip(F.coalesce("sources", F.lit(""))) == ""
    chosen = F.when(blank, F.array(F.lit(FALLBACK_SOURCE))).otherwise(parse_list(F.col("sources")))
    parsed = requests.select("request_id", chosen.alias("sources"), default_topic(F.col("topic")).alias("topic"))
    warned = F.array_contains("sources", FILINGS_SOURCE) & unrelated_topic(F.col("topic"))
    parsed = parsed.withColumn("warned", warned)
    if not drop_unrelated:
        return parsed
    left = F.array_remove("sources", FILINGS_SOURCE)
    kept = F.when(F.size(left) == 0, F.array(F.lit(FALLBACK_SOURCE))).otherwise(left)
    return parsed.withColumn("sources", F.when(F.col("warned"), kept).otherwise(F.col("sources")))


def fan_out(parsed: DataFrame, all_sources: Sequence[str] = ALL_SOURCES) -> DataFrame:
    """One row per request and source, in the order they were named."""
    every = F.array(*[F.lit(s) for s in all_sources])
    expanded = F.flatten(
        F.transform("sources", lambda s: F.when(s == "all", every).otherwise(F.array(s)))
    )
    return parsed.select(
        "request_id", "topic", "warned", F.posexplode(expanded).alias("position", "source")
    )


def plan_requests(requests: DataFrame, registry: DataFrame, drop_unrelated: bool = False) -> DataFrame:
    """The fanned-out requests with folder, topic slug and file name; the status
    of a source that is not registered is ``unknown source``."""
    rows = fan_out(parse_requests(requests, drop_unrelated))
    joined = rows.join(registry.select("source", "dir_name"), "source", "left")
    return joined.select(
        "request_id",
        "position",
        "source",
        "topic",
        "warned",
        F.when(F.col("dir_name").isNull(), "unknown source").otherwise("planned").alias("status"),
        host_key(F.col("dir_name")).alias("folder"),
        topic_slug(F.col("topic")).alias("slug"),
        raw_file_name(F.col("topic")).alias("file_name"),
    )

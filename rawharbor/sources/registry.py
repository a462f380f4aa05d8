"""Sources by name: where a dataset comes from and how its landed files are read.

A source is a function ``(spark, path, options) -> DataFrame``; adding one is a
call of :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawharbor.functions.text import fill_template
from rawharbor.operators.align import append_target
from rawharbor.session import small_table
from rawharbor.sources.delimited import scan_csv_literal
from rawharbor.sources.members import csv_members
from rawharbor.sources.payloads import flatten_facts, flatten_observations

Reader = Callable[[SparkSession, str, dict], DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    dir_name: str
    url_template: str
    read: Reader
    # What it means if there is not a single row.
    empty_message: str = "dataset is completely empty"
    # True if the rows come from columnar files and are cheap to read again.
    columnar: bool = False


def read_largest_member(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """The largest CSV of a tree; of equals the first by path."""
    first = csv_members(spark, path).orderBy(F.desc("size"), "path").select("path").first()
    if first is None:
        raise ValueError("no CSV files found")
    return scan_csv_literal(spark, first["path"], stage=True, **options)


def read_csv(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """CSV files, compressed or not, such as listings or a price history. Values stay the
    text that they are, so that long ids, zeros and digits reach the raw file unchanged."""
    return scan_csv_literal(spark, path, stage=True, **options)


def read_with_target(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """A features table, with the target columns of a second table where there is one."""
    features = spark.read.parquet(path)
    if "target_path" not in options:
        return features
    target = spark.read.parquet(options["target_path"])
    return append_target(features, target, [options["key"]], options["target"])


def read_facts(spark: SparkSession, path: str, options: dict) -> DataFrame:
    # wholetext: a document may be pretty-printed over many lines.
    return flatten_facts(spark.read.text(path, wholetext=True), "value", **options)


def read_observations(spark: SparkSession, path: str, options: dict) -> DataFrame:
    return flatten_observations(spark.read.text(path, wholetext=True), "value")


# Source names, folder names and address patterns.
SOURCES: dict[str, Source] = {
    s.name: s
    for s in (
        Source("airbnb", "airbnb", "{}", read_csv, columnar=True),
        Source("fred", "fred", "https://fred.stlouisfed.org/series/{}", read_observations, "no observations returned"),
        Source("kaggle", "kaggle", "https://www.kaggle.com/datasets/{}", read_largest_member, columnar=True),
        Source("openml", "openml", "https://www.openml.org/d/{}", read_with_target),
        Source("sec", "sec", "https://data.sec.gov/api/xbrl/companyfacts/CIK{}.json", read_facts, "no facts found"),
        Source(
            "yfinance", "yahoofinance", "https://finance.yahoo.com/quote/{}", read_csv, "not found or delisted", columnar=True
        ),
    )
}
# What the request "all" stands for.
ALL_SOURCES = ("kaggle", "openml")


def register(source: Source) -> None:
    SOURCES[source.name.lower()] = source


def get_source(name: str) -> Source:
    try:
        return SOURCES[name.lower()]
    except KeyError:
        raise ValueError(f"source '{name}' is not registered; available: {sorted(SOURCES)}") from None


def registry_table(spark: SparkSession) -> DataFrame:
    """``source, dir_name, url_template``: one row per registered source."""
    rows = [(s.name, s.dir_name, s.url_template) for s in SOURCES.values()]
    return small_table(spark, rows, "source string, dir_name string, url_template string")


def source_url(source: Column, value: Column) -> Column:
    """The address of a dataset; NULL for an unknown source. Keys never go into it."""
    url = F.lit(None).cast("string")
    for s in SOURCES.values():
        url = F.when(source == s.name, fill_template(s.url_template, value)).otherwise(url)
    return url

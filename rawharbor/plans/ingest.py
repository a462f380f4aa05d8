"""One retrieval run: read, limit, gate, save; and a batch of such runs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rawharbor.functions.nulls import column
from rawharbor.functions.text import raw_file_name
from rawharbor.operators.quality import MAX_NULL_DENSITY, assess, null_counts
from rawharbor.operators.ranking import TOP_K_ROWS, head_rows
from rawharbor.plans.layout import dataset_dir, write_description, write_raw
from rawharbor.session import fresh_dir
from rawharbor.sources.delimited import typed_values
from rawharbor.sources.registry import get_source


@dataclass(frozen=True)
class Request:
    source: str
    topic: str
    path: str
    options: dict = field(default_factory=dict)
    row_limit: int = 0
    order_by: Sequence[str] = ()


@dataclass(frozen=True)
class Result:
    request: Request
    status: str
    message: str | None = None
    csv_path: str | None = None


class PayloadRejected(ValueError):
    """The dataset is empty or too much of it is missing."""


def ingest(
    spark: SparkSession, request: Request, outdir: str, threshold: float = MAX_NULL_DENSITY
) -> str:
    """Run one request and return the folder of its raw CSV.

    The source is parsed once; the limit, the gate, the raw file and the
    description all work on a columnar copy of it on shared storage. The row limit
    comes before the gate, as an accepted prefix is what was asked for.
    """
    source = get_source(request.source)
    rows = source.read(spark, request.path, request.options)
    if not rows.columns:
        raise PayloadRejected(source.empty_message)
    kept = _limited(rows, request, source.columnar)
    verdict = assess(null_counts(kept), threshold).first()
    if verdict["status"] != "passed":
        raise PayloadRejected(source.empty_message if verdict["status"] == "empty" else verdict["message"])

    folder = dataset_dir(outdir, source.dir_name, request.topic)
    stem = spark.range(1).select(raw_file_name(F.lit(request.topic))).first()[0]
    csv_path = os.path.join(folder, stem)
    write_raw(kept, csv_path)
    write_description(kept, os.path.join(folder, "dataset_description"), request.topic)
    return csv_path


# Runs of a batch that share the cluster at any time.
AT_ONCE = 8


def ingest_all(spark: SparkSession, requests: Iterable[Request], outdir: str, at_once: int = AT_ONCE) -> list[Result]:
    """Run every request, some at once; one that fails is reported and does not stop the
    others. It is an error if none succeeds.

    Each run is a scheduler pool of its own, so that with fair scheduling a large one does
    not hold up the small ones, and its jobs carry a tag, by which what a failed run
    has left running is cancelled. Runs that write to the same folder follow one another
    in the order of the requests.
    """
    asked = list(requests)
    by_folder: dict[str, list[int]] = {}
    for number, request in enumerate(asked):
        by_folder.setdefault(_folder(request, outdir), []).append(number)
    results: dict[int, Result] = {}

    def run(request: Request) -> Result:
        tag = f"ingest-{uuid.uuid4().hex}"
        spark.addTag(tag)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", tag)
        try:
            return Result(request, "passed", csv_path=ingest(spark, request, outdir))
        except Exception as error:  # noqa: BLE001 - every failure becomes a result row
            spark.interruptTag(tag)
            return Result(request, "failed", message=str(error))
        finally:
            spark.removeTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    def run_in_order(numbers: list[int]) -> None:
        for number in numbers:
            results[number] = run(asked[number])

    with ThreadPoolExecutor(max(1, min(at_once, len(by_folder)))) as pool:
        list(pool.map(inheritable_thread_target(spark)(run_in_order), by_folder.values()))
    found = [results[number] for number in range(len(asked))]
    if not any(r.status == "passed" for r in found):
        raise ValueError("; ".join(f"{r.request.source}: {r.message}" for r in found) or "no requests")
    return found


def _folder(request: Request, outdir: str) -> str:
    """Where a run writes; an unknown source writes nowhere."""
    try:
        return dataset_dir(outdir, get_source(request.source).dir_name, request.topic)
    except ValueError:
        return f"{request.source}: {request.topic}"


def _limited(rows: DataFrame, request: Request, columnar: bool) -> DataFrame:
    """The requested rows in columnar form."""
    if request.row_limit <= 0:
        return rows if columnar else _stage(rows)
    if not request.order_by:
        raise ValueError("a row limit needs order_by: the rows of a table have no order of their own")
    if not columnar and request.row_limit > TOP_K_ROWS:
        rows = _stage(rows)  # a long prefix takes several passes over its key
    # Text is put in the order of what it says: 9 comes before 10.
    texts = [c for c in request.order_by if isinstance(rows.schema[c].dataType, StringType)]
    values = typed_values(rows, texts) if texts else {}
    keys = {f"_order{i}": values.get(c, column(c)) for i, c in enumerate(request.order_by)}
    head = head_rows(rows.withColumns(keys), [*keys, *request.order_by], request.row_limit).drop(*keys)
    return _stage(head) if request.row_limit <= TOP_K_ROWS else head


def _stage(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    path = fresh_dir(spark, "staged")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)

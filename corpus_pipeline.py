"""From raw documents to token ids: five stages, each a whole pass over what the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns the next stage's documents. ``run`` applies them one after the other, writing
each result to the shared folder as Parquet and reading it back.

A stage keeps the columns of documents, handles nulls, empty texts, repeated rows, empty
tables and extra columns as its operator states, and takes nothing from other stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawharbor.llm import mixing, neardup, pii, quality
from rawharbor.llm.common import free_name, materialize, quoted, table
from rawharbor.llm.queries import coded


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    out = free_name(docs, "_quality")
    verdicts = quality.quality_verdicts(docs, table(spark, sf_dir, "labels"), out)
    return verdicts.filter(quoted(out)["kept"]).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans are replaced by the name of their kind."""
    out = free_name(docs, "_spans")
    return pii.mask(pii.with_spans(docs, out), out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    out = free_name(docs, "_mix")
    return mixing.repeated(mixing.mix(docs, out), out)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and a digest showing that they decode to it."""
    rows = coded(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
    ("token ids", to_token_ids),
]
#: Sketches, exact tests on labelled data and BPE are not SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

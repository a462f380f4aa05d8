"""Registered queries against SQL, and the pipeline against its operators."""

import hashlib
import os
import re

import pytest
from odd import ROWS, no_documents, odd_documents
from oracle import connect, difference

import __spark_entry__ as entry_points
import corpus_pipeline
from rawharbor.llm import neardup, pii, quality
from rawharbor.llm.queries import QUERIES
from rawharbor.llm.sql import SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_one_row_per_document(spark, name):
    table, key = ("embeddings", "vec_id") if name == "op11_whitening" else ("documents", "doc_id")
    df = QUERIES[name](spark, SF)
    if name == "op11_whitening":
        df = df.filter("component = 1")
    ids = [r[key] for r in df.select(key).collect()]
    assert sorted(ids) == sorted(r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, path = docs, str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "token ids":
            assert docs.columns == before.columns
        if name == "quality rules":
            good = quality.quality_verdicts(before, spark.read.parquet(f"{SF}/labels.parquet"), "q").filter("q.kept")
            assert docs.count() == good.count() < before.count()
        elif name == "near-duplicates":
            kept = {r["doc_id"] for r in neardup.near_duplicates(before).filter("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept and docs.count() == len(kept)
        elif name == "personal data":
            assert docs.count() == before.count()
            assert pii.with_spans(docs, "s").filter("size(s) > 0").count() == 0
        elif name == "token ids":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for row in docs.collect():
                assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
            assert docs.count() == before.count()


def test_stages_take_odd_and_no_documents(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_documents(spark), SF)
        if name != "token ids":
            assert out.columns == odd_documents(spark).columns
        assert 0 <= out.count() <= 2 * len(ROWS)
        assert stage(spark, no_documents(spark), SF).count() == 0

"""Every registered query against DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracle import connect, difference

from rawharbor.plans import table_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(entry_points.QUERIES) == set(entry_points.SQL)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.QUERIES))
def test_query_matches_sql(spark, connection, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    found = difference(df, connection, entry_points.oracle_sql()[name])
    assert found is None, found


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).columns == ["ordinal", "column", "nulls", "rows", "columns"]
    assert entry_points.entry(spark).count() == 7


def test_stray_quotes_are_written_by_more_tasks_than_folders(spark, connection, monkeypatch, tmp_path):
    monkeypatch.setattr(table_queries, "FILE_BYTES", 100_000, raising=False)
    monkeypatch.setattr(table_queries, "fresh_dir", lambda spark, label: str(tmp_path / label))
    df = table_queries.csv_stray_quotes(spark, SF_DIR)
    sizes = [f.stat().st_size for f in (tmp_path / "stray").rglob("part-*")]
    assert len(sizes) > 16 and max(sizes) < sum(sizes) / 8
    assert difference(df, connection, entry_points.oracle_sql()["csv_stray_quotes"]) is None

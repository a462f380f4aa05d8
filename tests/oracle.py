"""Compare a Spark result with DuckDB's answer on the same tables."""

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple((type(v := plain(row[i])).__name__, v) for i in order) for row in rows)


def difference(df, connection, sql):
    """A short description of the first differences, or None."""
    result = connection.execute(sql)
    names, expected = bag([d[0] for d in result.description], result.fetchall())
    found_names, found = bag(df.columns, [tuple(r) for r in df.collect()])
    if names != found_names:
        return f"columns {found_names} expected {names}"
    if found != expected:
        return (
            f"rows {found.total()} expected {expected.total()}; surplus {list((found - expected).items())[:3]}; "
            f"lacking {list((expected - found).items())[:3]}"
        )
    if not expected and not sql.endswith("IS NULL"):
        return "no rows on either side"
    return None

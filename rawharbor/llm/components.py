"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import materialize
from rawharbor.operators.joins import join_reduced


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge to a lesser node or is such a node itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    counted = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return counted.filter("out > 1 OR (out > 0 AND into > 0)").limit(1).count() == 0


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` for every node in a link ``a, b``: the least node it can reach.

    Alternating large and small stars: a node passes its least neighbour to its larger
    neighbours, then to its smaller ones, until every component is one star. Each round
    is two aggregates with two joins, is written to the shared folder, and at least
    halves long chains; a node with very many links is split by the join.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _nearest(both).select("a", F.least("a", "least").alias("least"))
        large = (
            join_reduced(both, least, ["a"], "inner").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        large = large.distinct()
        small = join_reduced(large, _nearest(large), ["a"], "inner")
        pairs = small.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        own = _nearest(large).withColumnRenamed("least", "b")
        edges = materialize(pairs.unionByName(own).distinct(), "stars")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)

"""Many queries resolved at once against ids, catalogs and links.

Each resolver answers a whole table of queries in one pass over the big side and
returns one row per query; a query without a match keeps NULLs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.functions.literals import is_pattern, needed
from rawharbor.functions.matching import flagged, fold, is_plain, regex_match
from rawharbor.functions.text import size_text, zero_pad
from rawharbor.operators.joins import join_reduced
from rawharbor.session import prepare_python

# Up to here the distinct link queries become constants of the scan.
LITERAL_QUERIES = 64
# Longest piece of a query that is used as a join key.
ANCHOR_LENGTH = 8
PATTERNS_PER_CHUNK = 64


def lookup_ids(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Ticker -> padded id, the first index entry in document order winning.

    ``requests(query_id, query)``, ``index(ordinal, cik_str, ticker, title)``. The
    index is reduced to one row per ticker before the join, so no key multiplies.
    """
    best = F.min_by(F.struct("cik_str", "title"), F.col("ordinal"))
    tickers = index.groupBy(F.lower(F.coalesce("ticker", F.lit(""))).alias("_key")).agg(best.alias("_hit"))
    joined = join_reduced(requests.withColumn("_key", F.lower("query")), tickers, ["_key"])
    return joined.select(
        "query_id", "query", zero_pad(F.col("_hit.cik_str")).alias("cik"), F.col("_hit.title").alias("title")
    )


def best_catalog_match(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Regex query -> the matching dataset with the most instances, ties to the lowest did.

    ``requests(query_id, query)``, ``catalog(did, name, instances, features)``. A query that
    is no valid pattern matches nothing; :func:`rejected_searches` tells which those are.
    """
    prepare_python(requests.sparkSession)
    queries = requests.select("query").distinct().where(_is_search(F.col("query")))
    # A name costs far more to match than to move, and what matches depends on the name
    # alone: keep the best entry of each name.
    named = catalog.where(F.col("name").isNotNull()).groupBy("name").agg(_best_entry("did", "instances", "features"))
    pairs = _regex_pairs(queries, named.select("name", "_best.*"))
    hits = pairs.groupBy("query").agg(_best_entry("did", "name", "instances", "features"))
    return join_reduced(requests, hits, ["query"]).select(
        "query_id",
        "query",
        F.col("_best.did").alias("did"),
        F.col("_best.name").alias("name"),
        size_text(F.col("_best.instances"), F.col("_best.features")).alias("size_info"),
    )


def rejected_searches(requests: DataFrame) -> DataFrame:
    """Requests whose query is not a valid pattern, so that it cannot be searched for."""
    return requests.where(F.col("query").isNotNull() & ~_is_search(F.col("query")))


def _is_search(query: Column) -> Column:
    return F.coalesce(is_pattern(flagged(query)), F.lit(False))


def _best_entry(*values: str) -> Column:
    # Struct order puts a missing size last under max.
    return F.max_by(F.struct(*values), F.struct("instances", -F.col("did"))).alias("_best")


def first_links(requests: DataFrame, links: DataFrame, suffix: str) -> DataFrame:
    """Query -> the first link in document order that contains it and ends in the suffix.

    ``requests(query_id, query)``, ``links(page_id, position, href)``.
    """
    usable = links.where(F.endswith("href", F.lit(suffix))).select("page_id", "position", "href")
    queries = requests.select("query").distinct()
    few = _few(queries)
    if few is not None:
        pairs = _literal_pairs(usable, few, lambda q: F.contains(F.lower("href"), F.lower(F.lit(q))))
        hits = pairs.groupBy("query").agg(_first_link())
    else:
        needles = queries.where(F.col("query").isNotNull()).withColumn("_needle", F.lower("query"))
        short, long = F.length("_needle") <= ANCHOR_LENGTH, F.length("_needle") > ANCHOR_LENGTH
        pairs = _contains_pairs(needles.where(long).select("query"), F.lower("query"), usable, F.lower("href"))
        hits = pairs.groupBy("query").agg(_first_link()).unionByName(_first_pieces(needles.where(short), usable))
    return join_reduced(requests, hits, ["query"]).select("query_id", "query", "_hit.page_id", "_hit.position", "_hit.href")


def _first_link() -> Column:
    return F.min(F.struct("page_id", "position", "href")).alias("_hit")


def _first_pieces(needles: DataFrame, links: DataFrame) -> DataFrame:
    """Needles as short as a piece are found in an index of the first link of each piece. A
    needle that very many links hold costs one row per task, not one per link."""
    lengths = sorted(r["n"] for r in needles.select(F.length("_needle").alias("n")).distinct().collect())  # few: see ANCHOR_LENGTH
    if not lengths:
        return needles.select("query", F.lit(None).cast("struct<page_id:bigint,position:bigint,href:string>").alias("_hit"))
    held = F.array_distinct(F.concat(*[pieces(F.lower("href"), n) for n in lengths]))
    offered = links.select("page_id", "position", F.explode(held).alias("_needle"))
    index = offered.groupBy("_needle").agg(F.min(F.struct("page_id", "position")).alias("_at"))
    first = join_reduced(needles, index, ["_needle"], "inner").select("query", "_at.*")
    found = links.join(first.select("page_id", "position").distinct(), ["page_id", "position"])
    return first.join(found, ["page_id", "position"]).select("query", F.struct("page_id", "position", "href").alias("_hit"))


def known_sources(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose source is registered, with the source's properties."""
    return requests.withColumn("source", F.lower("source")).join(registry, "source")


def unknown_sources(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose source is not registered."""
    return requests.withColumn("source", F.lower("source")).join(registry, "source", "left_anti")


def missing_columns(required: DataFrame, df: DataFrame) -> DataFrame:
    """Required columns that a table does not have."""
    return required.where(~F.col("column").isin(df.columns))


def _few(queries: DataFrame) -> list[str] | None:
    """The distinct queries if there are at most LITERAL_QUERIES of them."""
    head = queries.where(F.col("query").isNotNull()).limit(LITERAL_QUERIES + 1).collect()
    return [r["query"] for r in head] if len(head) <= LITERAL_QUERIES else None


def _literal_pairs(rows: DataFrame, queries: list[str], test) -> DataFrame:
    """Matches against constants: one scan, compiled patterns and no join."""
    if not queries:
        return rows.withColumn("query", F.lit(None).cast("string")).where(F.lit(False))
    hits = F.array_compact(F.array(*[F.when(test(q), F.lit(q)) for q in queries]))
    return rows.withColumn("query", F.explode(hits))


def _regex_pairs(queries: DataFrame, named: DataFrame) -> DataFrame:
    """Matching pairs of valid patterns and names; a pair may come more than once.

    A match contains one of the literals that its pattern needs, so names are found by
    these literals and then tested. Only a pattern that needs none sees all names.
    """
    needs = queries.withColumn("_needs", needed(F.col("query")))
    literal = needs.where(F.size("_needs") > 0).select("query", F.explode("_needs").alias("_literal"))
    found = _contains_pairs(literal, fold(F.col("_literal")), named, fold(F.col("name")))
    tested = found.where(is_plain(F.col("query")) | regex_match(F.col("name"), F.col("query")))
    return tested.unionByName(_chunked_regex_pairs(needs.where(F.size("_needs") == 0).select("query"), named))


def _contains_pairs(queries: DataFrame, needle: Column, rows: DataFrame, hay: Column) -> DataFrame:
    """Rows joined to the queries they contain, by equality instead of comparison of all pairs.

    An index counts the rows that hold each piece, of the lengths in use. A query is
    keyed by its own piece, at most ANCHOR_LENGTH long, that the fewest rows hold; one
    with a piece that no row holds has no match and is left out. Every true match holds
    its query's key, so testing the joined rows is exact.
    """
    needles = queries.select("query", needle.alias("_needle"))
    length = F.least(F.length("_needle"), F.lit(ANCHOR_LENGTH))
    sized = needles.withColumn("_length", length)
    # At most ANCHOR_LENGTH + 1 different values.
    lengths = sorted(r["_length"] for r in sized.select("_length").distinct().collect())
    if not lengths:
        return rows.withColumn("query", F.lit(None).cast("string")).where(F.lit(False))

    own = F.coalesce(*[F.when(F.col("_length") == n, pieces(F.col("_needle"), n)) for n in lengths])
    offered = sized.select("query", "_needle", F.explode(own).alias("_anchor"))
    text = rows.withColumn("_hay", hay)
    keys = F.explode(F.array_distinct(F.concat(*[pieces(F.col("_hay"), n) for n in lengths])))
    index = text.select(keys.alias("_anchor")).groupBy("_anchor").agg(F.count(F.lit(1)).alias("_rows"))
    held = join_reduced(offered, index, ["_anchor"]).withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    rarest = held.groupBy("query", "_needle").agg(F.min(F.struct("_rows", "_anchor")).alias("_key"))
    anchors = rarest.where("_key._rows > 0").select("query", "_needle", F.col("_key._anchor").alias("_anchor"))
    keyed = text.withColumn("_anchor", keys)
    return (
        keyed.join(anchors, "_anchor")
        .where(F.contains("_hay", "_needle"))
        .drop("_anchor", "_hay", "_needle")
    )


def pieces(text: Column, length: int) -> Column:
    """All distinct substrings of one length."""
    if length == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), 1))


def _chunked_regex_pairs(regexes: DataFrame, named: DataFrame) -> DataFrame:
    """Patterns without a literal of their own must each see each name. Patterns are packed into chunks of
    a steady size, so that a row is repeated per chunk and not per pattern, and the
    chunk number is an equi-join key that the adaptive planner can broadcast or split.
    """
    chunks = max(1, math.ceil(regexes.count() / PATTERNS_PER_CHUNK))
    slot = F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int")
    packed = regexes.groupBy(slot.alias("_chunk")).agg(F.collect_list("query").alias("_patterns"))
    spread = named.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    matching = F.filter("_patterns", lambda p: regex_match(F.col("name"), p))
    return join_reduced(spread, packed, ["_chunk"], "inner").withColumn("query", F.explode(matching)).drop("_chunk", "_patterns")

"""JSON payload columns turned into rows, without collecting or Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The observation fields kept from a facts document.
FACT_FIELDS = ("val", "fy", "fp", "form", "filed", "end")
OBSERVATION_SCHEMA = "observations array<struct<date:string,value:string>>"
INDEX_SCHEMA = "map<string,struct<cik_str:string,ticker:string,title:string>>"


# Value type that keeps a number as it is written in the document.
LITERAL = "literal"


def facts_schema(value_type: str) -> str:
    literal = value_type == LITERAL
    kinds = {f: "variant" if literal else "string" for f in FACT_FIELDS} | ({} if literal else {"val": value_type, "fy": "bigint"})
    observation = f"struct<{','.join(f'{f}:{k}' for f, k in kinds.items())}>"
    return f"facts map<string,map<string,struct<units:map<string,array<{observation}>>>>>"


def last_wins(entries: Column) -> Column:
    """Entries of a parsed JSON object in which a repeated key keeps its last value."""
    keys = F.map_keys(entries)
    pairs = F.map_entries(entries)
    kept = F.filter(
        pairs, lambda pair, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), pair["key"])
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(kept)


def flatten_facts(
    documents: DataFrame, payload: str, keep: tuple[str, ...] = (), value_type: str = LITERAL
) -> DataFrame:
    """taxonomy -> concept -> unit -> observations, as one row per observation.

    Missing levels give no rows, missing observation fields give NULL and fields
    that are not listed are dropped while parsing. All fields are the text of what is
    written, of whatever kind, with all digits (zeros that end a fraction go), unless ``value_type`` names a type to read values
    as, such as ``double``; ``fy`` is then a whole number.
    """
    # inline gives key and value columns of their own, so that each level passes on
    # the key and lets go of the value it was unfolded from.
    parsed = documents.select(*keep, F.from_json(payload, facts_schema(value_type))["facts"].alias("_facts"))
    taxonomies = parsed.select(*keep, F.inline(last_wins(F.col("_facts"))).alias("taxonomy", "_concepts"))
    concepts = taxonomies.select(*keep, "taxonomy", F.inline(last_wins(F.col("_concepts"))).alias("concept", "_body"))
    units = concepts.select(
        *keep, "taxonomy", "concept", F.inline(last_wins(F.col("_body.units"))).alias("unit", "_observations")
    )
    rows = units.select(*keep, "taxonomy", "concept", "unit", F.inline("_observations"))
    fields = [F.col(f).cast("string").alias(f) if value_type == LITERAL else F.col(f) for f in FACT_FIELDS]
    return rows.select(*keep, "taxonomy", "concept", "unit", *fields)


def parse_observations(documents: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return documents.select(*keep, F.from_json(payload, OBSERVATION_SCHEMA)["observations"].alias("observations"))


def flatten_observations(documents: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw ``date`` and ``value`` strings, frequencies and gaps untouched."""
    return parse_observations(documents, payload, keep).select(*keep, F.inline("observations"))


def reject_observations(documents: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents that hold no observation, with the reason."""
    parsed = parse_observations(documents, payload, keep)
    empty = F.coalesce(F.size("observations"), F.lit(0)) <= 0
    return parsed.where(empty).select(*keep, F.lit("no observations returned").alias("reason"))


def keyed_objects(documents: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """An object of ``key -> {cik_str, ticker, title}`` as rows. ``ordinal`` is the key where
    it is a whole number, else the place of the entry in its document."""
    index = F.from_json(payload, INDEX_SCHEMA)
    parsed = documents.select(*keep, index.alias("_index"))
    entries = parsed.select(*keep, F.posexplode(last_wins(F.col("_index"))).alias("_place", "_pair"))
    ordinal = F.coalesce(F.col("_pair.key").try_cast("bigint"), F.col("_place").cast("bigint"))
    return entries.select(*keep, ordinal.alias("ordinal"), "_pair.value.*")

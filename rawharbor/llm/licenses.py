"""Licences of files: TF-IDF cosine to templates, then inheritance from directories.

Only Spark expressions, joins and aggregates are used.

*Units.* What speaks of a licence is compared: every such line, every such paragraph without
the comment signs before its lines (headers wrap), every SPDX tag as one word, and the whole
of a licence file: a file that is named like one, or that has at most ``SHORT`` words and
speaks of a licence.

*Cosine.* Units and the forms of a licence are sparse vectors of words. Document frequencies
are counted over all units, weights are ``tf * (ln((1 + units) / (1 + df)) + 1)``. Words of
units meet words of forms in an equi-join, so only what they share is multiplied. A unit's
licence is that of the form with the highest cosine, if that reaches ``LEAST``.

*Inheritance.* A directory's licence is that of its best licence file. A file
without a licence of its own takes that of the nearest directory above it that has one:
each distinct directory is joined to the licences of all its ancestors, the deepest wins,
and files are joined to directories, with hot directories split.

Defined cases: a null or empty text has no units; a null path is a file of its own
in no directory and inherits nothing; equal paths, and repeated rows, are files of their
own; ties in cosine go to the first licence by name, ties between licence files to the first
path; very long texts are read whole; other columns, whatever their names, are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import WORD, materialize, quoted
from rawharbor.llm.license_texts import TEMPLATES
from rawharbor.operators.joins import join_reduced
from rawharbor.session import small_table

LEAST = 0.55
SHORT = 60
CUE = (
    r"(?i)licen[cs]e|copyright|spdx|all rights reserved|public domain|permission is hereby granted|redistribution and use"
    r"|permission to use|unauthorized copying"
)
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"

# Signs that stand before the text of a comment line.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+)?[ \t]*"
TAG = r"(?i)spdx-license-identifier:\s*([\w.+-]+)"


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens that begin and end with a letter or digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?"), F.lit(0))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def _counted(units: DataFrame) -> DataFrame:
    return units.select("unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))


def _forms(templates: dict[str, Sequence[str]]) -> list[tuple[str, str]]:
    """``(name and number, text)`` of every form, the SPDX tag last."""
    return [
        (f"{name}|{i}", text) for name, texts in sorted(templates.items()) for i, text in enumerate([*texts, _tag_word(name)])
    ]


def _tag_word(identifier: str) -> str:
    return f"spdx-tag-{identifier.lower()}"


def best_templates(units: DataFrame, templates: dict[str, Sequence[str]], least: float = LEAST) -> DataFrame:
    """``unit, license, score`` for the units that come near enough to a form of a licence."""
    spark = units.sparkSession
    number = units.count()
    counted = materialize(_counted(units), "unit-terms")
    known = small_table(spark, _forms(templates), "unit string, text string")
    named = _counted(known).withColumnRenamed("unit", "license")
    frequency = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + number) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    vectors = join_reduced(counted, frequency, ["term"], "left").select("unit", "term", (F.col("tf") * idf).alias("w"))
    wanted = named.join(frequency, "term", "left").select("license", "term", (F.col("tf") * idf).alias("v"))
    lengths = vectors.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    sizes = wanted.groupBy("license").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = vectors.join(wanted, "term").groupBy("unit", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(lengths, "unit").join(sizes, "license").withColumn(
        "score", F.round(F.col("dot") / (F.col("length") * F.col("size")), 9)
    )
    scored = scored.withColumn("license", F.substring_index("license", "|", 1))
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("below"), "license")).alias("b"))
    return best.select("unit", "b.license", (-F.col("b.below")).alias("score")).filter(F.col("score") >= least)


def license_scan(
    files: DataFrame,
    path: Column,
    text: str = "text",
    id_column: str = "doc_id",
    templates: dict[str, Sequence[str]] | None = None,
    least: float = LEAST,
) -> DataFrame:
    """``doc_id, path, license, score, origin, licence_file`` for every row of ``files``;
    ``origin`` is ``own``, ``directory`` or null, ``score`` that of where it comes from."""
    content = F.coalesce(quoted(text).cast("string"), F.lit(""))
    where = path.cast("string")
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(CUE))
    paragraphs = F.filter(F.split(F.regexp_replace(content, MARKS, ""), r"\n\r?(?:\n\r?)+"), lambda p: p.rlike(CUE) & F.contains(p, F.lit("\n")))
    # "-or-later", "-only" and "+" name versions of one licence.
    tag = F.regexp_replace(F.lower(F.regexp_extract(content, TAG, 1)), r"(?:-or-later|-only|\+)$", "")
    tags = F.when(tag != "", F.array(F.concat(F.lit(_tag_word("")), tag))).otherwise(F.array().cast("array<string>"))
    rows = files.select(
        F.monotonically_increasing_id().alias("file"),
        quoted(id_column).alias("doc_id"),
        where.alias("path"),
        F.when(content.rlike(CUE), F.concat(lines, paragraphs, tags)).otherwise(F.array().cast("array<string>")).alias("lines"),
        (
            F.coalesce(where.rlike(NAMED), F.lit(False))
            | (content.rlike(CUE) & (F.regexp_count(content, F.lit(WORD)) <= SHORT))
        ).alias("licence_file"),
        content.alias("content"),
    )
    whole = F.when(F.col("licence_file"), F.array("content")).otherwise(F.array().cast("array<string>"))
    # Row numbers must stay what they are: written, then read. Texts are left behind.
    kept = materialize(
        rows.select("file", "doc_id", "path", "licence_file", F.concat("lines", whole).alias("units")).withColumn(
            "directory", directory(F.col("path"))
        ),
        "license-files",
    )
    units = kept.select("file", F.posexplode("units").alias("at", "text")).select(
        F.concat_ws(":", "file", "at").alias("unit"), "file", "text"
    )
    found = units.select("unit", "file").join(best_templates(units.select("unit", "text"), templates or TEMPLATES, least), "unit")
    own = materialize(
        found.groupBy("file")
        .agg(F.min(F.struct((-F.col("score")).alias("below"), "license")).alias("b"))
        .select("file", F.col("b.license").alias("own"), (-F.col("b.below")).alias("own_score")),
        "license-own",
    )
    marked = kept.drop("units").join(own, "file", "left")
    holders = (
        marked.filter(F.col("licence_file") & F.col("own").isNotNull() & F.col("directory").isNotNull())
        .groupBy("directory")
        .agg(F.min(F.struct((-F.col("own_score")).alias("below"), "path", F.col("own").alias("license"))).alias("b"))
        .select("directory", "b.license", (-F.col("b.below")).alias("score"))
    )
    # Every distinct directory, with itself and all above it; "" is the root.
    parts = F.split("directory", "/")
    above = F.concat(
        F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor"))),
        F.transform(
            F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: F.col("directory") != ""),
            lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("ancestor")),
        ),
    )
    directories = kept.select("directory").filter("directory IS NOT NULL").distinct().select("directory", F.inline(above))
    held = holders.select(F.col("directory").alias("ancestor"), "license", "score")
    nearest = (
        join_reduced(directories, held, ["ancestor"], "inner")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "license", "score")).alias("n"))
        .select("directory", F.col("n.license").alias("inherited"), F.col("n.score").alias("inherited_score"))
    )
    joined = join_reduced(marked, nearest, ["directory"], "left")
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own", "inherited").alias("license"),
        F.coalesce("own_score", "inherited_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "directory").alias("origin"),
        "licence_file",
    )

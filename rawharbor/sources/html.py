"""Anchors and tables of raw HTML pages by built-in regular expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Anchors inside comments, scripts and styles are text, not links.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Whole attributes are stepped over, so neither data-href nor an href inside
# another attribute's quotes is taken for a link.
# A quoted value ends its attribute even if no blank follows. Nothing that is stepped over is
# given back, so a tag of any number of attributes is read once, without recursion.
ANCHOR = (
    r"(?is)<a\s+(?:(?!href\s*=)[^\s\"'>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"\s*+|'[^']*+'\s*+|[^\s\"'>]++\s++)|\s++))*+"
    r"href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
)
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
# Named character references that end in a semicolon, from the standard library's table.
NAMES = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and text != "&"}
NAMED = r"&([a-zA-Z][a-zA-Z0-9]*);"
NUMERIC = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def unescape(text: Column) -> Column:
    references = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC), 1))
    numbered = F.aggregate(references, text, lambda done, n: F.replace(done, F.concat(F.lit("&#"), n, F.lit(";")), _character(n)))
    text = F.when(F.contains(text, F.lit("&#")), numbered).otherwise(text)
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    known = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMED), 1)), lambda n: F.map_contains_key(table, n))
    named = F.aggregate(known, text, lambda done, n: F.replace(done, F.concat(F.lit("&"), n, F.lit(";")), table[n]))
    text = F.when(F.rlike(text, F.lit(NAMED)), named).otherwise(text)
    # An ampersand comes last, so that what it stands before is not resolved as well.
    return F.regexp_replace(text, "&(?:amp|AMP);", "&")


def _character(reference: Column) -> Column:
    """The character of a decimal or x-prefixed code point. An ampersand stays
    escaped, to be resolved last and only once."""
    hexadecimal = F.rlike(reference, F.lit("^[xX]"))
    code = F.conv(F.regexp_replace(reference, "^[xX]", ""), 16, 10)
    point = F.when(hexadecimal, code).otherwise(reference).cast("int")
    valid = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
    known = F.when(valid, point).otherwise(F.lit(0xFFFD))
    character = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
    return F.when(point == 38, F.lit("&amp;")).otherwise(character)


def anchors(pages: DataFrame, html: str, keep: tuple[str, ...]) -> DataFrame:
    """Every ``<a href>`` with its position in the document."""
    visible = F.regexp_replace(F.col(html), HIDDEN, "")
    found = F.regexp_extract_all(visible, F.lit(ANCHOR), 1)
    links = pages.select(*keep, F.posexplode(found).alias("position", "_raw"))
    href = unescape(F.regexp_replace("_raw", r"(?s)^[\"'](.*)[\"']$", "$1"))
    return links.select(*keep, "position", href.alias("href"))


def table_rows(pages: DataFrame, html: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows of the tables as ``cells``; an empty cell is NULL and nothing is merged."""
    visible = F.regexp_replace(F.col(html), HIDDEN, "")
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(visible, F.lit(ROW), 1)).alias("position", "_row"))
    text = lambda cell: F.nullif(F.trim(unescape(F.regexp_replace(cell, r"<[^>]*>", ""))), F.lit(""))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(CELL), 1), text)
    return rows.select(*keep, "position", cells.alias("cells"))

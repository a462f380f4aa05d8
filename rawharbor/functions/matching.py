"""Text predicates used when a query is resolved against names, ids or links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic words that make a corporate-filings request doubtful.
UNRELATED_TOPIC_WORDS = ("movie", "game", "sports", "anime")

# Characters with a meaning of their own inside a regular expression.
REGEX_META = r"[\\^$.|?*+()\[\]{}]"


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def flagged(pattern: Column | str) -> Column:
    """The pattern with upper and lower case taken as alike."""
    return F.concat(F.lit("(?iu)"), as_column(pattern))


def regex_match(name: Column, pattern: Column | str) -> Column:
    """Case-insensitive regex search; a NULL name never matches."""
    return F.coalesce(F.rlike(name, flagged(pattern)), F.lit(False))


def simple_fold(letter: str) -> str:
    """The letter that a case-insensitive regex compares: upper case, then lower case,
    each of one character only."""
    upper = next((u for u in (letter.upper(), letter.title()) if len(u) == 1), letter)
    return "i" if upper == "İ" else upper.lower()


# Letters whose lower case differs from their fold, among them every sigma, since lower
# case of a whole text writes the last one of a word differently.
FOLDED = {c: simple_fold(c) for c in map(chr, range(0x80, 0x1E944)) if c.lower() != simple_fold(c) or c == "Σ"}


def fold(column: Column) -> Column:
    """Lower case in the sense of a case-insensitive regex."""
    return F.lower(F.translate(column, "".join(FOLDED), "".join(FOLDED.values())))


def is_plain(pattern: Column) -> Column:
    """True if a pattern has no regex syntax, so that it is a substring search."""
    return ~F.rlike(pattern, F.lit(REGEX_META))


def unrelated_topic(topic: Column) -> Column:
    return F.rlike(F.lower(topic), F.lit("|".join(UNRELATED_TOPIC_WORDS)))

"""Names, slugs and text renderings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOPIC = "finance"
SHEET_NAME_LIMIT = 31


# The characters that count as blank in any script.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(column: Column) -> Column:
    return F.regexp_replace(column, rf"^{BLANK}+|{BLANK}+\z", "")


def topic_slug(query: Column) -> Column:
    """Every run of other characters becomes one underscore; ends are kept."""
    return F.lower(F.regexp_replace(query, "[^a-zA-Z0-9_-]+", "_"))


def safe_stem(query: Column) -> Column:
    """Letters and digits of any script, space, underscore and hyphen survive."""
    kept = F.trim(F.regexp_replace(query, r"[^\p{L}\p{N} _-]", ""))
    return F.lower(F.replace(kept, F.lit(" "), F.lit("_")))


def raw_file_name(query: Column) -> Column:
    return F.concat(safe_stem(query), F.lit("_raw.csv"))


def host_key(source: Column) -> Column:
    """Scheme and leading www. dropped, cut at the first slash, made path-safe."""
    bare = F.regexp_replace(source, "(?i)^https?://", "")
    bare = F.regexp_replace(bare, r"(?i)^www\.", "")
    host = F.substring_index(bare, "/", 1)
    return F.lower(F.regexp_replace(host, r'[<>:"/|?* ]+', "_"))


def zero_pad(value: Column, width: int = 10) -> Column:
    """Left-pad with zeros; a longer value stays whole and a sign stays in front."""
    text = value.cast("string")
    sign = F.regexp_extract(text, r"^[+-]", 0)
    digits = F.substr(text, F.length(sign) + 1)
    room = F.greatest(F.lit(width) - F.length(sign), F.length(digits))
    return F.concat(sign, F.lpad(digits, room, F.lit("0")))


def fill_template(template: str, value: Column) -> Column:
    """Put a value where the template says ``{}``."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def size_text(rows: Column, columns: Column) -> Column:
    known = rows.isNotNull() & columns.isNotNull()
    return F.when(known, F.format_string("%d rows, %d columns", rows.cast("bigint"), columns.cast("bigint")))


def percent_text(ratio: Column) -> Column:
    """Two decimals of the exact binary value of ``ratio * 100``, ties to the even digit.

    The fraction is split so that both parts times 100 are exact; whether their sum lies
    above, on or below the middle between two hundredths is then exact too.
    """
    value = (ratio.cast("double") * 100).cast("double")
    size = F.abs(value)
    whole = F.floor(size)
    part = size - whole
    high = F.floor(part * (1 << 26)) / (1 << 26)
    cents = F.floor(high * 100)
    beyond = (high * 100 - cents - 0.5) + (part - high) * 100
    up = (beyond > 0) | ((beyond == 0) & (cents % 2 == 1))
    hundredths = whole * 100 + cents + up.cast("bigint")
    digits = F.concat(
        F.floor(hundredths / 100).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )
    sign = F.when(value < 0, "-").otherwise("")
    # From 1e14 on a double has no two decimals left.
    plain = F.when(size < 1e14, F.concat(sign, digits, F.lit("%"))).otherwise(F.format_string("%.2f%%", value))
    known = F.when(value.isNull(), None).when(F.isnan(value), "nan%")
    return known.when(size == float("inf"), F.concat(sign, F.lit("inf%"))).otherwise(plain)


def dataset_name(path: Column) -> Column:
    """File name without its last extension and without any ``_raw``."""
    base = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(base, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")
    return F.replace(stem, F.lit("_raw"), F.lit(""))


def sheet_name(name: Column) -> Column:
    return F.substring(name, 1, SHEET_NAME_LIMIT)


def parse_list(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), ","), strip)


def row_limit(answer: Column) -> Column:
    """``struct<action, row_limit>`` for an authorisation answer; 0 means all rows."""
    word = F.lower(strip(answer))
    digits = F.rlike(word, F.lit("^[0-9]+$"))
    # More digits than a bigint holds is more rows than any table has.
    number = F.coalesce(word.try_cast("bigint"), F.lit(9223372036854775807))
    action = (
        F.when(word.isin("y", "yes"), F.lit("all"))
        .when(word.isin("n", "no"), F.lit("abort"))
        .when(digits, F.lit("limit"))
        .otherwise(F.lit("invalid"))
    )
    limit = F.when(action == "all", F.lit(0).cast("bigint")).when(action == "limit", number)
    return F.struct(action.alias("action"), limit.alias("row_limit"))


def agent_identity(key: Column, agent: str) -> Column:
    """A key that is an address identifies itself, any other is attached to the agent."""
    return F.when(F.contains(key, F.lit("@")), key).otherwise(
        F.concat(F.lit(f"{agent}/1.0 ("), key, F.lit(")"))
    )


def default_topic(topic: Column) -> Column:
    return F.coalesce(F.nullif(strip(topic), F.lit("")), F.lit(DEFAULT_TOPIC))


def float_text(column: Column) -> Column:
    """A double the way Python prints it: positional from 1e-4 up to 1e16,
    otherwise scientific with at least two exponent digits."""
    text = column.cast("double").cast("string")
    size = F.abs(column)
    # 17 digits before the point and 21 after it hold every digit in that range.
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    positional = F.regexp_replace(plain, r"\.$", ".0")
    scientific = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E([0-9])", "e+$1"), r"(?:\.0)?E-", "e-")
    return (
        F.when(F.isnan(column), F.lit("nan"))
        .when(F.contains(text, F.lit("Inf")), F.regexp_replace(text, "Infinity", "inf"))
        .when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e16) | (size < 1e-4), F.regexp_replace(scientific, "e-([0-9])$", "e-0$1"))
        .otherwise(positional)
    )

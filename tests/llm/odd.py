"""Documents with everything that may go wrong in them."""

LONG = "word and more words " * 20_000
ROWS = [
    (1, "Call +49 (170) 123-4567 or write to ann@example.org today please", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b\x0c\r", "en", ""),
    (5, "one two three", "de", "b"),
    (6, "ONE two Three", "de", "b"),
    (7, LONG, "en", "a"),
    (8, LONG + "tail", "en", None),
    (9, "é😀\x1c x\x85y  z  <|endoftext|> </s>", "", "c"),
    (10, "same line here\nsame line here\n\nsame line here", None, "c"),
    (10, "same line here\nsame line here\n\nsame line here", None, "c"),
    (None, "a text whose id is missing", "en", "a"),
    (None, "a text whose id is missing", "en", "a"),
    (-5, "4111 1111 1111 1111 and 1.2.3.4 and 300.1.1.1", "en", "d"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHES = ["quality", "_quality", "_figures", "mix", "_mix", "_draw", "_key", "key", "label", "part", "_spans", "found", "n", "ids", "band"]


def odd_documents(spark):
    """The rows above, with extra columns named like the operators' own."""
    rows = [(*r, *[f"{c}-{i}" for c in CLASHES]) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHES))


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

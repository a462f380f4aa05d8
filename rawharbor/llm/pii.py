"""Personal data: expressions propose spans, checksums confirm, context adjusts scores.

Only Spark expressions are used. An expression finds no positions, but ``split`` by the
same pattern gives the text between the matches, so the running lengths of both are the
positions. The patterns are anchored at run starts and possessive, which finds the same
matches in time linear in the text, however long a run of digits or letters is.

Base kinds (email, ip, card, phone) stay once their own check confirms them; their score
only reports confidence. Kinds added by the method stay if their score reaches
``THRESHOLD``: an iban by its mod-97 remainder, ``ssn`` (three-two-four digits) and
``local_phone`` (no country code) by context words.

Context words are looked for in the ``CONTEXT`` code points before and after a span, in the
text as it is, whatever else was found there. Words that the limit cuts do not count.

Defined cases: a null text counts as empty; spans of one kind do not overlap, spans of
different kinds may; equal rows give equal answers; other columns are kept, and one named
like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import free_name, quoted, running_total

THRESHOLD = 0.6
CONTEXT = 48
CONTEXT_GAIN = 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float  # of a confirmed span without context
    context: str  # words around the span that raise the score
    base: bool
    hint: str | None = None  # no match without this character in the text


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Every second digit from the right doubled, nine taken off above nine: the sum ends in 0."""
    number = F.reverse(digits(found))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(number, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.when(F.length(number).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def mod97(found: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: remainder 1."""
    plain = F.regexp_replace(found, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = F.ascii
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)),
        F.lit(0),
        lambda acc, i: F.when(
            code(F.substring(moved, i, F.lit(1))) < 58, (acc * 10 + code(F.substring(moved, i, F.lit(1))) - 48) % 97
        ).otherwise((acc * 100 + code(F.substring(moved, i, F.lit(1))) - 55) % 97),
    )
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(F.lit(False))


def byte_parts(found: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return found.rlike(rf"^{part}(?:\.{part}){{3}}$")


def always(found: Column) -> Column:
    return F.lit(True)


def word(*forms: str) -> str:
    """One of these words; digits, underscores and the like end a word, letters do not."""
    return rf"(?<=\P{{L}})(?:{'|'.join(forms)})(?=\P{{L}})"


PHONE_WORDS = (
    r"\p{L}*phon(?:e|es|ed|ing)", "phonenumbers?", "call(?:s|ed|er|ers|ing|back)?", "tel(?:s|no|nr)?", "mobiles?", "fax(?:es|ed|ing)?",
)
EMAIL_CHAR = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind(
        "email",
        # A match may begin inside a run only where the match before it ended.
        rf"(?:\G|(?<!{EMAIL_CHAR})){EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        always, 0.9, word(r"\p{L}*mails?", "mailto", "contacts?", "writes?"), True, "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        byte_parts, 0.6, word("ips?", r"\p{L}*hosts?", r"\p{L}*servers?", "addresse?s?", "from"), True, ".",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        luhn, 0.7, word(r"\p{L}*cards?", "visa", "credits?", "debits?", r"\p{L}*payments?"), True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(digits(m)).between(9, 15), 0.7, word(*PHONE_WORDS), True, "+",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        mod97, 0.8, word("ibans?", r"\p{L}*accounts?", r"\p{L}*banks?", r"\p{L}*konto", r"\p{L}*konten", "comptes?", "cuentas?"), False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, word("ssns?", r"social[\s_-]*security", r"(?:social)?[\s_-]*security[\s_-]*(?:numbers?|nos?|nr)"), False, "-",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        always, 0.4, word(*PHONE_WORDS, "rings?"), False,
    ),
)
SPAN = "array<struct<start:bigint,kind_order:int,kind:string,end:bigint,score:double>>"


SMALL = 256  # code points of a block, at least those of a stretch


def _stretch(blocks: Column, start: Column, size: Column) -> Column:
    two = F.array_join(F.slice(blocks, (F.shiftright(start, 8) + 1).cast("int"), 2), "")
    return F.substring(two, (start.bitwiseAND(SMALL - 1) + 1).cast("int"), size.cast("int"))


def _near(blocks: Column, start: Column, end: Column, context: str) -> Column:
    """A context word stands before or after. One code point more than the limit is looked at,
    which shows whether the limit cuts a word; beyond the ends of the text stand blanks."""
    begin = F.greatest(start - CONTEXT - 1, F.lit(0))
    before = F.lpad(_stretch(blocks, begin, F.least(start, F.lit(CONTEXT + 1))), CONTEXT + 1, " ")
    after = F.rpad(_stretch(blocks, end, F.lit(CONTEXT + 1)), CONTEXT + 1, " ")
    return F.concat(F.lower(before), F.lit(" ")).rlike(context) | F.concat(F.lit(" "), F.lower(after)).rlike(context)


def _span(kind: Kind, order: int, ends: Column, blocks: Column):
    def span(found, i):
        end = F.element_at(ends, i + 1)
        near = _near(blocks, end - F.length(found), end, kind.context)
        score = F.when(near, F.lit(min(kind.score + CONTEXT_GAIN, 1.0))).otherwise(F.lit(kind.score))
        return F.struct(
            (end - F.length(found)).cast("bigint").alias("start"),
            F.lit(order).alias("kind_order"),
            F.lit(kind.name).alias("kind"),
            end.alias("end"),
            F.when(kind.confirm(found), score).otherwise(F.lit(0.0)).alias("score"),
        )

    return span


def with_spans(docs: DataFrame, out: str, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` and an array named ``out`` of ``start, kind_order, kind, end, score``,
    ordered by start and then kind; positions in code points, end exclusive."""
    whole = free_name(docs, "_text")
    rows = docs.withColumn(whole, F.coalesce(quoted(text).cast("string"), F.lit("")))
    t, per_kind = quoted(whole), []
    # Step by step, so that no expression is evaluated once per use.
    steps: dict[str, Column] = {}
    for kind in kinds:
        found = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))
        if kind.hint:
            found = F.when(F.contains(t, F.lit(kind.hint)), found).otherwise(F.array().cast("array<string>"))
        steps[free_name(docs, f"_found_{kind.name}")] = found
    rows = rows.withColumns(steps)
    names = list(steps)
    rows = rows.withColumns(
        {
            free_name(docs, f"_between_{kind.name}"): F.when(F.size(quoted(n)) > 0, F.split(t, kind.pattern))
            for kind, n in zip(kinds, names)
        }
    )
    between = [free_name(docs, f"_between_{kind.name}") for kind in kinds]
    # Ends of the matches: running sums of the lengths of text between and match.
    rows = rows.withColumns(
        {
            free_name(docs, f"_ends_{kind.name}"): F.when(
                F.size(quoted(n)) > 0,
                running_total(
                    F.zip_with(
                        quoted(n), quoted(b), lambda m, p: (F.coalesce(F.length(m), F.lit(0)) + F.coalesce(F.length(p), F.lit(0))).cast("bigint")
                    ),
                    lambda x, y: x + y,
                ),
            )
            for kind, n, b in zip(kinds, names, between)
        }
    )
    ends = [free_name(docs, f"_ends_{kind.name}") for kind in kinds]
    blocks = free_name(docs, "_blocks")
    some = F.greatest(*[F.size(quoted(n)) for n in names]) > 0
    rows = rows.withColumn(blocks, F.when(some, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{SMALL}}}"), F.lit(0))))
    for order, (kind, n, e) in enumerate(zip(kinds, names, ends)):
        keep = (lambda s: s["score"] > 0) if kind.base else (lambda s: s["score"] >= THRESHOLD)
        scored = F.filter(F.transform(quoted(n), _span(kind, order, quoted(e), quoted(blocks))), keep)
        per_kind.append(F.when(F.size(quoted(n)) > 0, scored).otherwise(F.array().cast(SPAN)))
    spans = F.array_sort(F.flatten(F.array(*per_kind)))
    return rows.select(*[quoted(c) for c in docs.columns if c != out], spans.alias(out))


def rendered(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


BLOCK = 4096


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text whose blocks these are."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = (start % BLOCK + 1).cast("int")
    return (
        F.when(end <= start, F.lit(""))
        .when(first == last, F.substring(F.element_at(blocks, first + 1), head, (end - start).cast("int")))
        .otherwise(
            F.concat(
                F.substring(F.element_at(blocks, first + 1), head, F.lit(BLOCK)),
                F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
                F.substring(F.element_at(blocks, last + 1), F.lit(1), ((end - 1) % BLOCK + 1).cast("int")),
            )
        )
    )


def mask(docs: DataFrame, spans: str, text: str = "text") -> DataFrame:
    """``docs`` without ``spans``, each stretch of the text that spans cover replaced by
    ``[KIND]`` of its first span. A null text stays null.

    The text is cut into blocks once, so cutting at many spans stays linear.
    """
    blocks, ends, heads, cuts = (free_name(docs, n) for n in ("_blocks", "_ends", "_heads", "_cuts"))
    some = F.size(quoted(spans)) > 0
    rows = docs.withColumns(
        {
            blocks: F.when(some, F.regexp_extract_all(quoted(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))),
            ends: F.when(some, running_total(F.transform(quoted(spans), lambda s: s["end"]), lambda x, y: F.greatest(x, y))),
        }
    )
    # A stretch begins where no span before reaches.
    marked = F.transform(
        quoted(spans),
        lambda s, i: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            i.alias("at"),
            ((i == 0) | (s["start"] >= F.element_at(quoted(ends), F.greatest(i, F.lit(1))))).alias("head"),
        ),
    )
    rows = rows.withColumn(heads, F.when(some, F.filter(marked, lambda s: s["head"])))
    stretches = F.transform(
        quoted(heads),
        lambda s, j: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            F.element_at(quoted(ends), F.coalesce(F.try_element_at(quoted(heads), j + 2)["at"], F.size(quoted(ends)))).alias("end"),
        ),
    )
    rows = rows.withColumn(cuts, stretches)
    pieces = F.transform(
        quoted(cuts),
        lambda s, j: F.concat(
            cut(
                quoted(blocks),
                F.when(j == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(quoted(cuts), F.greatest(j, F.lit(1)))["end"]),
                s["start"],
            ),
            F.lit("["),
            F.upper(s["kind"]),
            F.lit("]"),
        ),
    )
    tail = cut(quoted(blocks), F.element_at(quoted(cuts), -1)["end"], F.length(quoted(text)).cast("bigint"))
    clean = F.when(some & quoted(text).isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(quoted(text))
    return rows.select(*[(clean if c == text else quoted(c)).alias(c) for c in docs.columns if c != spans])

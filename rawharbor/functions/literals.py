"""What a regular expression needs: literals one of which every match must contain."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes that stand for one character.
CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\x07", "e": "\x1b"}
# Escapes with an operand, which must not be taken for text: properties, names, code points.
OPERANDS = re.compile(r"[pP](?:\{[^}]*\}|.)|k<[^>]*>|N\{[^}]*\}|x(?:\{[^}]*\}|..)|u....|0[0-7]{1,3}|c.|[0-9]+|.", re.DOTALL)
COUNTED = re.compile(r"\{(\d+)(?:,\d*)?\}")
GROUP = re.compile(r"\?(?::|>|<[a-zA-Z][a-zA-Z0-9]*>|([a-zA-Z]*)(-[a-zA-Z]*)?([:)]))")


class _Unclear(Exception):
    """Syntax that this does not follow: nothing is said about the pattern."""


Need = frozenset[str] | None  # one of these is in every match; None says nothing


def _better(a: Need, b: Need) -> Need:
    """The need that fewer texts meet, as far as lengths tell."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda need: (min(map(len, need)), -len(need), sorted(need)))


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def alternatives(self) -> Need:
        needs = [self.sequence()]
        while self.text.startswith("|", self.at):
            self.at += 1
            needs.append(self.sequence())
        return None if None in needs else frozenset().union(*needs)

    def sequence(self) -> Need:
        best, run = None, ""
        for need, literal in self.parts():
            if literal is not None:
                run += literal
                continue
            if run:
                best, run = _better(best, frozenset([run])), ""
            best = _better(best, need)
        return _better(best, frozenset([run])) if run else best

    def parts(self) -> Iterator[tuple[Need, str | None]]:
        """Characters that follow one another as literals, anything else as what it needs."""
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            literals, need = self.atom()
            least = self.quantifier()
            if least is None:
                for c in literals:
                    yield None, c
                if not literals:
                    yield need, None
                continue
            for c in literals[:-1]:  # a quantifier holds for the last one
                yield None, c
            if least and literals:
                yield None, literals[-1]
            yield (need if least and not literals else None), None

    def atom(self) -> tuple[str, Need]:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            return "", self.group()
        if c == "[":
            self.skip_class()
            return "", None
        if c in ".^$":
            return "", None
        if c == "\\":
            return self.escape(), None
        if c in "*+?{":
            raise _Unclear
        return c, None

    def escape(self) -> str:
        if self.at >= len(self.text):
            raise _Unclear
        c = self.text[self.at]
        if c == "Q":
            end = self.text.find("\\E", self.at)
            quoted = self.text[self.at + 1 : end if end >= 0 else None]
            self.at = len(self.text) if end < 0 else end + 2
            return quoted
        if not (c.isascii() and c.isalnum()):
            self.at += 1
            return c
        self.at = OPERANDS.match(self.text, self.at).end()
        return CONTROL.get(c, "")

    def quantifier(self) -> int | None:
        """The least number of times, or None without a quantifier."""
        if self.at >= len(self.text) or self.text[self.at] not in "*+?{":
            return None
        c, least = self.text[self.at], 0
        if c == "{":
            counted = COUNTED.match(self.text, self.at)
            if not counted:
                raise _Unclear
            least, self.at = int(counted[1]), counted.end()
        else:
            least, self.at = int(c == "+"), self.at + 1
        if self.at < len(self.text) and self.text[self.at] in "?+":
            self.at += 1
        return least

    def group(self) -> Need:
        looks = self.text.startswith(("?=", "?!", "?<=", "?<!"), self.at)
        if self.text.startswith("?", self.at) and not looks:
            head = GROUP.match(self.text, self.at)
            if not head or "x" in (head[1] or "") or head[2]:
                raise _Unclear
            self.at = head.end()
            if head[3] == ")":  # flags for what follows
                return None
        elif looks:
            self.at += 3 if self.text.startswith("?<", self.at) else 2
        need = self.alternatives()
        if not self.text.startswith(")", self.at):
            raise _Unclear
        self.at += 1
        return None if looks else need

    def skip_class(self) -> None:
        """Behind a class; classes inside classes are left alone."""
        self.at += self.text.startswith("^", self.at)
        self.at += self.text.startswith("]", self.at)
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "]":
                return
            if c == "[" or self.text.startswith(("&&", "\\Q"), self.at - 1):
                raise _Unclear
            self.at += c == "\\"
        raise _Unclear


def needed_literals(pattern: str) -> list[str]:
    """Texts one of which is in every match, up to case; empty if nothing is known."""
    reader = _Reader(pattern)
    try:
        need = reader.alternatives()
    except (_Unclear, RecursionError):
        return []
    # A bracket that closes nothing ends the reading early.
    return sorted(need) if need and reader.at == len(pattern) else []


def _all_needed(patterns: pa.Array) -> pa.Array:
    return pa.array([needed_literals(p) if p is not None else [] for p in patterns.to_pylist()], pa.list_(pa.string()))


def needed(pattern: Column) -> Column:
    """:func:`needed_literals` of a column of patterns: a small helper over queries, not over data."""
    return F.arrow_udf(_all_needed, "array<string>")(pattern)


def is_pattern(text: Column) -> Column:
    """Whether the engine that matches can compile the pattern; null for null."""
    compiled = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), text)
    return F.when(text.isNotNull(), compiled.isNotNull())

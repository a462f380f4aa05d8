"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Each rule compares one figure of a text with a cutoff. Per stratum, labelled good
documents are the holdout: a cutoff is *certified* if the exact binomial test says,
at the corrected level, that it rejects at most the allowed share of good documents.
Cutoffs of a rule are tested from the most lenient on and testing stops at the first
failure, which needs no correction within the rule; over rules and strata the level
is divided (Bonferroni), and so is the allowed share over the rules, because a
document is rejected if any rule rejects it. Of the certified cutoffs the one that
best separates the labelled bad documents is used; if none gains, the rule is off.

Nulls, ties, empties: a null text has no words; a null stratum is a stratum; labels
without document, null labels and ids with conflicting labels are not used; without
labels no rule is on, and only the base test rejects.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import attach, encoded, free_name, materialize, quoted
from rawharbor.operators.joins import join_reduced
from rawharbor.session import prepare_python

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
ALLOWED = 0.05  # share of good documents of a stratum that all rules together may reject
LEVEL = 0.05  # chance that the guarantee is broken anywhere
PRICE = 10.0  # a point of good documents lost weighs as much as ten of bad ones found

# Cutoffs of each rule, most lenient first; a figure above the cutoff is rejected.
GRIDS = {
    "symbols": [2.0 ** (-i / 4) * 4 for i in range(0, 36)],
    "dup_lines": [i / 40 for i in range(39, 0, -1)],
    "repeat_words": [i / 40 for i in range(39, 0, -1)],
    "word_length": [i / 4 for i in range(80, 15, -1)],
}


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    kinds = len(codes)
    if kinds >= 1 << 21:
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * kinds + ids[2:]
    else:
        windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    covered = np.zeros(len(words) + 2, bool)
    found = np.zeros(len(windows), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    at = np.flatnonzero(found)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def text_figures(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(FIELDS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at the six ASCII blanks only
    lines = [line for line in raw.split(b"\n") if line.translate(None, BLANKS)]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    return (
        len(words),
        len(text) - blanks,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _figures(texts: pa.Array) -> pa.Array:
    rows = [text_figures(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FIELDS))


def with_figures(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` and a struct of whole-text counts named ``out``."""
    prepare_python(docs.sparkSession)
    measure = F.arrow_udf(_figures, "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">").asNondeterministic()
    return docs.withColumn(out, measure(quoted(text).cast("string")))


def base_failed(figures: Column) -> Column:
    n = figures["n_words"]
    return (n < 50) | (100 * figures["n_repeat_words"] > 50 * n)


def rule_values(figures: Column) -> dict[str, Column]:
    words, lines = F.greatest(figures["n_words"], F.lit(1)), F.greatest(figures["n_lines"], F.lit(1))
    return {
        "symbols": figures["n_symbols"] / words,
        "dup_lines": figures["n_dup_lines"] / lines,
        "repeat_words": figures["n_repeat_words"] / words,
        "word_length": figures["word_chars"] / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws of chance p, summed exactly term by term."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=float)
    steps = np.log((n - i) / (i + 1)) + np.log(p) - np.log1p(-p)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, allowed: float, level: float) -> int | None:
    """Index of the cutoff to use. ``good[i]`` and ``bad[i]`` are how many documents have
    ``i`` cutoffs below their figure, counted from the strictest; a document with ``i``
    of them is rejected by the ``i`` strictest cutoffs."""
    size = len(good) - 1
    best, gain = None, 0.0
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return None
    for cutoff in range(size):  # most lenient first: rejected are those above all cutoffs, then all but one, ...
        lost, found = int(good[size - cutoff :].sum()), int(bad[size - cutoff :].sum())
        if lost / n_good > allowed or binomial_tail(lost, n_good, allowed) > level:
            break
        value = found / n_bad - PRICE * lost / n_good
        if value > gain:
            best, gain = cutoff, value
    return best


def _above(value: Column):
    return lambda cut: value > cut


def learn_cutoffs(
    measured: DataFrame,
    figures: str,
    labels: DataFrame,
    id_column: str = "doc_id",
    stratum: str = "lang",
    allowed: float = ALLOWED,
    level: float = LEVEL,
) -> DataFrame:
    """``stratum, cutoffs map<rule, double>``: the certified cutoffs of each stratum."""
    clean = (
        labels.filter(F.col("quality").isNotNull() & quoted(id_column).isNotNull())
        .groupBy(quoted(id_column).alias("_id"))
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .filter("_low = _high")
        .select("_id", (F.col("_low") == 1).alias("_good"))
    )
    narrow = measured.select(
        quoted(id_column).alias("_id"), quoted(stratum).cast("string").alias("stratum"), quoted(figures).alias("_f")
    )
    values = rule_values(F.col("_f"))
    # How many cutoffs lie below the figure, counted from the strictest.
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.size(F.filter(F.array(*map(F.lit, GRIDS[rule])), above)).alias("passed"),
                )
                for rule, above in [(rule, _above(value)) for rule, value in values.items()]
            ]
        )
    )
    counts = (
        join_reduced(narrow.filter(F.col("_id").isNotNull() & ~base_failed(F.col("_f"))), clean, ["_id"], "inner")
        .select("stratum", "_good", cells.alias("_cell"))
        .groupBy("stratum", "_cell.rule", "_cell.passed")
        .agg(F.sum(F.col("_good").cast("bigint")).alias("good"), F.sum((~F.col("_good")).cast("bigint")).alias("bad"))
    )
    counts = materialize(counts, "quality-counts")  # one row per stratum, rule and cutoff
    strata = counts.select("stratum").distinct().count()
    each, test_level = allowed / len(GRIDS), level / max(1, strata * len(GRIDS))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rule = group["rule"].iloc[0]
        good, bad = (np.zeros(len(GRIDS[rule]) + 1, np.int64) for _ in range(2))
        np.add.at(good, group["passed"].to_numpy(), group["good"].to_numpy())
        np.add.at(bad, group["passed"].to_numpy(), group["bad"].to_numpy())
        chosen = choose_cutoff(good, bad, each, test_level)
        rows = [] if chosen is None else [(group["stratum"].iloc[0], rule, float(GRIDS[rule][chosen]))]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff"])

    chosen = counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff double")
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    out: str,
    id_column: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    allowed: float = ALLOWED,
    level: float = LEVEL,
) -> DataFrame:
    """``docs`` and a struct named ``out``: the counts, ``base_failed``, the names of the
    rules that reject (``rejected_by``), and ``kept``.

    Texts are measured twice, once to learn and once to apply, and never shuffled.
    """
    figures = free_name(docs, "_figures")
    measured = with_figures(docs, figures, text)
    learned = learn_cutoffs(measured, figures, labels, id_column, stratum, allowed, level)
    key, cuts = free_name(docs, "_stratum_key"), free_name(docs, "_cutoffs")
    learned = learned.select(encoded(F.col("stratum")).alias(key), F.col("cutoffs").alias(cuts))
    joined = attach(measured.withColumn(key, encoded(quoted(stratum))), learned, key)
    f = quoted(figures)
    rejected = F.filter(
        F.array(*[F.when(value > quoted(cuts)[rule], F.lit(rule)) for rule, value in rule_values(f).items()]),
        lambda r: r.isNotNull(),
    )
    failed = base_failed(f)
    verdict = F.struct(
        *[f[x].alias(x) for x in FIELDS],
        failed.alias("base_failed"),
        rejected.alias("rejected_by"),
        (~failed & (F.size(rejected) == 0)).alias("kept"),
    )
    return joined.select(*[quoted(c) for c in docs.columns if c != out], verdict.alias(out))
